"""Vocabulary building: sources by precedence, ordered distinct, label frequencies, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_distinct(rows: DataFrame, value: str, ordinal: str) -> DataFrame:
    """Each value with its first place."""
    return rows.groupBy(value).agg(F.min(ordinal).alias(ordinal))


def by_precedence(sources: list[DataFrame], value: str = "phrase") -> DataFrame:
    """(phrase, source): the union of sources; a phrase belongs to the first source that has it."""
    every = None
    for i, s in enumerate(sources):
        own = s.where(F.col(value).isNotNull()).select(value, F.lit(i).alias("source"))
        every = own if every is None else every.union(own)
    return every.groupBy(value).agg(F.min("source").alias("source"))


def top_labels(counts: DataFrame, names: DataFrame, n: int, name: str = "name") -> DataFrame:
    """The n most frequent labels that have a usable name; counts: key, n; names: key, name."""
    named = counts.join(names, "key").where(F.col(name).isNotNull())
    return named.orderBy(F.desc("n"), "key").limit(n)


def unresolved(counts: DataFrame, names: DataFrame) -> DataFrame:
    return counts.join(names, "key", "left_anti").agg(F.count("*").alias("n_unresolved"))


def fingerprint(phrases: DataFrame, value: str = "phrase") -> DataFrame:
    """A digest of a set: equal sets give equal digests in any order, and no task holds the set."""
    own = phrases.select(F.sha2(F.col(value), 256).alias("_d")).distinct()
    parts = own.select(*[F.conv(F.substring("_d", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)").alias(f"_p{i}") for i in range(4)])
    sums = parts.agg(F.count("*").alias("_n"), *[F.sum(f"_p{i}").alias(f"_s{i}") for i in range(4)])
    return sums.select(F.sha2(F.concat_ws(":", "_n", *[F.col(f"_s{i}").cast("string") for i in range(4)]), 256).alias("fingerprint"))


def same_set(a: DataFrame, b: DataFrame) -> bool:
    return not a.exceptAll(b).union(b.exceptAll(a)).limit(1).count() if a.columns == b.columns else False


def place_category(line: Column) -> Column:
    """'/a/base/modifier 12' as 'modifier base'."""
    path = F.regexp_extract(line, r"^/[a-z]/(\S+)", 1)
    parts = F.split(F.replace(path, F.lit("_"), F.lit(" ")), "/")
    return F.concat_ws(" ", F.reverse(parts))


def latest_per_key(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """One row a key, the last by an order: last writer wins."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")
