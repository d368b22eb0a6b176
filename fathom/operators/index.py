"""The media index: a table of one row for each file, its global order, and its maintenance as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.media import path_key
from fathom.plans.scratch import Scratch


def global_index(df: DataFrame, order: list[Column | str], scratch: Scratch, name: str = "idx") -> DataFrame:
    """df with its position in a total order, from 0.

    Ranges are numbered apart and shifted by the sizes of the ranges before them; only these sizes, one row a range, meet.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = scratch.table(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_range", before.alias("_before"))
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*keys)) - 1
    return ranged.withColumn("_local", local).join(F.broadcast(offsets), "_range").withColumn(name, (F.col("_before") + F.col("_local")).cast("long")).drop("_range", "_local", "_before")


def new_files(live: DataFrame, existing: DataFrame, path: str = "path") -> DataFrame:
    """Rows of live whose case-folded path the index does not have."""
    return live.join(existing.select(path_key(F.col(path)).alias("_key")), path_key(live[path]) == F.col("_key"), "left_anti")


def missing_files(existing: DataFrame, live: DataFrame, path: str = "path") -> DataFrame:
    return new_files(existing, live, path)


def without_known_rejects(found: DataFrame, rejects: DataFrame) -> DataFrame:
    """Files that an earlier scan rejected, and that have kept size and time, are not looked at again."""
    r = rejects.select(F.col("key").alias("_k"), F.col("size").alias("_s"), F.col("mtime").alias("_m"))
    same = (path_key(found["path"]) == F.col("_k")) & (found["size"] == F.col("_s")) & (found["mtime"] == F.col("_m"))
    return found.join(r, same, "left_anti")


def updated(existing: DataFrame, live: DataFrame, encoded: DataFrame, path: str = "path") -> DataFrame:
    """The index after an update: existing rows that are still live, and the encoded new rows."""
    kept = existing.join(live.select(path_key(F.col(path)).alias("_key")).distinct(), path_key(existing[path]) == F.col("_key"), "left_semi")
    return kept.unionByName(encoded)


def deleted(index: DataFrame, gone: DataFrame) -> DataFrame:
    """The index without rows whose idx is in gone. A position that the index does not have stops the whole batch.

    All positions are of the index as given. The check reads positions alone, of index and batch.
    """
    beyond = gone.select("idx").distinct().join(index.select("idx"), "idx", "left_anti").limit(1).collect()
    if beyond:
        raise IndexError(f"no row has position {beyond[0]['idx']}")
    return index.join(gone.select("idx").distinct(), "idx", "left_anti")


def renumbered(marks: DataFrame, gone: DataFrame) -> DataFrame:
    """Positions after a deletion: each moves down by the deletions below it; deleted ones go.

    One window over marks and deletions in ranges of positions, not a comparison of each with each.
    """
    span = 1 << 16
    both = marks.select("idx", F.lit(0).alias("_d")).union(gone.select("idx").distinct().select("idx", F.lit(1).alias("_d"))).withColumn("_b", F.floor(F.col("idx") / span))
    per = both.groupBy("_b").agg(F.sum("_d").alias("_n"))
    before = per.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    below = F.coalesce(F.sum("_d").over(Window.partitionBy("_b").orderBy("idx").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here = F.max("_d").over(Window.partitionBy("_b", "idx"))
    out = both.withColumns({"_below": below, "_here": here}).where("_d = 0 AND _here = 0").join(before, "_b")
    return out.select("idx", (F.col("idx") - F.col("_below") - F.col("_before")).alias("new_idx"))


def image_info(index: DataFrame, idx: int, *columns: str) -> DataFrame:
    """The row at a position; an error if there is none."""
    row = index.where(F.col("idx") == idx).select("idx", *columns)
    if row.isEmpty():
        raise IndexError(f"no row has position {idx}")
    return row


def positions(table: DataFrame, keys: list[tuple], order: list[str]) -> DataFrame:
    """(_k, idx) of a few stated rows, by the place of their key among keys in order: how many rows come before each.

    One pass over the order columns with a count for each gap between the stated keys; nothing is sorted and nothing dealt.
    """
    spark = table.sparkSession
    if not keys:
        return spark.createDataFrame([], "_k int, idx long")
    stated = F.array(*[F.struct(*[F.lit(v).cast(table.schema[c].dataType).alias(c) for c, v in zip(order, key)]) for key in keys])
    below = F.size(F.filter(stated, lambda k: k < F.struct(*order)))
    gaps = table.select(below.alias("_k")).groupBy("_k").agg(F.count("*").alias("_n"))
    every = spark.range(len(keys)).select(F.col("id").cast("int").alias("_k"))
    upto = F.sum(F.coalesce("_n", F.lit(0))).over(Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0))
    return every.join(gaps, "_k", "left").select("_k", (upto - 1).alias("idx"))


def renamed(index: DataFrame, idx: int, new_path: str, path: str = "path") -> DataFrame:
    return index.withColumn(path, F.when(F.col("idx") == idx, F.lit(new_path)).otherwise(F.col(path)))


def export_names(selection: DataFrame, path: str = "path", idx: str = "idx") -> DataFrame:
    """selection with a destination name: the file's own, else with its folder's name before it, else with a number after it."""
    parts = F.split(F.col(path), "/")
    name = F.element_at(parts, -1)
    folder = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit(""))
    first = selection.withColumn("_name", name).withColumn("_n", F.row_number().over(Window.partitionBy("_name").orderBy(idx)))
    second = first.withColumn("_alt", F.when(F.col("_n") == 1, F.col("_name")).otherwise(F.concat(folder, F.lit("_"), F.col("_name"))))
    second = second.withColumn("_m", F.row_number().over(Window.partitionBy("_alt").orderBy("_n", idx)))
    numbered = F.concat(F.regexp_replace("_alt", r"(\.[^.]*)?$", ""), F.lit("_"), (F.col("_m") - 1).cast("string"), F.regexp_extract("_alt", r"(\.[^.]*)$", 1))
    return second.withColumn("dest", F.when(F.col("_m") == 1, F.col("_alt")).otherwise(numbered)).drop("_name", "_n", "_alt", "_m")


def patched(stored: DataFrame, changes: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """A patch update: a null in changes keeps what is stored; columns of keep never change."""
    c = changes.select(*[F.col(x).alias(f"_new_{x}") for x in changes.columns])
    out = stored.join(c, stored[key] == F.col(f"_new_{key}"), "left")
    cols = [F.coalesce(F.col(f"_new_{x}"), stored[x]).alias(x) if x in changes.columns and x not in (key, *keep) else stored[x] for x in stored.columns]
    return out.select(*cols)
