"""Derived tables (labels, phrase vectors, rejects, a layout, a radius) that are kept until what they were made from changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.sources.store import Store


def content_stamp(rows: DataFrame, *columns: str) -> str:
    """A digest of the rows' values, whatever their order: their number and two sums of hashes, added up before the shuffle."""
    sums = [F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)")).alias(f"s{seed}") for seed in (1, 2)]
    n, a, b = rows.agg(F.count("*"), *sums).first()
    return f"{n}:{a or 0}:{b or 0}"


class Derived:
    """A derived table in a store, good for one stamp: a digest of its sources and the settings that it was made with."""

    def __init__(self, store: Store):
        self.store = store

    def read(self, stamp: str) -> DataFrame | None:
        """The kept rows, or None if there are none or they have another stamp."""
        if not self.store.exists():
            return None
        kept = self.store.read()
        first = kept.select("_stamp").first()
        return kept.drop("_stamp") if first and first[0] == stamp else None

    def get(self, stamp: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The kept rows, or those of make, which are kept from then on. A table without rows is made again each time."""
        kept = self.read(stamp)
        if kept is None:
            version = self.store.write(make().withColumn("_stamp", F.lit(stamp)))
            kept = self.store.read(version).drop("_stamp")
        return kept


def staleness(sources: DataFrame, made: Column, key: str, mtime: str = "mtime") -> DataFrame:
    """(key, newest, stale): whether what was made of a group's sources is missing or older than the newest of them."""
    newest = sources.groupBy(key).agg(F.max(mtime).alias("newest"))
    return newest.withColumn("stale", made.isNull() | (made < F.col("newest")))
