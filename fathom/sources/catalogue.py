"""Records by key, such as albums and their settings: migrations, patches, and writes that never undo another writer's."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.sources.store import Store

SCHEMA = "key string, record string, version string"
_MAP = "map<string,variant>"

Migration = tuple[str, Callable[[Column], Column]]


def _parts(version: Column) -> Column:
    """A version's numbers, three at least; what is no number counts as 0."""
    own = F.transform(F.split(F.coalesce(version, F.lit("")), r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    return F.concat(own, F.array_repeat(F.lit(0), F.greatest(3 - F.size(own), F.lit(0))))


def fields(record: Column) -> Column:
    """The record's fields as a map of variants; what is no JSON object has none."""
    return F.coalesce(F.from_json(record, _MAP), F.from_json(F.lit("{}"), _MAP))


def as_record(own: Column) -> Column:
    """A map of variants as JSON, its fields by name."""
    names = F.array_sort(F.map_keys(own))
    return F.to_json(F.map_from_arrays(names, F.transform(names, lambda k: F.try_element_at(own, k))))


def with_field(record: Column, name: str, value: Column) -> Column:
    """The record with one field set to a value, given as JSON; a null value takes the field out."""
    others = F.map_filter(fields(record), lambda k, v: k != name)
    one = F.map_from_arrays(F.array(F.lit(name)), F.array(F.parse_json(value)))
    return as_record(F.when(value.isNull(), others).otherwise(F.map_concat(others, one)))


def migrated(records: DataFrame, migrations: Sequence[Migration]) -> DataFrame:
    """records (key, record, version) after the migrations that are newer than their version, oldest first.

    A record gets the last migration's version; one that is newer than all keeps its own, and a record without one is older than
    all. So each migration is applied to a record once, and a value that it replaced can be set again later.
    """
    out = records
    for version, change in sorted(migrations, key=lambda x: [int(n) for n in x[0].split(".")]):
        old = _parts(F.col("version")) < _parts(F.lit(version))
        out = out.withColumns({"record": F.when(old, change(F.col("record"))).otherwise(F.col("record")), "version": F.when(old, version).otherwise(F.col("version"))})
    return out


def patched(records: DataFrame, patches: DataFrame, clearing: Sequence[str] = (), fixed: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(records after the patches, keys of patches without a record). patches: key (unique), patch.

    A field that a patch lacks, or has as null, stays as stored; zero, false and the empty text are values. A null clears
    the fields in clearing. The fields in fixed never change.
    """
    named = lambda k, names: k.isin(*names) if names else F.lit(False)
    null = lambda v: F.coalesce(F.is_variant_null(v), F.lit(True))
    own, new = fields(F.col("record")), fields(F.col("_patch"))
    given = F.map_filter(new, lambda k, v: ~named(k, fixed) & ~null(v))
    cleared = F.map_keys(F.map_filter(new, lambda k, v: named(k, clearing) & ~named(k, fixed) & null(v)))
    kept = F.map_filter(own, lambda k, v: ~F.array_contains(cleared, k) & ~F.array_contains(F.map_keys(given), k))
    both = records.join(patches.select(F.col("key"), F.col("patch").alias("_patch")), "key", "left")
    out = both.withColumn("record", F.when(F.col("_patch").isNull(), F.col("record")).otherwise(as_record(F.map_concat(kept, given)))).select(*records.columns)
    return out, patches.join(records.select("key"), "key", "left_anti").select("key")


class Catalogue:
    """A store of records. Each change reads the current version, migrates it, and replaces that version or fails with Conflict."""

    def __init__(self, store: Store, migrations: Sequence[Migration] = (), clearing: Sequence[str] = (), fixed: Sequence[str] = ()):
        self.store, self.migrations, self.clearing, self.fixed = store, list(migrations), list(clearing), list(fixed)

    def _read(self) -> tuple[tuple, DataFrame]:
        read = self.store.current()
        kept = self.store.read(read[0]) if read[0] else self.store.spark.createDataFrame([], SCHEMA)
        return read, migrated(kept, self.migrations)

    def load(self) -> DataFrame:
        """(key, record, version), migrated. Reading writes nothing: the next change takes the migrated records along."""
        return self._read()[1]

    def add(self, records: DataFrame, version: str) -> list[str]:
        """Adds records (key, record); a key that is there stays as it is and is returned, and then nothing is added."""
        read, own = self._read()
        known = [r["key"] for r in records.join(own.select("key"), "key", "left_semi").select("key").distinct().orderBy("key").collect()]
        if not known:
            self.store.replace(own.unionByName(records.select("key", "record", F.lit(version).alias("version"))), read)
        return known

    def patch(self, patches: DataFrame) -> list[str]:
        """Applies patches (key, patch); a key without a record is returned, and then nothing is changed."""
        read, own = self._read()
        out, unknown = patched(own, patches, self.clearing, self.fixed)
        lost = [r["key"] for r in unknown.orderBy("key").collect()]
        if not lost:
            self.store.replace(out, read)
        return lost

    def delete(self, keys: DataFrame) -> None:
        read, own = self._read()
        self.store.replace(own.join(keys.select("key"), "key", "left_anti"), read)
