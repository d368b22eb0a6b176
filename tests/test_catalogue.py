"""Records: patches, migrations that run once, and writers that meet."""

import json

import pytest
from pyspark.sql import functions as F

from fathom.sources import catalogue
from fathom.sources.catalogue import Catalogue
from fathom.sources.store import Conflict, Store


def frame(spark, rows, names):
    return spark.createDataFrame([(k, v if v is None or isinstance(v, str) else json.dumps(v)) for k, v in rows], f"key string, {names} string")


def held(df):
    return {r["key"]: json.loads(r["record"]) for r in df.collect()}


def floor_to(value):
    def change(record):
        old = F.get_json_object(record, "$.floor").try_cast("double") == 0.2
        return F.when(old, catalogue.with_field(record, "floor", F.lit(value))).otherwise(record)

    return change


def test_patch_keeps_clears_and_fixes(spark):
    stored = {"name": "n", "floor": 0.2, "kind": "board", "user": "u", "paths": ["a", {"b": None}], "text": "[x] {y}"}
    records = frame(spark, [("a", stored), ("b", stored)], "record").withColumn("version", F.lit("1.1.0"))
    patch = {"name": "", "floor": 0, "kind": "directory", "user": None, "paths": None, "extra": {"deep": [1]}, "on": False}
    out, unknown = catalogue.patched(records, frame(spark, [("a", patch), ("z", {})], "patch"), ["user", "kind"], ["kind"])
    got = held(out)
    assert got["a"] == {"name": "", "floor": 0, "kind": "board", "paths": ["a", {"b": None}], "text": "[x] {y}", "extra": {"deep": [1]}, "on": False}
    assert got["b"] == stored and [r["key"] for r in unknown.collect()] == ["z"]
    odd = frame(spark, [("a", "not json"), ("b", None), ("c", "[1]")], "record").withColumn("version", F.lit(None).cast("string"))
    out, _ = catalogue.patched(odd, frame(spark, [(k, {"x": 1}) for k in "abc"], "patch"))
    assert set(map(str, held(out).values())) == {"{'x': 1}"}
    assert catalogue.patched(records.limit(0), frame(spark, [], "patch"))[0].count() == 0


def test_migrations_run_once_and_in_order(spark, tmp_path):
    store = Store(spark, str(tmp_path / "albums"))
    old = frame(spark, [("a", {"floor": 0.2}), ("b", {"floor": 0.5}), ("c", {"floor": 0.2}), ("d", {"floor": 0.2})], "record")
    version = F.when(F.col("key") == "c", "1.10.0").when(F.col("key") != "d", "1.0.0")
    store.write(old.withColumn("version", version))
    own = Catalogue(store, [("1.9.0", floor_to("0.9")), ("1.2.0", floor_to("0.02"))])
    assert held(own.load()) == {"a": {"floor": 0.02}, "b": {"floor": 0.5}, "c": {"floor": 0.2}, "d": {"floor": 0.02}}
    assert {r["key"]: r["version"] for r in own.load().collect()} == {"a": "1.9.0", "b": "1.9.0", "c": "1.10.0", "d": "1.9.0"}
    assert store.current()[0] == 1
    assert own.patch(frame(spark, [("a", {"floor": 0.2})], "patch")) == []
    assert store.current()[0] == 2 and held(own.load())["a"] == {"floor": 0.2}


def test_changes_and_conflicts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "albums"))
    own = Catalogue(store)
    assert own.add(frame(spark, [("a", {"n": 1}), ("b", {"n": 2})], "record"), "1.0.0") == []
    assert own.add(frame(spark, [("b", {"n": 3}), ("c", {"n": 4})], "record"), "1.0.0") == ["b"]
    assert own.patch(frame(spark, [("a", {"n": 9}), ("q", {})], "patch")) == ["q"] and held(own.load()) == {"a": {"n": 1}, "b": {"n": 2}}
    own.delete(frame(spark, [("b", "")], "x"))
    assert held(own.load()) == {"a": {"n": 1}}
    read, rows = own._read()
    assert own.patch(frame(spark, [("a", {"n": 5})], "patch")) == []
    with pytest.raises(Conflict):
        store.replace(rows, read)
    assert held(own.load()) == {"a": {"n": 5}}
    read = store.current()
    store.append(own.load(), "late")
    with pytest.raises(Conflict):
        store.replace(own.load(), read)


def test_a_number_is_given_back(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.write(spark.range(2))
    read = store.current()
    with pytest.raises(Exception, match="[Dd]ivision|DIVIDE"):
        store.replace(spark.range(2).select(F.expr("assert_true(id > 5, 'Division')").alias("x")), read)
    assert store.replace(spark.range(3), read) == 2 and store.read().count() == 3
    read = store.current()
    dead = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store.path}/_claims/v3")
    dead.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).createNewFile(dead)
    with pytest.raises(Conflict):
        store.replace(spark.range(4), read)
    store.release(3)
    assert store.replace(spark.range(4), read) == 3 and store.read().count() == 4
