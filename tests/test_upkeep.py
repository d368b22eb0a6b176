"""Derived tables and the operators beside an index, on odd inputs."""

import os

import duck
import pytest
from pyspark.sql import functions as F

from fathom import catalog
from fathom.functions import media as m
from fathom.operators import upkeep as up
from fathom.sources import surrogates
from fathom.sources.derived import Derived, content_stamp
from fathom.sources.store import Store


def test_derived_table_is_kept_until_its_stamp_changes(spark, tmp_path):
    kept, made = Derived(Store(spark, f"file://{tmp_path}/labels")), []

    def make():
        made.append(1)
        return spark.range(len(made))

    assert kept.read("a") is None
    assert kept.get("a", make).count() == 1 and kept.get("a", make).count() == 1 and len(made) == 1
    assert kept.get("b", make).count() == 2 and kept.read("a") is None


def test_stamp_follows_values_and_not_their_order(spark):
    rows = [(1, 0.5), (2, None), (2, None)]
    a, b = (spark.createDataFrame(r, "idx long, x double") for r in (rows, rows[::-1]))
    assert content_stamp(a, "idx", "x") == content_stamp(b.repartition(3), "idx", "x")
    assert content_stamp(a, "idx", "x") != content_stamp(a.distinct(), "idx", "x")
    assert content_stamp(a.limit(0), "idx", "x") == "0:0:0"


def test_canonical_paths(spark):
    df = spark.createDataFrame([("/a/../../b",), ("a/./b//c",), ("",), (None,), ("..",)], "p string")
    assert [r[0] for r in df.select(m.canonical(F.col("p"))).collect()] == ["/b", "a/b/c", "", None, ""]


def test_preferences_and_tables_without_rows(spark):
    log = spark.createDataFrame([(1, 1, "patch", "k", "a"), (1, 2, "replace", "j", "b"), (1, 2, "replace", "k", "c"), (2, 1, "patch", "k", "a"), (2, 3, "forget", None, None)], "device long, written long, op string, key string, value string")
    assert sorted(map(tuple, up.preference_state(log).collect())) == [(1, "j", "b"), (1, "k", "c")]
    assert up.preference_state(log.limit(0)).count() == 0
    assert up.without_empty(spark.createDataFrame([(1, "", None)], "i int, a string, b string"), ["a", "b"]).columns == ["i"]


def test_hidden_folders(spark):
    files = spark.createDataFrame([("/r/a/x.jpg",), ("/r/b/.c/y.jpg",), ("/r/.d/e/z.jpg",), ("/r/top.jpg",), ("/other/f/g.jpg",)], "path string")
    assert sorted(map(tuple, up.subfolders(files, "/r").collect())) == [("a", False), ("b", False)]
    assert sorted(map(tuple, up.subfolders(files, "/r/", hidden=True).collect())) == [(".d", True), ("a", False), ("b", True)]


@pytest.fixture
def long_ids(spark, tmp_path):
    """Embeddings whose ids have five and six digits, so names are cut: files share names, two of them (10109, 101095) the time too."""
    ids = [10034, 10109, 100341, 100342, 100343, 100348, 101090, 101094, 101095, 101096]
    rows = [(i, [float(i % 7 + 1), float(i % 3)], i % 2) for i in ids]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/parts")
    os.rename(next((tmp_path / "parts").glob("*.parquet")), tmp_path / "embeddings.parquet")
    for t in duck.TABLES:
        if t != "embeddings":
            (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    return str(tmp_path)


def test_frames_of_files_that_share_a_name(spark, long_ids):
    """a changed file's frames are unused, though another file of its name has the time that it had."""
    sql = catalog.oracle_sql()["unused_frames"]
    assert duck.rows_of(catalog.queries()["unused_frames"](spark, long_ids)) == duck.duck_rows(sql, long_ids)
    kept = spark.createDataFrame([(1, "a", 5.0), (2, "a", 6.0), (3, "b", 6.0)], "k long, filename string, mtime double")
    index = spark.createDataFrame([(1, "a", 6.0), (2, "a", 6.0), (3, "b", 7.0)], "k long, filename string, mtime double")
    assert sorted(r["k"] for r in up.unused_frames(kept, index, "k").collect()) == [1, 3]
    assert sorted(r["k"] for r in up.unused_frames(kept, index).collect()) == [1, 3]


def test_rows_of_files_that_share_a_name(spark, long_ids):
    """one position for each row."""
    got = catalog.queries()["row_to_index_lookup"](spark, long_ids).collect()
    assert sorted(r["vec_id"] for r in got) == [10034, 10109, 100341, 100342, 100343, 100348, 101090, 101094, 101095, 101096]
    assert sorted(r["idx"] for r in got) == list(range(10))


def test_files_of_one_name_and_time_are_in_order_of_id(spark, long_ids):
    """positions, and so labels, do not depend on how the rows lie."""
    read = surrogates.table
    for seed in range(6):
        try:
            surrogates.table = lambda *a: read(*a).repartition(3, F.xxhash64("vec_id", F.lit(seed))).sortWithinPartitions(F.xxhash64("vec_id", F.lit(seed)))
            at = {r["vec_id"]: r["idx"] for r in surrogates.media(spark, long_ids).collect()}
        finally:
            surrogates.table = read
        assert at[10034] + 1 == at[100341] and at[10109] + 1 == at[101095]
