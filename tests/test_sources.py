"""Scans, listings, the versioned store and the ingest stream."""

import pytest
from pyspark.sql import functions as F

from fathom.sources import scan
from fathom.sources.store import Store, load_index, save_index
from fathom.streaming.ingest import ingest, listing_stream


def test_scan_prunes_and_types(spark, tmp_path):
    for p in ("a/one.jpg", "a/.hidden/two.jpg", "a/@eaDir/three.jpg", "b/four.MP4", "b/five.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x" * 10)
    got = {r["path"].rsplit("/", 1)[1]: r["media"] for r in scan.media_files(spark, str(tmp_path)).collect()}
    assert got == {"one.jpg": "image", "four.MP4": "video"}
    with pytest.raises(ValueError):
        scan.media_files(spark, [])


def test_gate_opens_only_the_middle(spark):
    files = spark.createDataFrame([("a", 10, "image"), ("b", 100_000, "image"), ("c", 900_000, "image"), ("d", 10, "video"), ("e", 90_000, "image")], "path string, size long, media string")

    def sizes(df):
        assert df.count() == 2
        side = F.when(F.col("path") == "b", 300).otherwise(100)
        return df.withColumns({"width": side, "height": side})

    ok, bad = scan.gated(files, sizes)
    assert sorted(r["path"] for r in ok.collect()) == ["b", "c", "d"] and sorted(r["path"] for r in bad.collect()) == ["a", "e"]


def test_vocabulary_lines(spark, tmp_path):
    (tmp_path / "v.txt").write_text("# words\nAbbey\n\n  Lake \nabbey\n")
    assert [r[0] for r in scan.vocabulary_lines(spark, str(tmp_path / "v.txt")).collect()] == ["abbey", "lake", "abbey"]


def test_listing(spark):
    class Pages(scan.ListingSource):
        @staticmethod
        def fetch(board, offset, limit):
            names = {"x": [f"{i}.jpg" for i in range(25)], "y": ["ok.jpg", "../up.jpg", "/root.jpg"]}[board]
            return len(names), names[offset : offset + limit]

    class Short(scan.ListingSource):
        @classmethod
        def name(cls):
            return "short"

        @staticmethod
        def fetch(board, offset, limit):
            return 5, ["a.jpg", "b.jpg"][offset : offset + limit]

    spark.dataSource.register(Pages)
    got = spark.read.format("listing").option("boards", "x,y").option("page", "10").load()
    assert got.count() == 26 and scan.ordered_paths(got).count() == 26
    spark.dataSource.register(Short)
    with pytest.raises(Exception, match="2 of 5"):
        spark.read.format("short").option("boards", "z").load().collect()


def test_store_versions_and_stamp(spark, tmp_path):
    store = Store(spark, str(tmp_path / "index"))
    assert not store.exists()
    df = spark.createDataFrame([("a.jpg",)], "path string")
    assert save_index(store, df, "hash:16") == 1
    assert save_index(store, df.union(df), "hash:16") == 2
    assert load_index(store, "hash:16").count() == 2 and store.read(1).count() == 1
    with pytest.raises(ValueError):
        load_index(store, "other:1")
    store.drop()
    assert not store.exists()


def test_ingest_adds_new_files_once(spark, tmp_path):
    store, inbox = Store(spark, str(tmp_path / "index")), str(tmp_path / "inbox")
    schema = "path string, size long, mtime double"

    def arrive(*paths):
        spark.createDataFrame([(p, 1, 1.0) for p in paths], schema).coalesce(1).write.mode("append").parquet(inbox)
        ingest(listing_stream(spark, inbox), store, str(tmp_path / "ck"), lambda df: df.withColumn("v", F.lit(1))).awaitTermination()

    arrive("a.jpg", "b.jpg", "A.jpg")
    assert store.read().count() == 2
    arrive("B.JPG", "c.jpg")
    assert sorted(r["path"].lower() for r in store.read().collect()) == ["a.jpg", "b.jpg", "c.jpg"]


def test_writers_never_share_a_version(spark, tmp_path):
    from fathom.sources.store import Store

    store = Store(spark, f"file://{tmp_path}/s")
    taken = store._claim()  # another writer that is still at work
    assert taken == 1 and store.write(spark.range(3)) == 2 and store.read().count() == 3
    store.append(spark.range(2), "a")
    store.append(spark.range(4), "a")
    assert store.read().count() == 7 and store.read(without="a").count() == 3
    assert store.write(spark.range(1)) == 3 and store.read().count() == 1 and store.read(2).count() == 7
