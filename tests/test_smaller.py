"""Mixed scans, listings against the disk, defaults, prompts and recalls of odd records."""

import json

import pytest
from pyspark.sql import functions as F

from fathom.functions import media
from fathom.functions import metadata as md
from fathom.operators import labels
from fathom.operators import upkeep as up
from fathom.sources import scan


def test_folders_and_single_files(spark, tmp_path):
    for n in ("a/x.jpg", "a/.hidden/y.jpg", "b/z.mp4", "b/w.png", "b/note.txt"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"1")
    at = lambda n: str(tmp_path / n)
    got = scan.media_files(spark, at("a"), [at("b/z.mp4"), at("a/x.jpg"), at("b/note.txt")])
    assert sorted(r["path"].rsplit("/", 1)[-1] for r in got.collect()) == ["x.jpg", "z.mp4"]
    assert scan.media_files(spark, [], [at("b/w.png")]).count() == 1
    for bad in ([], [3]):
        with pytest.raises(ValueError):
            scan.media_files(spark, bad)


def test_listed_files_on_disk(spark):
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    found, missing = scan.on_disk(paths("a", "b", "c", "a"), paths("a", "c", "d"), "root")
    assert sorted(r["path"] for r in found.collect()) == ["a", "a", "c"] and missing == 1
    assert scan.on_disk(paths(), paths("a"), "root")[1] == 0
    with pytest.raises(FileNotFoundError):
        scan.on_disk(paths("a", "b"), paths("c"), "root")


def test_sources_in_a_line():
    assert scan.described(["/a", "/b/c"]) == "/a, /b/c" and scan.described([]) == ""
    assert scan.described([f"/a/b/{i}" for i in range(9)]) == "9 explicit paths under /a/b"
    assert scan.described(["/a", "b", "c", "d"]) == "4 explicit paths under multiple locations"


def test_defaults_of_devices_without_preferences(spark):
    state = spark.createDataFrame([(1, "theme", "light"), (1, "size", "3"), (9, "theme", "x")], "device long, key string, value string")
    devices = spark.createDataFrame([(1,), (2,), (2,)], "device long")
    got = {(r["device"], r["key"], r["value"]) for r in up.with_defaults(state, devices, {"theme": "dark", "wrap": None}).collect()}
    assert got == {(1, "theme", "light"), (1, "size", "3"), (1, "wrap", None), (2, "theme", "dark"), (2, "wrap", None)}


def test_vectors_of_phrases_are_means_of_their_prompts(spark):
    phrases = spark.createDataFrame([("cat", 0), ("{}", 1)], "phrase string, pos long")
    assert {r["prompt"] for r in labels.prompted(phrases.where("pos = 0")).collect()} == {p.format("cat") for p in labels.PROMPTS}
    got = labels.vocabulary_vectors(phrases, "hash:8").collect()
    assert len(got) == 2 and all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-9 for r in got)


def test_filters_and_types(spark):
    df = spark.createDataFrame([("image",), ("video",), (None,)], "k string")
    count = lambda only: df.where(media.shown(F.col("k"), only)).count()
    assert [count(x) for x in ("images", "videos", "both", "later")] == [2, 1, 3, 3]
    assert set(media.VIDEO_TYPES) == set(media.VIDEO_SUFFIXES)


@pytest.mark.parametrize("record, want", [
    ({}, {}),
    ({"metadata_version": 2, "image": {"seed": 4}, "steps": 3}, {"seed": 4}),
    ({"metadata_version": 3, "steps": 3, "width": None, "strength": 1, "loras": [{"lora": {"model_name": "l"}, "weight": 1}, {"weight": 2}]}, {"steps": 3, "loras": [{"model_name": "l", "weight": 1.0}]}),
    ({"metadata_version": 5, "ref_images": [{"config": {"model": {"name": "m"}, "weight": "High"}}, {"config": {}}, {}]}, {"ip_adapters": [{"model_name": "m"}]}),
])
def test_recalls_of_odd_records(spark, record, want):
    got = spark.range(1).select(md.recall_payload(F.parse_json(F.lit(json.dumps(record))))).first()[0]
    assert json.loads(got) == want
