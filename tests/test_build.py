"""Builds: what is new is encoded once, an interrupted build goes on, another encoder begins anew."""

import os

import pytest
from pyspark.sql import functions as F

from fathom.operators import build as b
from fathom.operators.build import Build
from fathom.operators.encoders import encoded, pca_layout


@pytest.fixture
def counted(monkeypatch, spark):
    """The number of texts that are given to the encoder."""
    total = spark.sparkContext.accumulator(0)

    def counting(rows, spec, text, batch=32):
        total.add(rows.count())
        if broken and total.value > broken[0]:
            raise RuntimeError("stopped")
        return encoded(rows, spec, text, batch)

    broken = []
    monkeypatch.setattr(b, "encoded", counting)
    return total, broken


def listing(spark, names, size=9):
    return spark.createDataFrame([(n, size, float(i)) for i, n in enumerate(names)], "path string, size long, mtime double")


def judge(files):
    return files.where("path NOT LIKE 'small%'"), files.where("path LIKE 'small%'")


def paths(df):
    return sorted(r["path"] for r in df.collect())


def files_under(folder):
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(folder) for f in fs)


def test_build_update_and_nothing_new(spark, tmp_path, counted):
    total, _ = counted
    own = Build(spark, str(tmp_path / "i"), "hash:4", "g1")
    names = [f"p{i}.jpg" for i in range(20)] + ["small.jpg"]
    first = own.run(listing(spark, [*names, "P3.JPG"]), judge)
    assert len(paths(first)) == 20 and total.value == 20 and first.where("size(v) = 4 AND model_id = 'hash:4'").count() == 20
    before = files_under(tmp_path)
    assert len(paths(own.run(listing(spark, names), judge))) == 20
    assert files_under(tmp_path) == before and total.value == 20
    assert len(paths(own.run(listing(spark, names[5:] + ["new.jpg"]), judge))) == 16 and total.value == 21
    assert "small.jpg" in paths(Build(spark, str(tmp_path / "i"), "hash:4", "g2").run(listing(spark, names)))
    assert own.run(listing(spark, [])).count() == 0


def test_interrupted_build_goes_on(spark, tmp_path, counted):
    total, broken = counted
    own = Build(spark, str(tmp_path / "i"), "hash:4")
    files = listing(spark, [f"p{i}.jpg" for i in range(60)])
    broken.append(30)
    with pytest.raises(RuntimeError):
        own.run(files)
    kept = sum(spark.read.parquet(p).count() for p in own._parts())
    assert 0 < kept <= 30 and not own.index.exists()
    os.makedirs(f"{own.work}/half")
    broken.clear()
    seen = total.value
    got = own.run(files)
    assert got.count() == 60 and total.value - seen == 60 - kept and not os.path.exists(own.work)
    whole = {r["path"]: r["v"] for r in encoded(files, "hash:4", "path").collect()}
    assert {r["path"]: r["v"] for r in got.collect()} == whole


def test_another_encoder_begins_anew_and_layout_is_kept(spark, tmp_path, counted):
    total, _ = counted
    files = listing(spark, [f"p{i}.jpg" for i in range(12)])
    one = Build(spark, str(tmp_path / "i"), "hash:4")
    one.run(files)
    assert one.laid_out(pca_layout).count() == 12
    before = files_under(tmp_path / "i" / "layout")
    assert one.laid_out(pca_layout).count() == 12 and files_under(tmp_path / "i" / "layout") == before
    two = Build(spark, str(tmp_path / "i"), "hash:8")
    assert two.current() is None and two.run(files).where(F.size("v") == 8).count() == 12 and total.value == 24
    two.laid_out(pca_layout)
    assert files_under(tmp_path / "i" / "layout") != before
