"""Searches and labels whose queries or phrases are too many to be broadcast."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators import labels, search, tiles


def frame(spark, v, names="idx long, v array<double>"):
    return spark.createDataFrame([(i, None if x is None else [float(y) for y in x]) for i, x in enumerate(v)], names)


@pytest.mark.parametrize("side", [7, 40, 8192])
def test_tiles_hold_the_best_with_ties_by_item(spark, side):
    rng = np.random.default_rng(side)
    v, q = rng.integers(-2, 3, (90, 3)).astype(float), rng.integers(-2, 3, (30, 3)).astype(float)
    got = tiles.tile_bests(frame(spark, [*q, None], "query long, q array<double>"), frame(spark, [*v, None], "item long, v array<double>"), 4, side=side).collect()
    for k in range(30):
        own = sorted(((-r["score"], r["item"]) for r in got if r["query"] == k))[:4]
        assert own == sorted((-s, i) for i, s in enumerate((v @ q[k]).tolist()))[:4]
    assert {r["query"] for r in got} == set(range(30))


def test_many_queries_equal_few(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((120, 5))
    v[60:] = v[:60]  # every vector twice: ties by position
    rows = frame(spark, v).repartition(5)
    q = rows.where("idx % 3 = 0").select(F.concat(F.lit("q"), "idx").alias("query"), F.col("v").alias("q"))
    few, many = ({(r["query"], r["rank"], r["idx"], round(r["score"], 9)) for r in search.search_batch(rows, q, 5, block=b).collect()} for b in (100, 4))
    assert few == many and len(few) == 40 * 5
    assert search.search_batch(rows, q.limit(0), 5).count() == 0 and search.search_batch(rows.limit(0), q, 5, block=4).count() == 0


def test_a_large_vocabulary_gives_the_same_phrases(spark):
    rng = np.random.default_rng(4)
    vocabulary = frame(spark, rng.standard_normal((50, 4)), "pos long, embedding array<double>").withColumn("phrase", F.concat(F.lit("p"), F.col("pos") % 45))
    vectors = frame(spark, rng.standard_normal((30, 4)), "cluster long, centroid array<double>")
    small, large = (sorted(map(tuple, labels.ranked_phrases(vectors, vocabulary, "cluster", "centroid", 3, few=n).collect())) for n in (50, 49))
    assert small == large and len(small) == 90
