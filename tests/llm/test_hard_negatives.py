import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.llm import hard_negatives as hn
from fathom.plans.scratch import Scratch

SCHEMA = "vec_id long, embedding array<float>, label int, aid long, n long, score string"
OUT = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows, positives=5, negatives=3, low=50, high=95):
    """(id, label, vector of ints) rows."""
    out = []
    for a, la, va in rows:
        if a % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(va, v)), i, lab == la) for i, lab, v in rows if i != a]
        for p, i, _ in sorted(x for x in scored if x[2])[:positives]:
            far = sorted(x for x in scored if not x[2] and low * -p <= 100 * -x[0] <= high * -p)[:negatives]
            out += [(a, i, r + 1, j, -p, -s) for r, (s, j, _) in enumerate(far)]
    return sorted(out)


def ints(rows):
    good = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * float(x)) for x in v]) for i, v, lab in rows if None not in (i, v, lab) and all(x is not None and math.isfinite(x) for x in v)]
    return good


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, lab, 1, 2, "x") for i, v, lab in rows], SCHEMA).repartition(parts)


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*OUT).collect())


def vectors(n, dim, seed, copies=0):
    g = np.random.default_rng(seed)
    v = np.float32(g.normal(size=(n, dim)) + 0.6)
    v[-copies or n :] = v[1]
    return [(i, [float(x) for x in v[i]], int(g.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize("copies", [0, 250])
def test_equals_brute_force(spark, copies):
    """Also where two thirds of the rows are one vector, so that scores tie far beyond k."""
    rows = vectors(380, 6, 3, copies)
    df = frame(spark, rows)
    want = brute(ints(rows))
    assert want and rows_of(hn.mined(df)) == want
    plain = hn.usable(df, "vec_id", "embedding", "label").select("id", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), F.transform("vector", lambda x: F.floor(256.0 * x.cast("double"))).alias("vector"))
    got = rows_of(hn.hard_negatives(plain, F.col("id") % 50 == 0, 7, 2, 20, 120, buckets=50))
    assert got == brute(ints(rows), 7, 2, 20, 120)


def test_defined_cases(spark):
    rows = vectors(120, 4, 5)
    odd = [(None, [1.0] * 4, 1), (400, None, 1), (401, [1.0, None, 1.0, 1.0], 1), (402, [float("nan")] * 4, 1), (403, [float("inf")] * 4, 1), (404, [1.0] * 4, None), (500, [], 2), (501, [2.0], 2), (-50, [1.0, 2.0], 1), (-49, [9.0] * 4, 0)]
    df = frame(spark, rows + odd)
    assert rows_of(hn.mined(df)) == brute(ints(rows + odd))
    assert hn.mined(df.limit(0)).count() == 0
    assert hn.mined(frame(spark, [(1, [1.0], 1), (2, [1.0], 2)])).count() == 0
    assert hn.mined(frame(spark, [(50, [1.0], 1)])).count() == 0
    twice = rows_of(hn.mined(frame(spark, rows + [(3, *rows[3][1:])])))
    assert {x[:2] for x in twice} >= {x[:2] for x in brute(ints(rows))} - {(a, i) for a, i, *_ in brute(ints(rows))}
    with pytest.raises(ValueError, match="2\\*\\*56"):
        hn.mined(frame(spark, [(50, [3e30], 1), (51, [1.0], 1)]))


def test_exact_beyond_doubles(spark):
    """Sums that pass 2**53 are multiplied as integers."""
    big = 1 << 26
    rows = [(i, i % 2, [big + i, big - 3 * i, i]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, label long, vector array<long>")
    assert rows_of(hn.hard_negatives(df, F.col("id") % 50 == 0, 4, 3, 10, 100)) == brute(rows, 4, 3, 10, 100)


def test_ranges_narrow_digit_by_digit(spark):
    """With few buckets each pass cuts the open range by their number; counts written are k for each tile and window at most."""
    rows = vectors(200, 3, 9, 120)
    scratch = Scratch(spark, "test")
    df = spark.createDataFrame(ints(rows), "id long, label long, vector array<long>").repartition(2)
    s = hn._Selection(df, F.col("id") % 50 == 0, scratch, 8)
    state = s.anchors.selectExpr("aid", "0 AS w", "true AS same", "CAST(5 AS long) AS k", f"CAST({s.reach} AS long) AS top", f"CAST(-{s.reach} AS long) AS lo", f"CAST({s.reach} AS long) AS hi", "CAST(NULL AS long) AS at", "CAST(0 AS long) AS above", "false AS done")
    spans = []
    while not state.where("NOT done").isEmpty():
        spans.append({r["aid"]: (r["at"] is not None, r["hi"] - r["lo"] + 1) for r in state.where("NOT done").collect()})
        counts = scratch.table(s.tiles(state.where("NOT done"), hn._counts, "aid long, w int, bucket long, n long"), "c")
        assert counts.groupBy("aid", "w").count().agg(F.max("count")).first()[0] <= 5 * s.n_blocks
        state = scratch.table(s.narrowed(state, counts), "s")
    for before, after in zip(spans, spans[1:]):
        for aid, (ids, span) in after.items():
            assert ids != before[aid][0] or span <= -(-before[aid][1] // 8)
    assert any(ids for ids, _ in spans[-1].values())
