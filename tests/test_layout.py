"""Density clusters of crowded areas, pair budgets by bounds, and the layout by neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import dbscan_by_hand, points_of

from fathom.operators import density, layout
from fathom.operators.encoders import pca_layout
from fathom.plans.scratch import Scratch

EPS = 0.1


def crowded(gap):
    """Two crowds of 400 points that are gap apart, and some loose points."""
    g = np.random.default_rng(4)
    a, b, c = g.uniform(0, 0.06, (400, 2)), g.uniform(0, 0.06, (400, 2)), g.uniform(-1, 1, (60, 2))
    return np.concatenate([a, b + [0.06 + gap, 0], c])


def pairs_by_hand(xy, eps):
    dx, dy = (xy[:, None, i] - xy[None, :, i] for i in (0, 1))
    return int((dx * dx + dy * dy <= eps * eps).sum())


@pytest.mark.parametrize("gap", [0.0985, 0.1004])
def test_crowded_squares_are_settled_by_boxes(spark, gap):
    """Crowds just within reach of each other and just not: cells in doubt are cut, and few rows are written on the way."""
    xy = crowded(gap)
    points = points_of(spark, xy).repartition(3)
    got = {r["node"]: r["cluster"] for r in density.dbscan(points, EPS, 8).collect()}
    assert [got[i] for i in range(len(xy))] == dbscan_by_hand(xy, EPS, 8)


def test_points_without_place_are_noise(spark):
    df = spark.createDataFrame([(i, 0.0, 0.0) for i in range(5)] + [(5, None, 0.0), (6, float("nan"), 0.0), (7, float("inf"), 1.0)], "node long, x double, y double")
    assert {r["node"]: r["cluster"] for r in density.dbscan(df, 1.0, 3).collect()} == {**dict.fromkeys(range(5), 0), 5: -1, 6: -1, 7: -1}
    assert density.dbscan(df.limit(0), 1.0, 3).count() == 0


def test_pair_budget_by_bounds(spark):
    xy = crowded(0.09)
    points = points_of(spark, xy).repartition(3)
    n = pairs_by_hand(xy, EPS)
    (lower, upper), (low2, up2) = density.pair_bounds(points, [EPS, EPS / 2])
    assert lower <= n <= upper and low2 <= pairs_by_hand(xy, EPS / 2) <= up2 < upper
    assert not density.exceeds(points, EPS, n) and density.exceeds(points, EPS, n - 1)
    for budget in (n - 1, n // 3):
        eps = EPS
        while eps > density.GIVE_UP_EPS and pairs_by_hand(xy, eps) > budget:
            eps *= density.SHRINK
        assert density.within_budget(points, EPS, budget) == eps
    assert density.within_budget(points.limit(0), EPS, 5) == EPS


def test_a_radius_does_not_shrink_with_the_number_of_points(spark):
    """four crowds of 3,600 points at one place each have 51,840,000 pairs at any radius, and still the radius of few."""
    crowds = spark.range(14_400).select(F.col("id").alias("node"), (F.col("id") % 2 * 10.0).alias("x"), (F.floor(F.col("id") / 2) % 2 * 10.0).alias("y"))
    few = crowds.where("node < 80")
    assert density.resolved_eps(crowds, requested=3.0) == 3.0
    assert density.resolved_eps(crowds) == density.resolved_eps(few) == density.FALLBACK_EPS


def sheets(n=500):
    """Rows on twelve bent sheets in 24 dimensions."""
    g = np.random.default_rng(1)
    at, flat, plane = g.integers(0, 12, n), g.normal(size=(n, 2)), g.normal(size=(12, 2, 24))
    return g.normal(size=(12, 24))[at] * 1.5 + np.einsum("ni,nij->nj", flat, plane[at]) * 0.5 + g.normal(size=(n, 24)) * 0.1


def rows(spark, v, parts=3):
    return spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "node long, v array<double>").repartition(parts)


def cosine_ranks(v):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1), np.argsort(np.argsort(d, axis=1), axis=1) + 1


def trustworthiness(v, xy, k=12):
    n, ranks = len(v), cosine_ranks(v)[1]
    e = ((xy[:, None] - xy[None]) ** 2).sum(axis=2)
    np.fill_diagonal(e, np.inf)
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(0, np.take_along_axis(ranks, np.argsort(e, axis=1)[:, :k], 1) - k).sum()


def test_neighbour_graph(spark, monkeypatch):
    """NN-descent finds nearly all true neighbours from small groups; with copies of one row it still ends with k links each."""
    monkeypatch.setattr(layout, "GROUP", 24)
    v = sheets()
    near = cosine_ranks(v)[0][:, :10]
    got = {(r["u"], r["v"]) for r in layout.neighbour_graph(rows(spark, v), Scratch(spark, "t"), 10).collect()}
    assert len(got) == 10 * len(v) and np.mean([(i, j) in got for i in range(len(v)) for j in near[i]]) > 0.95
    v[:170] = v[0]
    links = layout.neighbour_graph(rows(spark, v), Scratch(spark, "t"), 10)
    assert links.groupBy("u").count().agg(F.min("count"), F.max("count")).first() == (10, 10)


def test_weights_and_curve():
    assert layout.curve(0.1) == pytest.approx((1.577, 0.8951), abs=2e-3)
    d = np.sort(np.random.default_rng(0).uniform(0.1, 1, (40, 15)), axis=1)
    assert layout.memberships(d, 15).sum(axis=1) == pytest.approx(np.log2(15)) and (layout.memberships(d, 15)[:, 0] == 1).all()
    assert np.isfinite(layout.memberships(np.zeros((2, 5)), 5)).all()


def test_layout_keeps_neighbours(spark):
    """In one block and in several; better than principal components; one seed gives one layout, however the rows lie."""
    v = sheets(360)
    xy = {}
    for block, parts in ((4096, 3), (125, 3), (125, 7)):
        got = layout.neighbour_layout(rows(spark, v, parts), block=block, rounds=4, seed=3).orderBy("node").collect()
        xy[block, parts] = np.array([[r["x"], r["y"]] for r in got])
    plain = np.array([[r["x"], r["y"]] for r in pca_layout(rows(spark, v)).orderBy("node").collect()])
    assert min(trustworthiness(v, x) for x in xy.values()) > max(0.95, trustworthiness(v, plain))
    assert np.abs(xy[125, 3] - xy[125, 7]).max() < 1e-6


def test_layout_of_few_rows(spark):
    assert layout.neighbour_layout(rows(spark, sheets(2))).count() == 0
    odd = rows(spark, sheets(4)).union(spark.createDataFrame([(None, [1.0] * 24), (9, None)], "node long, v array<double>"))
    got = layout.neighbour_layout(odd, rounds=1).collect()
    assert sorted(r["node"] for r in got) == [0, 1, 2, 3] and all(np.isfinite([r["x"], r["y"]]).all() for r in got)


def test_a_group_hands_out_the_nearest_of_each_row_once():
    """F8: what a group finds is cut to k of each row before it travels; the k nearest over all groups stay the same."""
    g = np.random.default_rng(2)

    def nearest(u, v, d, k):
        best = {}
        for a, b, x in zip(u.tolist(), v.tolist(), d.tolist()):
            best[a, b] = min(x, best.get((a, b), 9))
        return {(a, b, x) for a in set(u.tolist()) for x, b in sorted((x, b) for (c, b), x in best.items() if c == a)[:k]}

    groups = [(g.integers(0, 20, 400), g.integers(0, 50, 400), np.round(g.random(400), 1)) for _ in range(3)]
    cut = [layout._first(*x, 5) for x in groups]
    assert all(np.unique(u, return_counts=True)[1].max() <= 5 for u, _, _ in cut)
    assert nearest(*map(np.concatenate, zip(*cut)), 5) == nearest(*map(np.concatenate, zip(*groups)), 5)
    assert [len(x) for x in layout._first(np.zeros(0, int), np.zeros(0, int), np.zeros(0), 5)] == [0, 0, 0]


def test_links_go_to_their_row_in_one_exchange(spark):
    links = spark.createDataFrame([(1, 2, 0.5, True), (1, 2, 0.5, False), (1, 3, 0.1, True)], "u long, v long, d double, new boolean")
    best = layout._best(links, 1)
    assert best._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert [tuple(r) for r in best.collect()] == [(1, 3, 0.1, True)]
