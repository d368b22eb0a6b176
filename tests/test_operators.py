"""Invariants of the operators on small inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fathom.functions import media as m
from fathom.functions import metadata as md
from fathom.functions import text as t
from fathom.operators import components, density, index, map_view, neighbours, sampling, search
from fathom.operators.components import connected_components
from fathom.operators.encoders import build_encoder, encoded, pca_layout
from fathom.plans.scratch import Scratch


def basis(spark):
    e = np.eye(4)
    names = ["img.jpg", "pos.jpg", "neg.jpg", "none.jpg"]
    return spark.createDataFrame([(i, n, [float(x) for x in e[i]]) for i, n in enumerate(names)], "idx long, name string, v array<double>")


def scores(df):
    return {r["idx"]: round(r["score"], 6) for r in df.collect()}


def test_search_combines_scores(spark):
    e = np.eye(4)
    b = basis(spark)
    both = search.search(b, 10, -1, image=e[0], positive=(e[0] + e[1]) / 2)
    assert scores(both) == {0: 0.75, 1: 0.25, 2: 0.0, 3: 0.0}
    less = search.search(b, 10, -1, positive=e[1], negative=e[2], weights=(0.5, 0.5, 0.5))
    assert scores(less) == {0: 0.0, 1: 1.0, 2: -0.5, 3: 0.0}
    assert search.search(b, 10, -1, positive=e[1], weights=(0, 0, 0)).count() == 0
    assert [r["idx"] for r in search.search(b, 2, -1, positive=e[1]).collect()] == [1, 0]


def test_calibration_is_stable_and_for_text_only(spark):
    b = basis(spark)
    s = scores(search.search(b, 10, -1, positive=np.eye(4)[1], scale=6.0, bias=-10.0))
    assert s[1] == pytest.approx(1.0) and s[0] == pytest.approx(1 / (1 + math.exp(10)), abs=1e-6)
    assert scores(search.search(b, 10, -1, image=np.eye(4)[1], scale=6.0))[1] == 1.0


def test_search_batch_equals_single(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((50, 8))
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "idx long, v array<double>")
    q = rows.where("idx % 10 = 0").select(F.col("idx").alias("query"), F.col("v").alias("q"))
    got = {}
    for r in search.search_batch(rows, q, 3, block=2).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["idx"]))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for k, ranks in got.items():
        assert [i for _, i in sorted(ranks)] == np.argsort(-(u @ v[k]))[:3].tolist()


def components_by_hand(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("n,k,seed", [(0, 1, 0), (40, 30, 1), (200, 90, 2), (60, 400, 3)])
def test_components(spark, n, k, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(k), rng.randrange(k)) for _ in range(n)]
    edges = [(u, v) for u, v in edges if u != v]
    df = spark.createDataFrame(edges, "u long, v long").repartition(5)
    got = {r["node"]: r["component"] for r in connected_components(df, Scratch(spark, "t")).collect()}
    assert got == components_by_hand(edges)


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_components_of_a_path_and_a_star(spark, monkeypatch, few):
    """By rounds of stars, and by one task where the counted edges are few."""
    from fathom.operators import components

    monkeypatch.setattr(components, "FEW", few)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 300)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long").repartition(7), Scratch(spark, "t")).collect()}
    assert set(got.values()) == {0, 1000} and len(got) == 601


@pytest.mark.parametrize("threshold,pivots", [(0.95, 5), (0.6, 5), (0.2, 1)])
def test_cosine_pairs(spark, monkeypatch, threshold, pivots):
    monkeypatch.setattr(neighbours, "ROWS_PER_CELL", 200 // pivots)
    monkeypatch.setattr(neighbours, "BLOCK", 30)
    rng = np.random.default_rng(4)
    v = rng.standard_normal((200, 6))
    v[50:60] = v[0] + 0.05 * rng.standard_normal((10, 6))
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "node long, v array<double>")
    got = {(r["u"], r["v"]) for r in neighbours.cosine_pairs(rows, threshold).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    assert got == {(i, j) for i in range(200) for j in range(i + 1, 200) if round(s[i, j], 6) >= threshold}


@pytest.mark.parametrize("block", [1, 2000])
def test_cosines_that_reach_the_threshold_by_rounding(spark, monkeypatch, block):
    """a cosine of 0.3999996 is 0.4 to six digits, one of 0.3999994 is not."""
    monkeypatch.setattr(neighbours, "BLOCK", block)
    angles = [0.0, math.acos(0.3999996), -math.acos(0.3999994), math.pi]
    rows = spark.createDataFrame([(i, [math.cos(a), math.sin(a)]) for i, a in enumerate(angles)], "node long, v array<double>")
    assert [(r["u"], r["v"], r["cosine"]) for r in neighbours.cosine_pairs(rows, 0.40).collect()] == [(0, 1, 0.4)]


def test_rows_travel_once_for_each_block(spark, monkeypatch):
    """a row is in as many tiles as there are blocks, and a task's pairs leave it as one forest."""
    monkeypatch.setattr(neighbours, "TILE", 50)
    made = []
    kind = type(spark.range(1))
    monkeypatch.setattr(kind, "groupBy", lambda df, *keys, group=kind.groupBy: made.append(df) or group(df, *keys))
    rows = spark.range(200).select(F.col("id").alias("node"), F.array(F.lit(1.0), F.col("id") * 1e-6).alias("v"))
    pairs = neighbours.cosine_pairs(rows, 0.4)
    assert pairs.count() == 200 * 199 // 2 and made[-1].count() <= 200 * 8
    forest = pairs.select("u", "v").coalesce(1).mapInArrow(components._forest, "u long, v long")
    assert forest.count() == 199


def test_k_distances_of_crowds_and_copies(spark, monkeypatch):
    """against brute force, with many points at one place, and no rows of pairs of points."""
    rng = np.random.default_rng(7)
    xy = np.concatenate([rng.normal(0, 0.01, (150, 2)), rng.uniform(-5, 5, (60, 2)), np.tile([[1.0, 2.0]], (40, 1)), np.tile([[-3.0, 0.5]], (5, 1))])
    made = []
    table = Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name: made.append(table(self, df, name)) or made[-1])
    monkeypatch.setattr(Window, "partitionBy", lambda *_: pytest.fail("pairs of points are sorted"))
    got = {r["node"]: r["d"] for r in neighbours.k_distances(points_of(spark, [*xy, (float("nan"), 0.0)]), 10).collect()}
    d = np.sort(np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2)), axis=1)[:, 10]
    assert [got.get(i) for i in range(len(xy))] == pytest.approx(d.tolist(), abs=1e-12) and len(got) == len(xy)
    assert max(df.count() for df in made) <= len(xy)


def points_of(spark, xy):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "node long, x double, y double")


def dbscan_by_hand(xy, eps, k):
    n = len(xy)
    near = [[j for j in range(n) if (xy[i][0] - xy[j][0]) ** 2 + (xy[i][1] - xy[j][1]) ** 2 <= eps * eps] for i in range(n)]
    label, c = [-1] * n, 0
    for i in range(n):
        if label[i] != -1 or len(near[i]) < k:
            continue
        stack, label[i] = [i], c
        while stack:
            x = stack.pop()
            if len(near[x]) >= k:
                for y in near[x]:
                    if label[y] == -1:
                        label[y] = c
                        stack.append(y)
        c += 1
    return label


@pytest.mark.parametrize("seed", range(3))
def test_dbscan(spark, seed):
    rng = np.random.default_rng(seed)
    xy = np.concatenate([rng.normal(c, 0.3, (25, 2)) for c in ((0, 0), (3, 0), (0, 3))] + [rng.uniform(-2, 5, (20, 2))])
    got = {r["node"]: r["cluster"] for r in density.dbscan(points_of(spark, xy), 0.4, 5).collect()}
    assert [got[i] for i in range(len(xy))] == dbscan_by_hand(xy, 0.4, 5)


def blobs(n=30, k=5, spread=0.15, scale=1.0, seed=0):
    rng = np.random.default_rng(seed)
    a = 2 * np.pi * np.arange(k) / k
    return np.concatenate([scale * (np.array([3 * np.cos(x), 3 * np.sin(x)]) + spread * rng.standard_normal((n, 2))) for x in a])


def test_adaptive_eps_follows_scale(spark):
    one = density.adaptive_eps(points_of(spark, blobs()), 5)
    ten = density.adaptive_eps(points_of(spark, blobs(scale=10)), 5)
    assert ten == pytest.approx(10 * one, rel=1e-6)
    assert density.top_share(density.dbscan(points_of(spark, blobs()), one, 5)) <= density.LARGEST_SHARE


def test_eps_fallbacks_and_precedence(spark):
    same = points_of(spark, [(0, 0)] * 12)
    assert density.adaptive_eps(same, 5) == density.FALLBACK_EPS
    few = points_of(spark, [(0, 0), (1, 1)])
    assert density.resolved_eps(few, requested=3.0, stored=1.0) == 3.0
    assert density.resolved_eps(few, stored=1.0) == 1.0
    assert density.resolved_eps(few, requested=0.001) == density.resolved_eps(few, stored=0.0) == density.LEAST_EPS
    none = few.limit(0)
    assert density.resolved_eps(none) == density.FALLBACK_EPS and density.resolved_eps(none, requested=9.0) == 9.0
    assert density.within_budget(points_of(spark, blobs()), 100.0, budget=2000) < 100


def test_k_distances(spark):
    xy = np.concatenate([np.random.default_rng(5).normal(0, 1, (80, 2)), [(50, 50), (51, 50)]])
    got = {r["node"]: r["d"] for r in neighbours.k_distances(points_of(spark, xy), 4).collect()}
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    assert [round(got[i], 9) for i in range(len(xy))] == [round(x, 9) for x in np.sort(d, axis=1)[:, 4]]


def fps_by_hand(v, start, k):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    picks, d = [start], 1 - u @ u[start]
    while len(picks) < k:
        picks.append(int(d.argmax()))
        d = np.minimum(d, 1 - u @ u[picks[-1]])
    return picks


def vectors_of(spark, v):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "idx long, v array<double>").repartition(3)


def test_farthest_points(spark, monkeypatch):
    monkeypatch.setattr(sampling, "CANDIDATES", 4)
    monkeypatch.setattr(sampling, "CUT_AT", 3)
    v = np.random.default_rng(6).standard_normal((60, 5))
    rows = vectors_of(spark, v)
    got = sampling.farthest_points(rows, 8, [0, 7]).orderBy("run", "step").collect()
    assert [r["idx"] for r in got if r["run"] == 0] == fps_by_hand(v, 0, 8)
    assert [r["idx"] for r in got if r["run"] == 1] == fps_by_hand(v, 7, 8)
    assert [r["step"] for r in got] == [*range(8), *range(8)]
    assert sampling.farthest_points(rows, 100, [3]).count() == 60


def test_farthest_points_take_few_rounds(spark, monkeypatch):
    rounds = []
    leaders = sampling._leaders
    monkeypatch.setattr(sampling, "_leaders", lambda *a: rounds.append(1) or leaders(*a))
    v = np.random.default_rng(7).standard_normal((3000, 16))
    got = sampling.farthest_points(vectors_of(spark, v), 400, [5, 17]).orderBy("run", "step").collect()
    assert [r["idx"] for r in got] == fps_by_hand(v, 5, 400) + fps_by_hand(v, 17, 400)
    assert len(rounds) <= 40


def test_farthest_points_among_repeated_rows(spark, monkeypatch):
    """Of equal rows the first counts, also where the candidates end within them; corners of a square are exact."""
    monkeypatch.setattr(sampling, "CANDIDATES", 3)
    v = np.array([(1, 0), (0, 1), (-1, 0), (0, -1)] * 8, float)[::-1]
    got = sampling.farthest_points(vectors_of(spark, v), 4, [3]).orderBy("step").collect()
    assert [r["idx"] for r in got] == fps_by_hand(v, 3, 4) == [3, 1, 0, 2]


def test_consensus_orders_ties_by_first_pick(spark):
    picks = spark.createDataFrame([(0, 0, 9), (0, 1, 4), (1, 0, 4), (1, 1, 2)], "run int, step int, idx long")
    got = {r["idx"]: r for r in sampling.consensus(picks, 2, 2).collect()}
    assert got[4]["frequency"] == 100.0 and got[9]["selected"] and not got[2]["selected"]


def test_global_index_and_renumbering(spark):
    rows = spark.createDataFrame([(i, float(i * 7919 % 13), f"f{i:03d}") for i in range(200)], "id long, mtime double, filename string")
    got = [r["id"] for r in index.global_index(rows, ["mtime", "filename"], Scratch(spark, "t")).orderBy("idx").collect()]
    assert got == [i for _, _, i in sorted((float(i * 7919 % 13), f"f{i:03d}", i) for i in range(200))]
    marks = spark.createDataFrame([(i,) for i in (0, 3, 5, 70000, 140000)], "idx long")
    gone = spark.createDataFrame([(i,) for i in (1, 3, 4, 69999, 139999)], "idx long")
    assert {r["idx"]: r["new_idx"] for r in index.renumbered(marks, gone).collect()} == {0: 0, 5: 2, 70000: 69996, 140000: 139995}


def test_diff_ignores_case(spark):
    live = spark.createDataFrame([("A/x.JPG",), ("b.jpg",)], "path string")
    have = spark.createDataFrame([("a/X.jpg",), ("c.jpg",)], "path string")
    assert [r[0] for r in index.new_files(live, have).collect()] == ["b.jpg"]
    assert [r[0] for r in index.missing_files(have, live).collect()] == ["c.jpg"]


def test_walk_and_wrap(spark):
    pts = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 5.0, 0.0), (0, 2, 1.0, 0.0), (0, 3, 2.5, 0.0)], "cluster int, idx long, x double, y double")
    walk = map_view.greedy_walk(pts, spark.createDataFrame([(0, 0)], "cluster int, idx long")).orderBy("step").collect()
    assert [r["idx"] for r in walk] == [0, 2, 3, 1]
    one = spark.range(1).select(map_view.neighbour_in_order(F.lit(0), F.lit(1), 1, True).alias("a"), map_view.neighbour_in_order(F.lit(0), F.lit(5), -1, True).alias("b"), map_view.neighbour_in_order(F.lit(4), F.lit(5), 1, False).alias("c")).first()
    assert tuple(one) == (None, 4, None)


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_scalars(spark):
    assert value(spark, t.duration(F.lit(3725.0))) == "1:02:05" and value(spark, t.duration(F.lit(7.4))) == "0:07" and value(spark, t.duration(F.lit(-1.0))) == "Unknown"
    assert value(spark, t.frames_per_second(F.lit(29.97))) == "29.97 fps" and value(spark, t.frames_per_second(F.lit(30.001))) == "30 fps"
    assert value(spark, t.human_bytes(F.lit(2_500_000_000))) == "2.5 GB"
    assert value(spark, t.phrase(F.lit("  Old_Mill\t House "))) == "old mill house" and value(spark, t.phrase(F.lit("ab"))) is None
    assert value(spark, t.spec_part(F.lit("a:b/c"), "pretrained")) == "c" and value(spark, t.version_tuple(F.lit("2.10rc"))) == [2, 10]
    assert value(spark, t.is_light(F.lit("#ffffff"))) is True
    assert value(spark, m.media_type(F.lit("a/B.MP4"))) == "video" and value(spark, m.media_type(F.lit("x.txt"))) is None
    assert value(spark, m.is_pruned(F.lit("a/.git/x.jpg"))) is True and value(spark, m.is_pruned(F.lit("a/b/x.jpg"))) is False
    assert value(spark, md.decimal_degrees(F.array(F.lit(10.0), F.lit(30.0), F.lit(0.0)), F.lit("W"))) == -10.5
    assert value(spark, md.decimal_degrees(F.array(F.lit(10.0)), F.lit("N"))) is None
    assert value(spark, md.recall_payload(F.parse_json(F.lit('{"metadata_version": 5, "positive_prompt": "p", "seed": 3}')))) == '{"positive_prompt":"p","seed":3}'


def test_encoder_plugin_and_layout(spark):
    rows = spark.createDataFrame([(i, f"text {i % 3}") for i in range(9)], "node long, text string")
    got = encoded(rows, "hash:16", "text").collect()
    assert all(abs(sum(x * x for x in r["v"]) - 1) < 1e-6 and not r["bad"] for r in got) and got[0]["v"] == got[3]["v"]
    with pytest.raises(ValueError):
        build_encoder("nothing:1")
    assert pca_layout(encoded(rows, "hash:16", "text")).count() == 9


def test_the_largest_of_many_landmarks_are_placed(spark):
    from fathom.operators import map_view as mv

    rows = [(i, i, float(i), 0.0, 1 + i) for i in range(250)]
    marks = spark.createDataFrame(rows, "cluster long, idx long, x double, y double, size long").repartition(5)
    assert sorted(r["cluster"] for r in mv.without_overlap(marks, 0.3).collect()) == list(range(232, 250))


def test_search_batch_keeps_the_smallest_ids_among_equals(spark):
    from fathom.operators.search import search_batch

    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(199, -1, -1)]
    index = spark.createDataFrame(rows, "idx long, v array<double>").coalesce(1)
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "query long, q array<double>")
    got = search_batch(index, queries, 5).collect()
    assert {(r["query"], r["rank"], r["idx"]) for r in got} == {(q, k, 2 * (k - 1) + 1 - q) for q in (0, 1) for k in range(1, 6)}


def test_orders_of_large_clusters_are_not_made_in_one_task(spark):
    rng = random.Random(5)
    rows = [(c, i, rng.random(), rng.random()) for c in (0, 1) for i in range(c * 6000, (c + 1) * 6000)]
    points = spark.createDataFrame(rows, "cluster long, idx long, x double, y double").repartition(4)
    starts = spark.createDataFrame([(0, 0), (1, 6000)], "cluster long, idx long")

    def by_distance(c):
        own = [r for r in rows if r[0] == c]
        return [r[1] for r in sorted(own, key=lambda r: (math.hypot(r[2] - own[0][2], r[3] - own[0][3]), r[1]))]

    walk, near = map_view.greedy_walk(points, starts), map_view.proximity_order(points.where("cluster = 1"), 6000)
    for df in (walk, near):  # rows are numbered within ranges only
        plan = df._jdf.queryExecution().analyzed().toString()
        assert plan.count("row_number() windowspecdefinition(") == plan.count("row_number() windowspecdefinition(_range#")
    assert [r["idx"] for r in near.orderBy("step").collect()] == by_distance(1)
    for c in (0, 1):
        own = walk.where(F.col("cluster") == c).orderBy("step").collect()
        assert [r["idx"] for r in own] == by_distance(c) and [r["step"] for r in own] == list(range(6000))


def test_a_derived_radius_is_at_most_a_quarter_of_the_span(spark, monkeypatch):
    from fathom.operators import density

    points = spark.createDataFrame([(i, float(i % 3) * 2, 0.0) for i in range(30)], "node long, x double, y double")
    monkeypatch.setattr(density, "adaptive_eps", lambda *_: 3.0)
    assert density.resolved_eps(points) == 1.0 and density.resolved_eps(points, requested=3.0) == 3.0
    monkeypatch.setattr(density, "adaptive_eps", lambda *_: 0.001)
    assert density.resolved_eps(points) == density.LEAST_EPS


def test_positions_beyond_the_index_are_errors(spark):
    from fathom.operators import index as ix

    own = spark.range(10).withColumnRenamed("id", "idx")
    for bad in (-1, 10):
        with pytest.raises(IndexError):
            ix.deleted(own, spark.createDataFrame([(3,), (bad,)], "idx long"))
        with pytest.raises(IndexError):
            ix.image_info(own, bad)
    assert ix.deleted(own, own.where("idx = 3")).count() == 9 and ix.image_info(own, 3).first()["idx"] == 3


def test_positions_of_stated_rows(spark):
    from fathom.operators import index as ix

    rows = sorted((float(i * 7 % 5), f"f{i * 13 % 40:02d}") for i in range(40))
    df = spark.createDataFrame(rows, "mtime double, filename string").repartition(3)
    asked = [rows[0], rows[17], rows[39]]
    assert {r["_k"]: r["idx"] for r in ix.positions(df, asked, ["mtime", "filename"]).collect()} == {0: 0, 1: 17, 2: 39}
    assert ix.positions(df, [], ["mtime", "filename"]).count() == 0


def test_a_shuffled_round_has_each_row_once(spark):
    """A permutation for any number of rows, the same in both directions, without an exchange; the shown row is not first."""
    from fathom.operators import navigation as nav

    for n in (1, 2, 3, 7, 101, 500, 4097):
        rows = spark.range(n).withColumnRenamed("id", "idx")
        places = [r[0] for r in rows.select(nav.place_in_round(F.col("idx"), n, 5, 2)).collect()]
        assert sorted(places) == list(range(n)) and all(nav.row_in_round(p, n, 5, 2) == i for i, p in enumerate(places))
        first = nav.row_in_round(0, n, 5, 2)
        dealt = nav.shuffled(rows, n, 5, 2, shown=first)
        assert "Exchange" not in dealt._jdf.queryExecution().executedPlan().toString()
        order = [r["idx"] for r in dealt.orderBy("_turn").collect()]
        assert sorted(order) == list(range(n)) and (n == 1 or order[0] != first and order[-1] == first)
        assert n < 7 or places != [r[0] for r in rows.select(nav.place_in_round(F.col("idx"), n, 5, 3)).collect()]
    wide = (1 << 40) + 12345
    far = spark.range(wide - 50, wide).select("id", nav.place_in_round(F.col("id"), wide, 1, 0).alias("p")).collect()
    assert all(0 <= r["p"] < wide and nav.row_in_round(r["p"], wide, 1, 0) == r["id"] for r in far)


def test_texts_of_points(spark):
    from fathom.operators import navigation as nav

    rows = spark.createDataFrame([(0, 9, 4, "abbey"), (1, 9, -1, None), (2, 9, 5, "")], "i int, n int, c int, l string")
    got = [r[0] for r in rows.orderBy("i").select(nav.cluster_text(*map(F.col, ("i", "n", "c", "l")))).collect()]
    assert got == ["1/9 (Cluster 4 · abbey)", "2/9 (unclustered)", "3/9 (Cluster 5)"]


def test_records_are_read_by_kind(spark):
    """Texts that begin like a list or an object are texts."""
    old = F.parse_json(F.lit('{"model_weights": "w", "image": {"prompt": "[cat] sitting", "seed": 1}}'))
    assert value(spark, md.positive_prompt(old)) == "[cat] sitting"
    assert value(spark, md.model_name(F.parse_json(F.lit('{"app_version": "5.0", "model": "{m}"}')))) == "{m}"
    record = F.lit('{"prompt": "[cat] sitting", "seed": 3, "w": 0.5, "none": null, "list": [1], "map": {"a": 1}, "odd": "{x"}')
    assert value(spark, md.flat_scalars(record)) == {"prompt": "[cat] sitting", "seed": "3", "w": "0.5", "none": None, "odd": "{x"}
    assert value(spark, md.is_flat(record)) is False and value(spark, md.is_flat(F.lit('{"prompt": "[cat", "none": null}'))) is True


def test_exif_records_are_parsed_once(spark):
    """a record is read once, however many of its fields are shown."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def said(x):
        seen.add(1)
        return '{"FNumber": 2.8, "ImageWidth": 7, "Make": "m", "GPSAltitude": 3.0}'

    shown = spark.range(0, 5, 1, 1).select(md.exif_table(F.parse_json(said.asNondeterministic()("id"))).alias("t")).collect()
    assert [r["value"] for r in shown[0]["t"]] == ["m", "f/2.8", "7 pixels", "3.0m"] and seen.value == 5
    plan = spark.range(1).select(md.exif_table(F.parse_json(F.concat(F.lit("{"), F.col("id"), F.lit("}")))).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") + plan.lower().count("parsejson") <= 1


def test_exif_numbers_keep_their_point(spark):
    record = F.parse_json(F.lit('{"FNumber": 4.0, "FocalLength": 50, "ExposureTime": 1.0, "GPSAltitude": 12.50, "Flash": 77, "Software": 2.345, "Make": null}'))
    got = {r["label"]: r["value"] for r in value(spark, md.exif_table(record))}
    assert got == {"Camera Make": "N/A", "Software": f"{2.345:.2f}", "Aperture": "f/4.0", "Shutter Speed": "1.0s", "Focal Length": "50mm", "Flash": "Flash Mode 77", "GPS Altitude": "12.5m"}
    for x in (0.25, 1e-3, 1.5e-4, 1e-5, 3e-9, 123456.0, 1e7, 12345678.9, 1e15, 1e16, 3e20, 100.0, 0.0, -7.25e8):
        assert value(spark, md.float_text(F.lit(x))) == repr(x)


def test_report_of_a_video(spark):
    from fathom.functions import probe

    report = "Input #0, ogg,x, from 'a, from b':\r\n  Metadata:\r\n    k : v\r\n\r\n  Duration: N/A, start: 1\n  Stream #0:0: Video: png, 1 fps (attached pic)\n    Metadata:\n      n : Duration: 1:00:00\n  Stream #0:1(eng): Video: vp9 (Profile 0), yuv, 640x480, 29.97 fps, 30 tbr"
    assert tuple(value(spark, probe.probed(F.lit(report)))) == ("ogg,x", None, "vp9", 29.97)
    assert tuple(value(spark, probe.probed(F.lit("nothing of the kind")))) == (None,) * 4
    assert tuple(value(spark, probe.probed(F.lit("  Duration: 01:02:03.5")))) == (None, 3723.5, None, None)
    assert value(spark, probe.report_lines(F.lit(" a\n  Metadata:\n    x\n     Metadata:\n    y\n  b"))) == ["a", "b"]


@pytest.mark.parametrize(
    "old,now",
    [
        ('{"t2iAdapters": [{"t2i_adapter_model": {"n": 1}, "ip_adapter_model": "i"}]}', {"t2iAdapters": [{"t2i_adapter_model": {"n": 1}, "ip_adapter_model": "i", "model": "i"}]}),
        ('{"ipAdapters": [{"model": null, "clip_vision_model": "c"}]}', {"ipAdapters": [{"model": None, "clip_vision_model": "c"}]}),
        ('{"controlnets": [{"begin_step_percent": 0.25, "end_step_percent": 1}]}', {"controlnets": [{"beginEndStepPct": [0.25, 1]}]}),
        ('{"controlnets": [{"beginEndStepPct": [0], "end_step_percent": [0.5, 1]}]}', {"controlnets": [{"beginEndStepPct": [0, 0.5, 1]}]}),
        ('{"controlnets": [{"begin_step_percent": "x", "weight": 2}]}', {"controlnets": [{"weight": 2}]}),
        ('{"ipAdapters": [{"image": {"dataURL": "d", "image_name": "n", "type": "old"}}]}', {"ipAdapters": [{"image": {"dataURL": "d", "image_name": "n", "type": "dataURL"}}]}),
        ('{"ipAdapters": [{"image": {"name": "n"}}, 5, {"image": "n"}, {"image": {"q": 1, "type": "t"}}]}', {"ipAdapters": [{"image": {"name": "n", "type": "file"}}, 5, {"image": "n"}, {"image": {"q": 1, "type": "t"}}]}),
        ('{"other": [{"begin_step_percent": 1}], "ipAdapters": {"begin_step_percent": 1}}', {"other": [{"begin_step_percent": 1}], "ipAdapters": {"begin_step_percent": 1}}),
    ],
)
def test_record_fixups(spark, old, now):
    import json

    from fathom.functions import fixups

    assert json.loads(value(spark, fixups.fixed_record(F.lit(old)))) == now


def test_records_that_need_no_fixing(spark):
    from fathom.functions import fixups

    for same in ('{"b":  [1]}', "[1]", "{}"):
        assert value(spark, fixups.fixed_record(F.lit(same))) == same
    assert value(spark, fixups.fixed_record(F.lit("no json"))) is None
    assert value(spark, fixups.chunk_text(F.unhex(F.lit("61ff62")))) == "a\ufffdb"
    assert value(spark, fixups.first_of(F.array(F.lit("text"), F.lit("en")))) == "text" and value(spark, fixups.first_of(F.array().cast("array<string>"))) == ""
