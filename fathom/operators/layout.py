"""A two-dimensional layout of vectors that keeps neighbourhoods: a neighbour graph, fuzzy weights, and sampled gradient steps.

1. Neighbour graph by NN-descent. Rows first meet in small groups, by the signs of random projections and at random. Then, in
   each round, the neighbours of every row, in both directions, are compared with each other, as far as one of the two links
   is new; a pair goes on only if it beats one row's k-th distance. Rounds end when few links change.
2. Fuzzy weights. A link's weight falls with its distance beyond the row's nearest neighbour, on a scale at which a row's
   weights sum to log2(k). Both directions are joined as the union of fuzzy sets.
3. Layout. From the first two principal components, rows are numbered along x or y in turn and cut into blocks of BLOCK rows.
   A block takes gradient steps on the links of its rows, sampled by weight: links pull, random rows push. Ends that lie in
   other blocks stay where they were at the start of the round, as does the bounded sample of all rows that pushes.

No step compares all rows, and a task holds one block: its rows, at most k links of each, and the sample. All choices come
from hashes of row numbers and a seed, and what is summed in no fixed order is rounded, so a seed gives one layout. Rows
without structure have no neighbourhoods to keep, and their layout is no better than their principal components.

Defined cases: rows with a null id or vector take no part; vectors without length are as far from all others as orthogonal
ones; fewer than 3 rows give an empty layout; ids are to be unique.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.operators.index import global_index
from fathom.plans.scratch import Scratch

#: Fixed values of the layout.
NEIGHBOURS = 15
MIN_DIST = 0.05

GROUP = 128
TABLES = 4
ROUNDS = 12
ENOUGH = 0.005
WORK_GROUP = 256
BLOCK = 4096
SAMPLE = 2048
NEGATIVES = 5
STEPS = 25
PARTS = 8  # of a step's links, taken one after the other, so that a row answers to few links at once
LAYOUT_ROUNDS = 10
REACH = 10.0


def _floats(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float32).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1), np.float32)


def _distance(x: np.ndarray) -> np.ndarray:
    """Cosine distances of unit rows, to a digit that does not depend on the rows' number or order."""
    return np.round(np.maximum(0, 1 - x.astype(np.float64) @ x.T), 7)


def _links(u, v, d) -> pa.Table:
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "d": pa.array(d, pa.float64())})


def _nearest(k: int):
    """The k nearest rows of each row of a group."""

    def over(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        node, x = t.column("node").to_numpy(), _floats(t.column("v"))
        d = _distance(x)
        np.fill_diagonal(d, np.inf)
        m = min(k, len(node) - 1)
        near = np.argsort(d, axis=1, kind="stable")[:, :m]
        rows = np.repeat(np.arange(len(node)), m)
        return _links(node[rows], node[near.ravel()], d[rows, near.ravel()])

    return over


def _best(links: DataFrame, k: int) -> DataFrame:
    """The k nearest of each row; new is false for links that were there before. Links go to their row in one exchange."""
    one = links.repartition("u").groupBy("u", "v").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    return one.withColumn("_r", F.row_number().over(Window.partitionBy("u").orderBy("d", "v"))).where(F.col("_r") <= k).drop("_r")


def _first(u: np.ndarray, v: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each u the k nearest v, each once. What is left out is behind k others wherever it is compared with more."""
    order = np.lexsort((d, v, u))
    u, v, d = u[order], v[order], d[order]
    once = np.ones(len(u), bool)
    once[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    u, v, d = u[once], v[once], d[once]
    order = np.lexsort((v, d, u))
    u, v, d = u[order], v[order], d[order]
    at = np.arange(len(u))
    start = np.maximum.accumulate(np.where(np.append(True, u[1:] != u[:-1])[: len(u)], at, 0))
    kept = at - start < k
    return u[kept], v[kept], d[kept]


def _local(t: pa.Table, k: int) -> pa.Table:
    """Pairs among the neighbours of each row of a group, where they beat what one of them has: of each row the k nearest."""
    t = t.sort_by([("w", "ascending"), ("x", "ascending")])
    w, x, new, most = (t.column(c).to_numpy(zero_copy_only=False) for c in ("w", "x", "new", "most"))
    v = _floats(t.column("v"))
    ends = np.flatnonzero(np.append(w[1:] != w[:-1], True)) + 1 if len(w) else []
    us, vs, ds, a = [], [], [], 0
    for b in ends:
        d = _distance(v[a:b])
        i, j = np.nonzero((d < most[a:b, None]) & (new[a:b, None] | new[None, a:b]) & ~np.eye(b - a, dtype=bool))
        us.append(x[a:b][i])
        vs.append(x[a:b][j])
        ds.append(d[i, j])
        a = b
    return _links(*_first(*(np.concatenate(c) for c in (us, vs, ds)), k)) if us else _links([], [], [])


def neighbour_graph(rows: DataFrame, scratch: Scratch, k: int = NEIGHBOURS, seed: int = 0, node: str = "node", vector: str = "v") -> DataFrame:
    """(u, v, d): about the k nearest other rows of each row by cosine distance. rows: node (long), v."""
    own = rows.where(F.col(node).isNotNull() & F.col(vector).isNotNull()).select(F.col(node).cast("long").alias("node"), F.col(vector).cast("array<double>").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, y: acc + y * y)) + 1e-12
    own = own.withColumn("_n", norm).select("node", F.transform("v", lambda y: (y / F.col("_n")).cast("float")).alias("v"))
    own = scratch.table(own, "unit")
    n, dim = own.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return rows.sparkSession.createDataFrame([], "u long, v long, d double")
    k = min(k, n - 1)
    bits = max(0, round(math.log2(n / GROUP)))
    planes = np.random.default_rng(seed).normal(size=(TABLES, max(1, bits), max(1, dim or 1))).astype(np.float32)

    def signs(batches):
        for b in batches:
            x = _floats(b.column(1))
            for t in range(TABLES):
                key = ((x @ planes[t, :bits].T > 0) << np.arange(bits)).sum(axis=1) if bits and len(x) else np.zeros(b.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.full(b.num_rows, t, np.int32)), pa.array(key.astype(np.int64))], names=["node", "v", "t", "key"])

    placed = own.mapInArrow(signs, "node long, v array<float>, t int, key long")
    at_random = own.select("node", "v", F.lit(TABLES).alias("t"), F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(math.ceil(n / GROUP))).alias("key"))
    placed = scratch.table(placed.unionByName(at_random), "placed")
    sizes = placed.groupBy("t", "key").agg(F.ceil(F.count("*") / (2 * GROUP)).alias("_parts"))
    split = placed.join(sizes, ["t", "key"]).withColumn("_part", F.pmod(F.xxhash64("node", "t", F.lit(seed)), "_parts"))
    graph = split.groupBy("t", "key", "_part").applyInArrow(_nearest(k), "u long, v long, d double")
    graph = scratch.table(_best(graph.withColumn("new", F.lit(True)), k), "graph")
    groups = max(1, n // WORK_GROUP)
    for _ in range(ROUNDS):
        both = graph.select(F.col("u").alias("w"), F.col("v").alias("x"), "new").union(graph.select(F.col("v").alias("w"), F.col("u").alias("x"), "new"))
        both = both.repartition("w").groupBy("w", "x").agg(F.max("new").alias("new"))
        first = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("new"), F.xxhash64("x", "w", F.lit(seed))))
        any_new = F.max("new").over(Window.partitionBy("w"))  # rows that have none make no pairs
        both = both.withColumns({"_r": first, "_any": any_new}).where((F.col("_r") <= 2 * k) & F.col("_any")).drop("_r", "_any")
        most = graph.groupBy("u").agg(F.max("d").alias("_d"), F.count("*").alias("_c")).select("u", F.when(F.col("_c") < k, float("inf")).otherwise(F.col("_d")).alias("_most"))
        held = own.join(most, F.col("node") == F.col("u"), "left").select("node", "v", F.coalesce("_most", F.lit(float("inf"))).alias("most"))
        met = both.join(held, F.col("x") == F.col("node")).select("w", "x", "new", "most", "v", F.pmod(F.xxhash64("w"), F.lit(groups)).alias("_g"))
        found = met.groupBy("_g").applyInArrow(lambda t: _local(t, k), "u long, v long, d double")
        after = _best(graph.withColumn("new", F.lit(False)).union(found.select("u", "v", "d", F.lit(True).alias("new"))), k)
        before, graph = graph, scratch.table(after, "graph")
        changed = graph.where("new").count()
        scratch.drop(before)
        if changed <= ENOUGH * n * k:
            break
    return graph.select("u", "v", "d")


def memberships(distances: np.ndarray, k: int) -> np.ndarray:
    """Weights of each row's links (rows of ascending distances, padded with inf), summing to log2(k) where they can."""
    d = np.where(np.isfinite(distances), distances, np.inf)
    known = np.isfinite(d)
    rho = np.where((d > 0) & known, d, np.inf).min(axis=1, initial=np.inf)
    rho = np.where(np.isfinite(rho), rho, 0)[:, None]
    beyond = np.where(known, np.maximum(0, np.where(known, d, 0) - rho), np.inf)
    lo, hi = np.zeros((len(d), 1)), np.full((len(d), 1), np.inf)
    scale, want = np.ones((len(d), 1)), math.log2(max(k, 2))
    for _ in range(64):
        total = np.exp(-beyond / scale).sum(axis=1, keepdims=True)
        high = total > want
        hi, lo = np.where(high, scale, hi), np.where(high, lo, scale)
        scale = np.where(np.isfinite(hi), (lo + hi) / 2, scale * 2)
        scale = np.minimum(scale, 1e12)
    mean = np.where(known, np.where(known, d, 0), 0).sum(axis=1, keepdims=True) / np.maximum(1, known.sum(axis=1, keepdims=True))
    return np.exp(-beyond / np.maximum(scale, 1e-3 * mean + 1e-12))


def fuzzy_links(graph: DataFrame, k: int) -> DataFrame:
    """(u, v, w): the graph's links with the weight of the union of both directions; one-sided links count twice."""

    def weigh(batches):
        for b in batches:
            if not b.num_rows:
                continue
            near = b.column(1).to_pylist()
            width = max(len(x) for x in near)
            d = np.full((len(near), width), np.inf)
            for row, x in zip(d, near):
                row[: len(x)] = [y["d"] for y in x]
            a = memberships(d, k)
            u = np.repeat(b.column(0).to_numpy(), [len(x) for x in near])
            v = [y["v"] for x in near for y in x]
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v, pa.int64()), pa.array(np.round(a[np.isfinite(d)], 7))], names=["u", "v", "a"])

    one = graph.groupBy("u").agg(F.sort_array(F.collect_list(F.struct("d", "v"))).alias("near")).mapInArrow(weigh, "u long, v long, a double")
    back = one.select(F.col("v").alias("_u"), F.col("u").alias("_v"), F.col("a").alias("b"))
    both = one.join(back, (F.col("u") == F.col("_u")) & (F.col("v") == F.col("_v")), "left")
    return both.select("u", "v", F.when(F.col("b").isNull(), 2 * F.col("a")).otherwise(F.col("a") + F.col("b") - F.col("a") * F.col("b")).alias("w"))


def curve(min_dist: float = MIN_DIST, spread: float = 1.0) -> tuple[float, float]:
    """a, b of 1 / (1 + a x^2b), fitted to 1 up to min_dist and an exponential fall beyond, by Gauss-Newton steps."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    p = np.array([0.0, 0.0])  # logarithms

    def off(p):
        return 1 / (1 + np.exp(p[0]) * x ** (2 * np.exp(p[1]))) - y

    for _ in range(100):
        r = off(p)
        jac = np.stack([(off(p + h) - r) / 1e-6 for h in np.eye(2) * 1e-6], axis=1)
        step = np.linalg.lstsq(jac, -r, rcond=None)[0]
        while np.abs(step).max() > 1e-12 and (off(p + step) ** 2).sum() > (r**2).sum():
            step = step / 2
        p = p + step
    return float(np.exp(p[0])), float(np.exp(p[1]))


def _steps(a: float, b: float, sample: np.ndarray, first: int, total: int, seed: int, most: float):
    """STEPS gradient steps on a block. Its rows: node, x, y and links (v, w, x, y)."""

    def over(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        node = t.column("node").to_numpy()
        at = np.stack([t.column("x").to_numpy(), t.column("y").to_numpy()], axis=1).astype(np.float64)
        links = t.column("links").combine_chunks()
        head = np.repeat(np.arange(len(node)), links.value_lengths().fill_null(0).to_numpy())
        flat = links.flatten()
        v, w = flat.field("v").to_numpy(), flat.field("w").to_numpy()
        far = np.stack([flat.field("x").to_numpy(), flat.field("y").to_numpy()], axis=1)
        order = np.lexsort((v, head))
        head, v, w, far = head[order], v[order], w[order], far[order]
        tail = np.searchsorted(node, v)
        inside = (tail < len(node)) & (node[np.minimum(tail, len(node) - 1)] == v)
        tail = np.where(inside, tail, 0)
        g = np.random.default_rng((seed, first, int(node[0]) & 0x7FFFFFFF))
        for step in range(first, first + STEPS):
            alpha = 1 - step / total
            drawn = np.flatnonzero(g.random(len(w)) * most < w)
            for on in np.array_split(g.permutation(drawn), PARTS):
                h, own = head[on], inside[on]
                gap = at[h] - np.where(own[:, None], at[tail[on]], far[on])
                d2 = (gap**2).sum(axis=1)
                pull = np.where(d2 > 0, -2 * a * b * np.maximum(d2, 1e-12) ** (b - 1) / (1 + a * d2**b), 0)
                move = np.clip(pull[:, None] * gap, -4, 4) * alpha
                gap = at[h][:, None] - sample[g.integers(0, len(sample), (len(h), NEGATIVES))]
                d2 = (gap**2).sum(axis=2)
                force = 2 * b / ((0.001 + d2) * (1 + a * d2**b))
                push = np.where(d2[..., None] > 0, np.clip(force[..., None] * gap, -4, 4), 0).sum(axis=1) * alpha
                for axis in (0, 1):
                    at[:, axis] += np.bincount(h, (move + push)[:, axis], len(at)) - np.bincount(tail[on][own], move[own][:, axis], len(at))
        return pa.table({"node": pa.array(node), "x": pa.array(at[:, 0]), "y": pa.array(at[:, 1])})

    return over


def neighbour_layout(rows: DataFrame, k: int = NEIGHBOURS, min_dist: float = MIN_DIST, seed: int = 0, node: str = "node", vector: str = "v", block: int = BLOCK, rounds: int = LAYOUT_ROUNDS) -> DataFrame:
    """(node, x, y) of every row; empty for fewer than 3 rows."""
    from fathom.operators.encoders import pca_layout

    spark = rows.sparkSession
    scratch = Scratch(spark, "layout", tidy=True)
    own = scratch.table(rows.where(F.col(node).isNotNull() & F.col(vector).isNotNull()).select(F.col(node).cast("long").alias("node"), F.col(vector).alias("v")), "rows")
    n = own.count()
    if n < 3:
        return spark.createDataFrame([], "node long, x double, y double")
    k = min(k, n - 1)
    links = scratch.table(fuzzy_links(neighbour_graph(own, scratch, k, seed), k), "links")
    most = links.agg(F.max("w")).first()[0]
    at = scratch.table(pca_layout(own, "node", "v"), "start")
    reach = at.agg(F.greatest(F.max(F.abs("x")), F.max(F.abs("y")))).first()[0] or 1.0
    jitter = lambda i: (F.pmod(F.xxhash64("node", F.lit(seed), F.lit(i)), F.lit(1 << 20)) / float(1 << 20) - 0.5) * 1e-3
    at = scratch.table(at.select("node", (F.round(F.col("x") * REACH / reach, 4) + jitter(0)).alias("x"), (F.round(F.col("y") * REACH / reach, 4) + jitter(1)).alias("y")), "at")
    a, b = curve(min_dist)
    for r in range(rounds):
        picks = at.orderBy(F.xxhash64("node", F.lit(seed), F.lit(r)), "node").limit(SAMPLE).select("x", "y").collect()
        sample = np.array([[p["x"], p["y"]] for p in picks])
        ordered = global_index(at, ["xy"[r % 2], "node"], scratch, "_i").select("node", "x", "y", F.expr(f"_i div {block}").alias("_block"))
        ends = at.select(F.col("node").alias("_v"), F.col("x").alias("_x"), F.col("y").alias("_y"))
        listed = links.join(ends, F.col("v") == F.col("_v")).groupBy("u").agg(F.collect_list(F.struct("v", "w", F.col("_x").alias("x"), F.col("_y").alias("y"))).alias("links"))
        held = ordered.join(listed, F.col("node") == F.col("u"), "left").select("_block", "node", "x", "y", "links")
        moved = held.groupBy("_block").applyInArrow(_steps(a, b, sample, r * STEPS, rounds * STEPS, seed, most), "node long, x double, y double")
        before, at = at, scratch.table(moved, "at")
        scratch.drop(before)
    return at
