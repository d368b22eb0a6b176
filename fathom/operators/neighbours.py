"""Similarity and range joins without comparing all rows with all.

Vectors: cells around pivots. A row's home is its nearest pivot; it also visits every cell that is at most twice the radius
farther from it, so two rows within the radius always meet in both homes, and a pair is given in the home of its smaller id.
Cells are cut into blocks, so a crowded cell is many tasks. Where there are few rows, or a sample shows that pivots would copy
rows more often than plain blocks of all rows do (wide radii, many dimensions), the rows meet in such blocks: all pairs are
compared, but a row travels once for each TILE rows, and a task holds two blocks. Points: a grid of squares as wide as the radius, joined on equal
squares with the eight around them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.plans.scratch import Scratch

ROWS_PER_CELL = 2000
MOST_PIVOTS = 256
BLOCK = 2000
TILE = 32768
TILES = 8
COPIES = 16
SLICE = 256
SAMPLE = 512
NARROW = 2
COMPARED = 1_000_000


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    v = np.asarray(flat.flatten(), np.float64)
    return v.reshape(len(flat), -1) if len(flat) else v.reshape(0, 0)


def cosine_pairs(rows: DataFrame, threshold: float, node: str = "node", vector: str = "v", digits: int = 6) -> DataFrame:
    """(u, v, cosine) of all pairs u < v with cosine at the threshold or above; rows: node (long) and a vector."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "pairs")
    own = scratch.table(rows.select(F.col(node).cast("long").alias("node"), F.col(vector).cast("array<double>").alias("v")), "vectors")
    n = own.count()
    if not n:
        return spark.createDataFrame([], "u long, v long, cosine double")
    blocks = max(math.ceil(n / TILE), min(math.ceil(n / BLOCK), TILES))
    least = threshold - 0.5 * 10.0**-digits - 1e-9  # a cosine just under the threshold can reach it by rounding
    radius = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
    few = min(MOST_PIVOTS, n // ROWS_PER_CELL)
    picks = own.orderBy(F.xxhash64("node")).limit(few + SAMPLE).collect() if few > 1 else []
    sample = np.array([r["v"] for r in picks], np.float64)
    pivots = sample[:few]
    if few > 1:
        sample /= np.linalg.norm(sample, axis=1, keepdims=True) + 1e-12
        d = np.sqrt(np.maximum(0, 2 - 2 * sample[few:] @ pivots.T))
        visited = (d <= d.min(axis=1, keepdims=True) + 2 * radius).sum(axis=1).mean() if len(d) else few
        copies = (1 + visited) * max(1, visited * n / (few * BLOCK))
    if few < 2 or copies >= max(blocks, COPIES) or visited > few / 2:  # pivots would copy rows more often than blocks of all rows do, or save few comparisons
        return _rounded(_blocked(own, blocks, least), threshold, digits)
    held = spark.sparkContext.broadcast(pivots)

    def cells(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)
            d = np.sqrt(np.maximum(0, 2 - 2 * x @ held.value.T))
            home = d.argmin(axis=1)
            r, c = np.nonzero(d <= d[np.arange(len(x)), home][:, None] + 2 * radius)
            unit = pa.FixedSizeListArray.from_arrays(pa.array(x[r].reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r)), unit, pa.array(c.astype(np.int32)), pa.array(home[r] == c)], names=["node", "v", "cell", "home"])

    placed = scratch.table(own.mapInArrow(cells, "node long, v array<double>, cell int, home boolean"), "cells")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_k"))
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn("_b", F.pmod(F.xxhash64("node"), "_k").cast("int"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias(c)
    at_home = dealt.where("home").select("cell", F.col("_b").alias("i"), every("j"), "node", "v", F.lit(True).alias("home"))
    visits = dealt.select("cell", every("i"), F.col("_b").alias("j"), "node", "v", F.lit(False).alias("home"))

    out = at_home.union(visits).groupBy("cell", "i", "j").applyInArrow(_pairs(least), "u long, v long, cosine double")
    return _rounded(out, threshold, digits)


def _pairs(least: float):
    """The pairs of a tile: rows at home with visiting ones, the smaller node first."""

    def over(t: pa.Table) -> pa.Table:
        home = t.column("home").to_numpy(zero_copy_only=False)
        node, x = t.column("node").to_numpy(), _matrix(t.column("v"))
        a, b = np.flatnonzero(home), np.flatnonzero(~home)
        if not len(a) or not len(b):
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        s = x[a] @ x[b].T
        i, j = np.nonzero((s >= least) & (node[a][:, None] < node[b][None, :]))
        return pa.table({"u": node[a][i], "v": node[b][j], "cosine": s[i, j]})

    return over


def _rounded(pairs: DataFrame, threshold: float, digits: int) -> DataFrame:
    return pairs.withColumn("cosine", F.round("cosine", digits)).where(F.col("cosine") >= threshold)


def _blocked(own: DataFrame, blocks: int, least: float) -> DataFrame:
    """All pairs in tiles of two blocks, each two blocks once: each row is in as many tiles as there are blocks."""
    norm = own.select("node", "v", F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, y: acc + y * y)).alias("_n"))
    unit = norm.select("node", F.transform("v", lambda x: x / (F.col("_n") + 1e-12)).alias("v"), F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("b"))
    met = unit.select("node", "v", "b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_o"))

    def over(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        node, x, b = np.concatenate([c.column("node").to_numpy() for c in held]), np.concatenate([_matrix(c.column("v")) for c in held]), np.concatenate([c.column("b").to_numpy() for c in held])
        del held
        i, j = (k.as_py() for k in key)
        other, y = node[b == j], x[b == j]
        node, x = node[b == i], x[b == i]
        for at in range(0, len(x), SLICE):
            s = x[at : at + SLICE] @ y.T
            p, q = np.nonzero(s >= least)
            s, p, q = s[p, q], node[p + at], other[q]
            take = p < q if i == j else p != q
            s, p, q = s[take], p[take], q[take]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(s)], names=["u", "v", "cosine"])

    return met.groupBy(F.least("b", "_o").alias("i"), F.greatest("b", "_o").alias("j")).applyInArrow(over, "u long, v long, cosine double")


def grid_pairs(points: DataFrame, eps: float, node: str = "node") -> DataFrame:
    """(u, v, d2) of all ordered pairs within eps, each point with itself too; points: node, x, y."""
    own = points.select(F.col(node).alias("u"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.floor(F.col("x") / eps).alias("_cx"), F.floor(F.col("y") / eps).alias("_cy"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    other = points.select(F.col(node).alias("v"), F.col("x").alias("_x2"), F.col("y").alias("_y2"), F.floor(F.col("x") / eps).alias("_bx"), F.floor(F.col("y") / eps).alias("_by"), F.explode(steps).alias("_s"))
    other = other.select("v", "_x2", "_y2", (F.col("_bx") + F.col("_s.i")).alias("_cx"), (F.col("_by") + F.col("_s.j")).alias("_cy"))
    dx, dy = F.col("_x") - F.col("_x2"), F.col("_y") - F.col("_y2")
    d2 = dx * dx + dy * dy
    return own.join(other, ["_cx", "_cy"]).select("u", "v", d2.alias("d2")).where(F.col("d2") <= F.lit(eps * eps))


def k_distances(points: DataFrame, k: int, node: str = "node") -> DataFrame:
    """(node, d): distance to the k-th nearest other point, by a grid whose squares widen until every point has its k.

    Points that found k neighbours within the squares' width are done; only the rest go on, with squares twice as wide. Points
    at one place are one place with a number, and a square's distances stay in its task: no pair is written or shuffled.
    The first squares are narrow, so crowded areas are done before squares hold many of their places.
    """
    scratch = Scratch(points.sparkSession, "knn")
    whole = [F.col(c).isNotNull() & (F.abs(c) < float("inf")) & ~F.isnan(c) for c in ("x", "y")]
    own = scratch.table(points.select(F.col(node).alias("node"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(whole[0] & whole[1]), "points")
    places = scratch.table(own.groupBy("x", "y").agg(F.count("*").alias("n")), "places")
    n, x0, x1, y0, y1 = places.agg(F.sum("n"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    k = min(k, (n or 0) - 1)
    if k < 1:
        return own.sparkSession.createDataFrame([], "node long, d double")
    span = max(x1 - x0, y1 - y0) or 1.0
    width = span * math.sqrt((k + 1) / n) / NARROW
    todo, done = places, None
    while True:
        last = width >= 2 * span
        found = scratch.table(_kth(todo, places, width, k, last), "found")
        done = found if done is None else done.union(found)
        todo = scratch.table(todo.join(found.select("x", "y"), ["x", "y"], "left_anti"), "todo")
        if last or not todo.limit(1).count():
            return own.join(done, ["x", "y"]).select("node", "d")
        width *= 2


def _kth(todo: DataFrame, places: DataFrame, width: float, k: int, last: bool) -> DataFrame:
    """(x, y, d) of the places that have k points besides one of their own within width; last: within any distance."""
    cell = [F.floor(F.col(c) / width).alias(f"_c{c}") for c in ("x", "y")]
    asked = todo.select("x", "y", *cell)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = places.select("x", "y", "n", *cell, F.explode(around).alias("_s"))
    near = near.select("x", "y", "n", (F.col("_cx") + F.col("_s.i")).alias("_cx"), (F.col("_cy") + F.col("_s.j")).alias("_cy"))
    near = near.join(asked.select("_cx", "_cy").distinct(), ["_cx", "_cy"], "left_semi").toDF("_cx", "_cy", "p", "q", "n").withColumnsRenamed({"_cx": "_px", "_cy": "_py"})

    def over(own: pa.Table, other: pa.Table) -> pa.Table:
        x, y = (own.column(c).to_numpy() for c in ("x", "y"))
        p, q, n = (other.column(c).to_numpy() for c in ("p", "q", "n"))
        out = np.full(len(x), np.nan)
        step = max(1, COMPARED // max(1, len(p)))
        for at in range(0, len(x) if n.sum() > k else 0, step):
            dx, dy = x[at : at + step, None] - p, y[at : at + step, None] - q
            d2 = dx * dx + dy * dy
            m = min(k, d2.shape[1] - 1)  # the k + 1 nearest places hold the k + 1 nearest points
            order = np.argpartition(d2, m, axis=1)[:, : m + 1]
            order = np.take_along_axis(order, np.argsort(np.take_along_axis(d2, order, 1), axis=1), 1)
            kth = (n[order].cumsum(axis=1) > k).argmax(axis=1)  # the place itself is first, and the point among its n
            out[at : at + step] = np.sqrt(np.take_along_axis(d2, np.take_along_axis(order, kth[:, None], 1), 1)[:, 0])
        good = ~np.isnan(out) if last else out <= width
        return pa.table({"x": x[good], "y": y[good], "d": out[good]})

    return asked.groupBy("_cx", "_cy").cogroup(near.groupBy("_px", "_py")).applyInArrow(over, "x double, y double, d double")
