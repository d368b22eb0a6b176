"""Diverse and representative subsets, and their consensus over repeated runs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.vectors import dot, l2_normalised
from fathom.plans.scratch import Scratch

MOST_RUNS = 30
CANDIDATES = 128
CUT_AT = 256


def farthest_points(rows: DataFrame, n_target: int, starts: Sequence[int], idx: str = "idx", vector: str = "v") -> DataFrame:
    """(run, step, idx): farthest-point samples of unit vectors, one run for each start, all runs side by side.

    A round's job gives, for each run, the CANDIDATES rows that are farthest from the run's picks, ties by position. A row's
    distance never grows, so the last candidate's distance bounds all other rows: the driver goes on picking among the
    candidates as long as the pick stands at or before that bound, and only then starts another round. The driver holds the
    candidates and the vectors of at most CUT_AT + CANDIDATES picks a run; then distances are written with the rows and these
    vectors go. Of older picks it keeps positions. With n_target rows or fewer, every row is taken, in order.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "fps")
    own = scratch.table(rows.select(F.col(idx).cast("long").alias("idx"), l2_normalised(vector).alias("v")), "unit")
    n = own.count()
    if n_target >= n:
        runs = spark.range(len(starts)).select(F.col("id").cast("int").alias("run"))
        from fathom.operators.index import global_index

        return global_index(own.select("idx"), ["idx"], scratch, "_at").crossJoin(F.broadcast(runs)).select("run", F.col("_at").cast("int").alias("step"), "idx")
    first = {r["idx"]: np.array(r["v"]) for r in own.where(F.col("idx").isin(*set(starts))).collect()}
    picked = [[int(s)] for s in starts]
    recent = [[first[s]] for s in starts]
    state = own.withColumn("d", F.array_repeat(F.lit(float("inf")), len(starts)))
    written = own
    while any(len(p) < n_target for p in picked):
        if max(map(len, recent)) >= CUT_AT:
            state = scratch.table(_nearer(state, spark.sparkContext.broadcast(_stacked(recent))), "state")
            scratch.drop(written)
            written, recent = state, [[] for _ in starts]
        for run, ids, v, d in _leaders(state, spark.sparkContext.broadcast(_stacked(recent))):
            for at in _certain(ids, v, d, n_target - len(picked[run])):
                picked[run].append(int(ids[at]))
                recent[run].append(v[at])
    steps = pa.table({
        "run": pa.array(np.repeat(np.arange(len(picked), dtype=np.int32), n_target)),
        "step": pa.array(np.tile(np.arange(n_target, dtype=np.int32), len(picked))),
        "idx": pa.array([i for p in picked for i in p], pa.int64()),
    })
    return spark.createDataFrame(steps)


def _stacked(recent: list[list[np.ndarray]]) -> list[np.ndarray | None]:
    return [np.array(r) if r else None for r in recent]


def _distances(b: pa.RecordBatch, picks: list[np.ndarray | None]) -> tuple[np.ndarray, np.ndarray]:
    x = np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, -1)
    d = np.array(b.column(2).flatten(), np.float64).reshape(b.num_rows, -1)
    for run, own in enumerate(picks):
        if own is not None:
            np.minimum(d[:, run], (1 - x @ own.T).min(axis=1), out=d[:, run])
    return x, d


def _first_of(d: np.ndarray, idx: np.ndarray, n: int) -> np.ndarray:
    """Places of the n farthest rows in order, ties by position."""
    if len(d) > n:
        near = np.partition(d, len(d) - n)[len(d) - n]
        some = np.flatnonzero(d >= near)
        return some[np.lexsort((idx[some], -d[some]))][:n]
    return np.lexsort((idx, -d))


def _certain(idx: np.ndarray, v: np.ndarray, d: np.ndarray, room: int) -> list[int]:
    """Places of the next picks, while no row outside the candidates (sorted, farthest first) can come before them."""
    bound = (d[-1], -idx[-1]) if len(d) >= CANDIDATES else (-np.inf, 0)
    d, picks = d.copy(), []
    while len(picks) < room:
        ties = np.flatnonzero(d == d.max())
        at = ties[np.argmin(idx[ties])]
        if (d[at], -idx[at]) < bound:
            break
        picks.append(at)
        d = np.minimum(d, 1 - v @ v[at])
    return picks


def _leaders(state: DataFrame, held) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(run, positions, vectors, distances) of each run's candidates, farthest first; each task sends no more than these."""
    most = CANDIDATES

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple] = {}
        for b in batches:
            if b.num_rows:
                x, d = _distances(b, held.value)
                idx = b.column(0).to_numpy()
                for run in range(d.shape[1]):
                    at = _first_of(d[:, run], idx, most)
                    own = (idx[at], x[at], d[at, run])
                    if run in kept:
                        own = tuple(np.concatenate(pair) for pair in zip(kept[run], own))
                        at = _first_of(own[2], own[0], most)
                        own = tuple(c[at] for c in own)
                    kept[run] = own
        for run, (idx, x, d) in kept.items():
            v = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(idx), run, np.int32)), pa.array(idx), v, pa.array(d)], names=["run", "idx", "v", "d"])

    found = state.select("idx", "v", "d").mapInArrow(over, "run int, idx long, v array<double>, d double")
    place = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("d"), "idx"))
    best = found.withColumn("place", place).where(F.col("place") <= most).toArrow().sort_by([("run", "ascending"), ("place", "ascending")])
    runs = best["run"].to_numpy()
    for run in np.unique(runs):
        own = best.slice(int(np.searchsorted(runs, run)), int(np.sum(runs == run))).combine_chunks()
        idx = own["idx"].to_numpy()
        yield int(run), idx, np.array(own["v"].combine_chunks().flatten(), np.float64).reshape(len(idx), -1), own["d"].to_numpy()


def _nearer(state: DataFrame, held) -> DataFrame:
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, d = _distances(b, held.value)
                own = pa.ListArray.from_arrays(pa.array(np.arange(0, d.size + 1, d.shape[1], dtype=np.int32)), pa.array(d.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), own], names=["idx", "v", "d"])

    return state.select("idx", "v", "d").mapInArrow(over, "idx long, v array<double>, d array<double>")


def nearest_to_centres(assigned: DataFrame, cluster: str = "cluster", distance: str = "distance", order: str = "raw_pos", idx: str = "idx") -> DataFrame:
    """(cluster, idx): each cluster's member nearest to its centre, the first in row order among equals."""
    return assigned.groupBy(cluster).agg(F.min_by(idx, F.struct(distance, order)).alias(idx))


def kmeans_representatives(rows: DataFrame, n_target: int, seed: int, idx: str = "idx", vector: str = "v") -> DataFrame:
    """(cluster, idx): one row for each k-means cluster of the unit vectors that has members."""
    own = rows.select(F.col(idx).alias("idx"), l2_normalised(vector).alias("v")).withColumn("features", array_to_vector("v"))
    model = KMeans(k=n_target, seed=seed, maxIter=20).fit(own)
    centres = rows.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, c array<double>")
    placed = model.transform(own).withColumnRenamed("prediction", "cluster").join(F.broadcast(centres), "cluster")
    gap = F.zip_with("v", "c", lambda a, b: a - b)
    return nearest_to_centres(placed.withColumn("distance", F.sqrt(dot(gap, gap))), order="idx", idx="idx")


def consensus(picks: DataFrame, runs: int, target: int) -> DataFrame:
    """(idx, count, frequency, selected) of picked rows; picks: run, step, idx. Equal counts stand in order of first pick."""
    votes = picks.groupBy("idx").agg(F.count("*").alias("count"), F.min(F.struct("run", "step")).alias("_first"))
    votes = votes.withColumn("frequency", F.bround(F.col("count") / runs * 100, 1))
    chosen = votes.orderBy(F.desc("count"), "_first", "idx").limit(target).select("idx", F.lit(True).alias("_in"))
    return votes.join(chosen, "idx", "left").select("idx", "count", "frequency", F.coalesce("_in", F.lit(False)).alias("selected"))


def curate(rows: DataFrame, target: int, runs: int, seed: int, excluded: DataFrame | None = None, idx: str = "idx", vector: str = "v") -> DataFrame:
    """Farthest-point consensus: runs from random starts, then a vote. Exclusions are positions, like everything here."""
    own = rows.join(excluded.select(idx).distinct(), idx, "left_anti") if excluded is not None else rows
    runs = max(1, min(MOST_RUNS, runs))
    starts = [r[0] for r in own.select(idx).orderBy(F.xxhash64(F.lit(seed), idx)).limit(runs).collect()]
    starts = (starts * runs)[:runs]
    return consensus(farthest_points(own, target, starts, idx, vector), runs, target) if starts else consensus(rows.sparkSession.createDataFrame([], "run int, step int, idx long"), runs, target)


def bucket(frequency: F.Column) -> F.Column:
    f = F.coalesce(F.nullif(frequency, F.lit(0.0)), F.lit(100.0))
    return F.when(f >= 90, "high").when(f >= 70, "mid").otherwise("low")
