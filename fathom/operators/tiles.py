"""The best rows for each of many queries, where neither side is small: both are dealt in blocks, and a task scores one tile."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 8192
SLICE = 256


def matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array(vectors.to_pylist(), np.float64).reshape(len(vectors), -1)


def rounded(s: np.ndarray, digits: int | None) -> np.ndarray:
    """Halves go away from zero, as in SQL."""
    return s if digits is None else np.copysign(np.floor(np.abs(s) * 10.0**digits + 0.5) / 10.0**digits, s)


def best_of(q: np.ndarray, v: np.ndarray, top_k: int, digits: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's top_k rows; rows come in order of preference among equals; no number is the worst."""
    s = rounded(v @ q.T, digits)
    k = min(top_k, len(v))
    low = np.where(np.isnan(s), np.inf, -s)
    cut = np.partition(low, k - 1, axis=0)[k - 1]
    better, equal = low < cut, low == cut
    of, at = np.nonzero((better | equal & (equal.cumsum(axis=0) <= k - better.sum(axis=0))).T)
    return of, at, s[at, of]


def unit(v: np.ndarray) -> np.ndarray:
    return v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12)


def tile_bests(queries: DataFrame, rows: DataFrame, top_k: int, normalise: bool = False, digits: int | None = None, side: int = SIDE) -> DataFrame:
    """(query, item, score): of each query (query, q) and each block of rows (item, v) the top_k, the smallest items among equals.

    Blocks have about side members, so a task holds two blocks of vectors and SLICE columns of scores, however many rows there
    are. A row travels once for each block of queries and a query once for each block of rows. Ids are unique on both sides;
    rows and queries without a vector take no part.
    """
    queries, rows = queries.select("query", "q").where("q IS NOT NULL"), rows.select("item", "v").where("v IS NOT NULL")
    n_q, n_r = (max(1, math.ceil(df.count() / side)) for df in (queries, rows))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(block("query", n_q).alias("_q"), every(n_r).alias("_r"), "query", "q")
    right = rows.select(every(n_q).alias("_q"), block("item", n_r).alias("_r"), "item", "v")
    kinds = {"query": queries.schema["query"].dataType.simpleString(), "item": rows.schema["item"].dataType.simpleString()}

    def over(own: pa.Table, other: pa.Table) -> pa.Table:
        names, items = own.column("query").combine_chunks(), other.column("item").combine_chunks()
        parts = [(names.slice(0, 0), items.slice(0, 0), pa.array([], pa.float64()))]
        if own.num_rows and other.num_rows:
            other = other.sort_by("item")
            items, v, q = other.column("item").combine_chunks(), matrix(other.column("v")), matrix(own.column("q"))
            v = unit(v) if normalise else v
            for at in range(0, len(q), SLICE):
                of, row, score = best_of(q[at : at + SLICE], v, top_k, digits)
                parts.append((names.take(pa.array(of + at)), items.take(pa.array(row)), pa.array(score)))
        return pa.table([pa.chunked_array([p[i] for p in parts]) for i in range(3)], names=["query", "item", "score"])

    pairs = left.groupBy("_q", "_r").cogroup(right.groupBy("_q", "_r"))
    return pairs.applyInArrow(over, f"query {kinds['query']}, item {kinds['item']}, score double")
