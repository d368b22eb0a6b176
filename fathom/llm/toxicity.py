"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

Texts are lower-cased, what stands between words becomes one space and a word that is repeated at once counts once, so that n-grams
of three to six characters also see where words begin and end, and no word is heard louder for being said again. For each hashed n-gram the log ratio of its smoothed shares among toxic and other documents scales its
value; n-grams that too few documents have, or that say little, are left out. Logistic regression learns a weight for each
scaled n-gram. A text is scored by its strongest passage: windows of ``WINDOW`` characters that overlap by half, so a long
text is not excused by its length, nor a text blamed for being long.

Defined cases: null and empty texts score by the intercept alone; repeated rows score alike; without labels of both kinds
every score is the share of toxic labels, or one half without labels; an empty table gives an empty result. Labels, lang,
source and doc_id are never inputs of a score; doc_id decides the held-out fold and the sample only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import learning

TRAIN_ROWS = 12_000
BITS = 20
SIZES = (3, 4, 5, 6)
LEAST_DOCS = 4
LEAST_RATIO = 1.0
WINDOW = 600
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.5

_K = np.uint32(0x01000193)
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")


def _codes(text: str) -> np.ndarray:
    own = _WORD.findall(text.lower())
    own = own[:1] + [w for before, w in zip(own, own[1:]) if w != before]
    return np.frombuffer(f" {' '.join(own)} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_index(codes: np.ndarray) -> list[np.ndarray]:
    """For each size, the hashed n-gram that begins at each position."""
    out, h = [], codes * np.uint32(0x9E3779B1)
    for n in range(2, max(SIZES) + 1):
        if len(codes) < n:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _K + codes[n - 1 :] * np.uint32(0x85EBCA77)
        if n in SIZES:
            mixed = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            out.append((mixed >> np.uint32(32 - BITS)).astype(np.int32))
    return out


def distinct(text: str) -> np.ndarray:
    parts = gram_index(_codes(text))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int32)


def count_ratios(sample: DataFrame) -> np.ndarray:
    """Log-count ratios by hashed n-gram; 0 where too few documents have it. Counted by Spark; the driver gets 2^BITS rows at most."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int32)
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts[int(y > 0), distinct(t)] += 1
        has = np.flatnonzero(counts.any(axis=0)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(counts[0, has].astype(np.int64)), pa.array(counts[1, has].astype(np.int64))], names=["g", "n0", "n1"])

    counted = sample.select("_label", "text").mapInArrow(over, "g int, n0 long, n1 long").groupBy("g").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    rows = counted.where(F.col("n0") + F.col("n1") >= LEAST_DOCS).toPandas()
    n = sample.groupBy("_label").count().collect()
    n1, n0 = sum(r["count"] for r in n if r["_label"] > 0), sum(r["count"] for r in n if r["_label"] <= 0)
    out = np.zeros(1 << BITS, np.float32)
    if n0 and n1:
        r = np.log((rows["n1"] + 0.5) / (n1 + 1)) - np.log((rows["n0"] + 0.5) / (n0 + 1))
        out[rows["g"].to_numpy()] = np.where(np.abs(r) >= LEAST_RATIO, r, 0)
    return out


def window_sums(text: str, weights: np.ndarray) -> np.ndarray:
    """The summed weights of each window of the text."""
    codes = _codes(text)
    total = np.zeros(len(codes) + 1)
    for idx in gram_index(codes):
        total[1 : len(idx) + 1] += weights[idx]
    total = np.cumsum(total)
    starts = np.arange(0, max(1, len(codes) - WINDOW // 2), WINDOW // 2)
    return total[np.minimum(starts + WINDOW, len(codes))] - total[starts]


def features(text: str, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scaled n-grams of the window with the largest sum of ratios."""
    sums = window_sums(text, ratios)
    codes = _codes(text)
    start = int(np.argmax(sums)) * (WINDOW // 2)
    parts = [idx[start : start + WINDOW] for idx in gram_index(codes)]
    own = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    own = own[ratios[own] != 0]
    idx, n = np.unique(own, return_counts=True)
    return idx.astype(np.int32), (n * ratios[idx] / 10).astype(np.float32)


def descent(rows, rate: float = 0.3, l2: float = 1e-4, epochs: int = 6) -> np.ndarray:
    """Weights on scaled n-grams, and the intercept last, by adaptive gradient steps on the logistic loss."""
    size = (1 << BITS) + 1
    w, seen = np.zeros(size), np.full(size, 1e-2)
    ys = [y for y, _, _ in rows]
    w[:-1] = 0.3
    w[-1] = -2
    weight = (1.0, ys.count(0) / ys.count(1))  # both kinds of documents count alike, however few are toxic
    for _ in range(epochs):
        for y, idx, val in rows:
            idx, val = np.append(idx, size - 1), np.append(val, 1.0)
            g = weight[y] * (learning.sigmoid(float(w[idx] @ val)) - y) * val + l2 * w[idx]
            seen[idx] += g * g
            w[idx] -= rate * g / np.sqrt(seen[idx])
    return w


def best_cut(odds: np.ndarray, ys: np.ndarray) -> float:
    """The log odds, between those of two documents, at which toxic ones and others are told apart with the best F1."""
    order = np.argsort(-odds, kind="stable")
    odds, ys = odds[order], ys[order]
    hits = np.cumsum(ys)
    f1 = 2 * hits / (np.arange(1, len(ys) + 1) + ys.sum())
    f1[:-1][odds[1:] == odds[:-1]] = -1  # equal odds are not cut apart
    k = int(f1.argmax())
    return float(odds[k] - 1 if k + 1 == len(odds) else (odds[k] + odds[k + 1]) / 2)


def fit(rows) -> bytes:
    """The model as float32. A quarter of the rows, kept out of a first fit, says where the odds are to be cut: at one half."""
    ys = [y for y, _, _ in rows]
    if len(set(ys)) < 2:
        w = np.zeros((1 << BITS) + 1)
        share = min(0.999, max(0.001, sum(ys) / len(ys))) if ys else 0.5
        w[-1] = np.log(share / (1 - share))
        return w.astype(np.float32).tobytes()
    w = descent(rows)
    most, part = [r for i, r in enumerate(rows) if i % 4], rows[::4]
    if len({y for y, _, _ in most}) == 2 == len({y for y, _, _ in part}):
        v = descent(most)
        w[-1] -= best_cut(np.array([float(v[idx] @ val) + v[-1] for _, idx, val in part]), np.array([y for y, _, _ in part]))
    return w.astype(np.float32).tobytes()


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> bytes:
    """One float32 for each hashed n-gram, ratio times weight, and the intercept last."""
    sample = learning.training_sample(docs, labels, "toxic", lambda c: learning.fold(c, FOLDS) == HELD_OUT, rows).persist()
    try:
        ratios = count_ratios(sample)
        held = docs.sparkSession.sparkContext.broadcast(ratios)
        w = np.frombuffer(learning.fit_in_one_task(learning.featurised(sample, lambda t: features(t, held.value)), fit), np.float32).copy()
    finally:
        sample.unpersist()
    w[:-1] *= ratios / 10
    return w.tobytes()


def scorer(spark, model: bytes) -> Callable[[str], float]:
    held = spark.sparkContext.broadcast(model)
    cache: list[np.ndarray] = []

    def score(text: str) -> float:
        if not cache:
            cache.append(np.frombuffer(held.value, np.float32))
        return learning.sigmoid(float(cache[0][-1]) + float(window_sums(text, cache[0]).max()))

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document row: doc_id, held_out, score, predicted."""
    model = train(docs, labels, rows)
    out = learning.scored(docs.select("doc_id", "text"), scorer(docs.sparkSession, model))
    return out.select(
        "doc_id",
        (learning.fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= threshold).cast("int").alias("predicted"),
    )
