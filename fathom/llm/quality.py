"""Quality classifier: logistic regression on hashed word n-grams, learnt with follow-the-regularised-leader updates.

Words and runs of symbols are the tokens. Two streams give n-grams: the lower-cased words themselves (one and two), and the
words' forms (one, two and three): capitals, lower case, digits, or the symbols as written, with a mark on a token that
repeats the one before it. An n-gram's value is its share of the text's tokens, so long and short texts are alike, and a
score is one sparse dot product.

Defined cases: null and empty texts have no features and score by the intercept alone; repeated rows score alike; without
labels of both kinds every score is the share of good labels, or one half without labels; an empty table gives an empty
result. Labels, lang, source and doc_id are never inputs of a score; doc_id decides the held-out fold and the sample only.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import learning, remembered

TRAIN_ROWS = 4000
BITS = 18
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
CACHE_ENTRIES = 300_000

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
_M = np.uint64(0x9E3779B97F4A7C15)


def _form(token: str) -> str:
    if not token[0].isalnum():
        return token[:8]
    if token.isdigit():
        return "0"
    if token.isupper():
        return "A" if len(token) > 1 else "a"
    return "a" if token.islower() else "Aa" if token[1:].islower() else "aA"


class _Tokens(dict):
    """Token -> (hash of the word, hash of its form), packed in one integer; bounded."""

    def __missing__(self, token: str) -> int:
        out = xxhash.xxh32_intdigest(token.lower()) << 32 | xxhash.xxh32_intdigest(_form(token), 5)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        if len(token) <= 64:
            self[token] = out
        return out


_TOKENS = _Tokens()


def _begin() -> None:
    remembered.only(_TOKENS)


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt)) * _M
    h ^= h >> np.uint64(29)
    return ((h * _M) >> np.uint64(64 - BITS)).astype(np.int32)


def grams(text: str) -> np.ndarray:
    """The hashed n-grams of a text, one entry for each occurrence."""
    own = _TOKEN.findall(text)
    packed = np.fromiter(map(_TOKENS.__getitem__, own), np.uint64, len(own))
    word, form = packed >> np.uint64(32), packed & np.uint64(0xFFFFFFFF)
    same = np.zeros(len(own), np.uint64)
    same[1:] = word[1:] == word[:-1]
    form = form * np.uint64(2) + same
    k = np.uint64(1_000_003)
    parts = [_mix(word, 1), _mix(form, 2)]
    if len(own) > 1:
        two = form[:-1] * k + form[1:]
        parts += [_mix(word[:-1] * k + word[1:], 3), _mix(two, 4)]
        if len(own) > 2:
            parts.append(_mix(two[:-1] * k + form[2:], 5))
    return np.concatenate(parts)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    own = grams(text)
    idx, n = np.unique(own, return_counts=True)
    return idx.astype(np.int32), (n * (5.0 / max(1, len(own)))).astype(np.float32)


def ftrl(rows, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3, epochs: int = 4) -> bytes:
    """Weights and, last, the intercept, as float32 bytes. Each coordinate has its own learning rate."""
    size = (1 << BITS) + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    ys = [y for y, _, _ in rows]
    if len(set(ys)) < 2:
        share = min(0.999, max(0.001, sum(ys) / len(ys))) if ys else 0.5
        w[-1] = np.log(share / (1 - share))
        return w.astype(np.float32).tobytes()
    for _ in range(epochs):
        for y, idx, val in rows:
            idx, val = np.append(idx, size - 1), np.append(val, 1.0)
            zi, ni = z[idx], n[idx]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            g = (learning.sigmoid(float(wi @ val)) - y) * val
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[idx] += g - sigma * wi
            n[idx] += g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return w.astype(np.float32).tobytes()


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> bytes:
    sample = learning.training_sample(docs, labels, "quality", lambda c: learning.fold(c, FOLDS) == HELD_OUT, rows)
    return learning.fit_in_one_task(learning.featurised(sample, features), ftrl)


def scorer(spark, model: bytes) -> Callable[[str], float]:
    held = spark.sparkContext.broadcast(model)
    cache: list[np.ndarray] = []

    def score(text: str) -> float:
        if not cache:
            _begin()
            cache.append(np.frombuffer(held.value, np.float32))
        w = cache[0]
        own = grams(text)
        return learning.sigmoid(float(w[-1]) + (float(w[own].sum(dtype=np.float64)) * 5.0 / len(own) if len(own) else 0.0))

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document row: doc_id, held_out, score, predicted."""
    model = train(docs, labels, rows)
    out = learning.scored(docs.select("doc_id", "text"), scorer(docs.sparkSession, model))
    return out.select(
        "doc_id",
        (learning.fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= threshold).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier does not reject."""
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")
    names = ["text" if i == at else f"_c{i}" for i in range(len(docs.columns))]  # a text travels to Python once
    inner = docs.toDF(*names)
    model = train(docs, labels, rows)
    return learning.scored(inner, scorer(docs.sparkSession, model)).where(F.col("_score") >= threshold).select(*names).toDF(*docs.columns)
