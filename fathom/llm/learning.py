"""What the two text classifiers share: a bounded sample of labelled rows, one model of fixed size, scoring by partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm import remembered


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; rows without an id are in no held-out fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Callable[[Column], Column], rows: int) -> DataFrame:
    """About ``rows`` labelled rows outside the held-out fold: _id, _label, text.

    An id's hash decides whether it is in the sample, so every run takes the same rows. Ids with several labels take the
    largest; ids with several texts take the smallest text. Null ids and null labels teach nothing.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max(label).cast("int").alias("_label"))
    )
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64(F.col("_id"), F.lit(7)), F.lit(1 << 30)) < int(rows / n * (1 << 30)))
    own = docs.select(F.col("doc_id").alias("_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return own.join(F.broadcast(known), "_id").groupBy("_id", "_label").agg(F.min("text").alias("text"))


def fit_in_one_task(features: DataFrame, fit: Callable[[list[tuple[int, np.ndarray, np.ndarray]]], bytes]) -> bytes:
    """features: _id, _label, _idx, _val of the bounded sample. Only the model, of fixed size, comes to the driver."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            ids, ys = b.column(0).to_pylist(), b.column(1).to_pylist()
            for k, (i, y) in enumerate(zip(ids, ys)):
                rows.append((i, y, b.column(2)[k].values.to_numpy(zero_copy_only=False), b.column(3)[k].values.to_numpy(zero_copy_only=False)))
        rows.sort(key=lambda r: r[0])
        order = np.random.default_rng(11).permutation(len(rows))
        yield pa.RecordBatch.from_arrays([pa.array([fit([rows[k][1:] for k in order])], pa.binary())], names=["model"])

    plan = features.select("_id", "_label", "_idx", "_val").repartition(1)
    return bytes(plan.mapInArrow(over, "model binary").first()[0])


def featurised(sample: DataFrame, features: Callable[[str], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [features(t) for t in b.column(2).to_pylist()]
            cols = [b.column(0), b.column(1), pa.array([x for x, _ in own], pa.list_(pa.int32())), pa.array([v for _, v in own], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["_id", "_label", "_idx", "_val"])

    kind = sample.schema["_id"].dataType.simpleString()
    return sample.select("_id", "_label", "text").mapInArrow(over, f"_id {kind}, _label int, _idx array<int>, _val array<float>")


def scored(docs: DataFrame, score: Callable[[str], float]) -> DataFrame:
    """docs (doc_id, text, and anything else) with _score."""
    schema = docs.withColumn("_score", F.lit(0.0)).schema
    at = docs.columns.index("text")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in remembered.pieces(batches):
            own = pa.array([score(t or "") for t in b.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, own], names=schema.names)

    return docs.mapInArrow(over, schema)


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-min(30.0, max(-30.0, x)))))
