"""Hybrid similarity search: a weighted mean of positive queries less a calibrated negative one, as one projection."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.vectors import dot, l2_normalised, sigmoid
from fathom.operators import tiles
from fathom.operators.index import positions

#: The least score that a result needs, by encoder backend.
FLOORS = {"siglip": 0.005, "openai-clip": 0.2, "open-clip": 0.1}
OTHER_FLOOR = 0.1


def default_floor(spec: Column) -> Column:
    out = F.lit(OTHER_FLOOR)
    for name, floor in FLOORS.items():
        out = F.when(F.substring_index(spec, ":", 1) == name, floor).otherwise(out)
    return out


def calibrated(cosine: Column, scale: float | None = None, bias: float = 0.0) -> Column:
    """Cosines as they are, or as probabilities where the encoder has a logit scale and bias."""
    return cosine if scale is None else sigmoid(cosine * math.exp(scale) + bias)


def hybrid_score(
    v: Column | str,
    image: Sequence[float] | None = None,
    positive: Sequence[float] | None = None,
    negative: Sequence[float] | None = None,
    weights: tuple[float, float, float] = (0.5, 0.5, 0.5),
    scale: float | None = None,
    bias: float = 0.0,
) -> Column | None:
    """The score of a vector, or None if no query has weight. Vectors are normalised here, queries are taken as given.

    Queries are literals of the plan; those without weight are not scored at all. Image cosines are never calibrated.
    """
    unit = l2_normalised(v)
    literal = lambda q: F.array(*[F.lit(float(x)) for x in q])
    terms = []
    if image is not None and weights[0]:
        terms.append((weights[0], dot(unit, literal(image))))
    if positive is not None and weights[1]:
        terms.append((weights[1], calibrated(dot(unit, literal(positive)), scale, bias)))
    has_negative = negative is not None and weights[2]
    if not terms and not has_negative:
        return None
    total = F.lit(0.0)
    for w, s in terms:
        total = total + F.lit(w) * s
    score = total / F.lit(sum(w for w, _ in terms)) if terms else F.lit(0.0)
    if has_negative:
        score = score - F.lit(weights[2]) * calibrated(dot(unit, literal(negative)), scale, bias)
    return score


def search(index: DataFrame, top_k: int = 100, floor: float = OTHER_FLOOR, vector: str = "v", idx: str = "idx", digits: int | None = None, **query) -> DataFrame:
    """(idx, score) of the best rows: a filter and a top-k by score, ties by position."""
    score = hybrid_score(vector, **query)
    if score is None:
        return index.select(idx, F.lit(0.0).alias("score")).limit(0)
    scored = index.select(idx, (F.round(score, digits) if digits is not None else score).alias("score"))
    return scored.where(F.col("score") >= floor).orderBy(F.desc("score"), idx).limit(top_k)


def search_files(files: DataFrame, order: list[str], top_k: int = 100, floor: float = OTHER_FLOOR, vector: str = "v", digits: int | None = None, **query) -> DataFrame:
    """search over files that have no stored positions: scored and cut first, ties by the order; only the winners are numbered."""
    spark = files.sparkSession
    score = hybrid_score(vector, **query)
    if score is None:
        return spark.createDataFrame([], "idx long, score double")
    scored = files.select(*order, (F.round(score, digits) if digits is not None else score).alias("_score")).where(F.col("_score") >= floor)
    best = scored.orderBy(F.desc("_score"), *order).limit(top_k).collect()
    winners = sorted((tuple(r[c] for c in order), r["_score"]) for r in best)
    held = spark.createDataFrame([(k, s) for k, (_, s) in enumerate(winners)], "_k int, score double")
    return positions(files, [k for k, _ in winners], order).join(held, "_k").select("idx", "score")


def search_batch(index: DataFrame, queries: DataFrame, top_k: int, vector: str = "v", idx: str = "idx", block: int = 256) -> DataFrame:
    """The best rows for each of many stated queries (query, q): query, idx, score, rank; the smallest positions among equals.

    Up to block queries go to the rows, which are read once and not shuffled. More of them meet the rows in tiles.
    """
    spark = index.sparkSession
    kind, named = (df.schema[c].dataType.simpleString() for df, c in ((index, idx), (queries, "query")))
    few = queries.select("query", "q").where("q IS NOT NULL").limit(block + 1).collect()
    if not few:
        return spark.createDataFrame([], f"query {named}, idx {kind}, score double, rank int")
    if len(few) > block:
        out = tiles.tile_bests(queries, index.select(F.col(idx).alias("item"), F.col(vector).alias("v")), top_k, normalise=True)
        out = out.withColumnRenamed("item", "idx")
    else:
        held = spark.sparkContext.broadcast(([r[0] for r in few], np.array([r[1] for r in few], np.float64)))

        def over(batches):
            names, q = pa.array(held.value[0]), held.value[1]
            for b in batches:
                if not b.num_rows:
                    continue
                order = pc.sort_indices(b.column(0))
                of, at, score = tiles.best_of(q, tiles.unit(tiles.matrix(b.column(1)))[order.to_numpy()], top_k)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(of)), b.column(0).take(order.take(pa.array(at))), pa.array(score)], names=["query", "idx", "score"])

        out = index.select(idx, vector).where(F.col(vector).isNotNull()).mapInArrow(over, f"query {named}, idx {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "idx"))
    return out.withColumn("rank", rank).where(F.col("rank") <= top_k)
