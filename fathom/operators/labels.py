"""Cluster centroids, medoids and zero-shot labels."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.vectors import dot, norm
from fathom.operators.encoders import encoded
from fathom.operators.tiles import tile_bests

#: The prompts that a phrase is put in before its vectors are averaged.
PROMPTS = ("a photo of a {}", "a photo of the {}", "a picture of {}", "an image of {}", "a drawing of {}", "a painting of {}", "{}")

#: Of 1,000 numbers a phrase this is 8 MB.
FEW_PHRASES = 1000


def unit_or_zero(v) -> F.Column:
    """The vector over its length; a zero vector stays."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x))


def mean_vectors(rows: DataFrame, key: str, vector: str = "v") -> DataFrame:
    """(key, mean) element by element; partial sums of one vector a key and task are what is shuffled."""
    return rows.groupBy(key).agg(vector_to_array(Summarizer.mean(array_to_vector(F.col(vector)))).alias("mean"))


def centroids(rows: DataFrame, cluster: str = "cluster", vector: str = "v") -> DataFrame:
    """(cluster, centroid) of unit length, without noise."""
    return mean_vectors(rows.where(F.col(cluster) != -1), cluster, vector).select(cluster, unit_or_zero(F.col("mean")).alias("centroid"))


def medoids(rows: DataFrame, cents: DataFrame, cluster: str = "cluster", vector: str = "v", order: str = "raw_pos", idx: str = "idx") -> DataFrame:
    """(cluster, medoid): the member most like the centroid, the first in row order among equals."""
    scored = rows.join(cents, cluster).select(cluster, idx, order, dot(vector, "centroid").alias("_s"))
    return scored.groupBy(cluster).agg(F.max_by(idx, F.struct("_s", -F.col(order))).alias("medoid"))


def ranked_phrases(vectors: DataFrame, vocabulary: DataFrame, key: str, vector: str, top_k: int, digits: int = 6, few: int = FEW_PHRASES) -> DataFrame:
    """(key, rank, phrase, score) of the best phrases. vocabulary: phrase, pos (unique), embedding.

    Up to few phrases are broadcast to the vectors. A larger vocabulary meets them in tiles.
    """
    if vocabulary.select("pos").limit(few + 1).count() <= few:
        scored = vectors.crossJoin(F.broadcast(vocabulary)).select(key, "phrase", "pos", F.round(dot(vector, "embedding"), digits).alias("score"))
    else:
        best = tile_bests(
            vectors.select(F.col(key).alias("query"), F.col(vector).alias("q")), vocabulary.select(F.col("pos").alias("item"), F.col("embedding").alias("v")), top_k, digits=digits
        )
        best = best.select(F.col("query").alias(key), F.col("item").alias("pos"), F.round("score", digits).alias("score"))
        scored = best.join(vocabulary.select("phrase", "pos"), "pos")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "pos"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top_k).select(key, "rank", "phrase", "score")


def labels(ranked: DataFrame, key: str = "cluster") -> DataFrame:
    """(key, label, score, alternates): the best phrase, and the others in order."""
    rest = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", "phrase")))), lambda x: x["phrase"])
    return ranked.groupBy(key).agg(F.max_by("phrase", -F.col("rank")).alias("label"), F.max("score").alias("score"), rest.alias("alternates"))


def cluster_labels(rows: DataFrame, vocabulary: DataFrame, top_k: int = 3, cluster: str = "cluster") -> DataFrame:
    """(cluster, label, score, alternates, medoid) of every cluster; rows: idx, raw_pos, cluster, v."""
    cents = centroids(rows, cluster)
    return labels(ranked_phrases(cents, vocabulary, cluster, "centroid", top_k), cluster).join(medoids(rows, cents, cluster), cluster)


def prompted(vocabulary: DataFrame, prompts: tuple[str, ...] = PROMPTS) -> DataFrame:
    """vocabulary with a row for each prompt of its phrase: prompt."""
    every = F.array(*[F.replace(F.lit(p), F.lit("{}"), F.col("phrase")) for p in prompts])
    return vocabulary.withColumn("prompt", F.explode(every))


def vocabulary_vectors(vocabulary: DataFrame, spec: str, prompts: tuple[str, ...] = PROMPTS) -> DataFrame:
    """(phrase, pos, embedding) of the phrases (phrase, pos): the unit mean of their encoded prompts; prompts that fail are left out."""
    own = encoded(prompted(vocabulary.select("phrase"), prompts), spec, "prompt").where("NOT bad")
    return ensembled(own).join(vocabulary.select("phrase", "pos"), "phrase").select("phrase", "pos", "embedding")


def ensembled(encoded: DataFrame, phrase: str = "phrase", vector: str = "v") -> DataFrame:
    """(phrase, embedding): the mean over prompts of unit vectors, of unit length."""
    unit = encoded.select(phrase, unit_or_zero(F.col(vector)).alias("_u"))
    return mean_vectors(unit, phrase, "_u").select(phrase, unit_or_zero(F.col("mean")).alias("embedding"))
