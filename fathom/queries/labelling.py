"""Centroids, medoids and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.catalog import query
from fathom.operators import labels
from fathom.sources.surrogates import MEDIA_SQL, files, media
from fathom.sources.tables import table

_MEAN = "SELECT {k}, list(m ORDER BY i) AS mean FROM (SELECT {k}, i, avg(x) AS m FROM (SELECT {k}, unnest({v}) AS x, unnest(range(1, len({v}) + 1)) AS i FROM {t}) GROUP BY {k}, i) GROUP BY {k}"
_UNIT = "CASE WHEN list_dot_product({0}, {0}) > 0 THEN list_transform({0}, lambda x: x / sqrt(list_dot_product({0}, {0}))) ELSE {0} END"
_CENTS = f"means AS ({_MEAN.format(k='label', v='v', t='media0')}), cents AS (SELECT label AS cluster, {_UNIT.format('mean')} AS c FROM means)"
_VOCAB = "vocab AS (SELECT 'label_' || label AS phrase, label AS pos, v AS embedding FROM media0 WHERE vec_id IN (SELECT min(vec_id) FROM media0 GROUP BY label))"


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media(spark, sf_dir).select("idx", F.col("vec_id").alias("raw_pos"), F.col("label").alias("cluster"), "v")


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = files(spark, sf_dir).groupBy("label").agg(F.min_by("v", "vec_id").alias("embedding"))
    return first.select(F.concat(F.lit("label_"), F.col("label").cast("string")).alias("phrase"), F.col("label").alias("pos"), "embedding")


@query(f"WITH {MEDIA_SQL}, {_CENTS} SELECT cluster, unnest(range(1, len(c) + 1)) AS i, round(unnest(c), 6) AS x FROM cents")
def cluster_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = labels.centroids(_members(spark, sf_dir))
    return c.select("cluster", F.posexplode("centroid").alias("_i", "x")).select("cluster", (F.col("_i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


@query(f"WITH {MEDIA_SQL}, {_CENTS} SELECT cluster, arg_max(idx, struct_pack(s := s, p := -vec_id)) AS medoid FROM (SELECT cluster, idx, vec_id, list_dot_product(v, c) AS s FROM media JOIN cents ON label = cluster) GROUP BY cluster")
def cluster_medoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _members(spark, sf_dir)
    return labels.medoids(own, labels.centroids(own))


@query(
    f"WITH {MEDIA_SQL}, {_CENTS}, {_VOCAB}, s AS (SELECT cluster, phrase, pos, round(list_dot_product(c, embedding), 6) AS score FROM cents, vocab), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, pos) AS rank FROM s) SELECT cluster, rank, phrase, score FROM r WHERE rank <= 3"
)
def cluster_labels_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.ranked_phrases(labels.centroids(_members(spark, sf_dir)), _vocabulary(spark, sf_dir), "cluster", "centroid", 3)


@query(
    f"WITH {MEDIA_SQL}, {_CENTS}, {_VOCAB}, s AS (SELECT cluster, phrase, pos, round(list_dot_product(c, embedding), 6) AS score FROM cents, vocab), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, pos) AS rank FROM s), m AS (SELECT cluster, arg_max(idx, struct_pack(s := s, p := -vec_id)) AS medoid FROM (SELECT cluster, idx, vec_id, list_dot_product(v, c) AS s FROM media JOIN cents ON label = cluster) GROUP BY cluster) SELECT cluster, max(phrase) FILTER (rank = 1) AS label, max(score) AS score, string_agg(phrase, '|' ORDER BY rank) FILTER (rank BETWEEN 2 AND 3) AS alternates, any_value(medoid) AS medoid FROM r JOIN m USING (cluster) GROUP BY cluster"
)
def cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = labels.cluster_labels(_members(spark, sf_dir), _vocabulary(spark, sf_dir), 3)
    return out.select("cluster", "label", "score", F.array_join("alternates", "|").alias("alternates"), "medoid")


@query(
    f"WITH {MEDIA_SQL}, {_VOCAB}, u AS (SELECT idx, {_UNIT.format('v')} AS w FROM media), s AS (SELECT idx, phrase, pos, round(list_dot_product(w, embedding), 6) AS score FROM u, vocab), r AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY score DESC, pos) AS rank FROM s) SELECT idx, rank, phrase, score FROM r WHERE rank <= 3"
)
def image_labels_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = media(spark, sf_dir).select("idx", labels.unit_or_zero(F.col("v")).alias("w"))
    return labels.ranked_phrases(own, _vocabulary(spark, sf_dir), "idx", "w", 3)


@query(
    "WITH p AS (SELECT unnest(['a photo of a {}', 'a photo of the {}', 'a picture of {}', 'an image of {}', 'a drawing of {}', 'a painting of {}', '{}']) AS t) "
    "SELECT p_partkey AS pos, replace(t, '{}', p_name) AS prompt FROM part, p"
)
def phrase_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompts of every part's name."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name").toDF("pos", "phrase")
    return labels.prompted(p).select("pos", "prompt")


@query(
    f"WITH {MEDIA_SQL}, enc AS (SELECT vec_id % 50 AS phrase, {_UNIT.format('v')} AS u FROM media0), means AS ({_MEAN.format(k='phrase', v='u', t='enc')}), e AS (SELECT phrase, {_UNIT.format('mean')} AS c FROM means) SELECT phrase, unnest(range(1, len(c) + 1)) AS i, round(unnest(c), 6) AS x FROM e"
)
def template_ensemble_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = labels.ensembled(files(spark, sf_dir).select((F.col("vec_id") % 50).alias("phrase"), "v"))
    return e.select("phrase", F.posexplode("embedding").alias("_i", "x")).select("phrase", (F.col("_i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))
