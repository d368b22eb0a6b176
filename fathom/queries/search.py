"""Hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.catalog import query
from fathom.operators import search as s
from fathom.sources.surrogates import MEDIA_SQL, files, media
from fathom.sources.tables import table

_UNIT = "list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-12))"
_COS = "list_dot_product({}, (SELECT v FROM media0 WHERE vec_id = {}))"


def _queries(spark: SparkSession, sf_dir: str, *ids: int) -> list[list[float]]:
    """Query vectors; these are stated rows of fixed number."""
    rows = {r["vec_id"]: list(r["v"]) for r in files(spark, sf_dir).where(F.col("vec_id").isin(*ids)).select("vec_id", "v").collect()}
    return [rows[i] for i in ids]


@query(f"WITH {MEDIA_SQL}, u AS (SELECT idx, {_UNIT} AS w FROM media), s AS (SELECT idx, round({_COS.format('w', 7)}, 6) AS score FROM u) SELECT * FROM s WHERE score >= 0.1 ORDER BY score DESC, idx LIMIT 20")
def hybrid_search_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    (q,) = _queries(spark, sf_dir, 7)
    return s.search_files(files(spark, sf_dir), ["mtime", "filename"], 20, 0.1, image=q, digits=6)


@query(
    f"WITH {MEDIA_SQL}, u AS (SELECT idx, {_UNIT} AS w FROM media), s AS (SELECT idx, round((0.5 * {_COS.format('w', 7)} + 0.8 * {_COS.format('w', 11)}) / 1.3 - 0.4 * {_COS.format('w', 23)}, 6) AS score FROM u) SELECT * FROM s WHERE score >= 0.05 ORDER BY score DESC, idx LIMIT 50"
)
def hybrid_search_multimodal_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = _queries(spark, sf_dir, 7, 11, 23)
    return s.search_files(files(spark, sf_dir), ["mtime", "filename"], 50, 0.05, image=a, positive=b, negative=c, weights=(0.5, 0.8, 0.4), digits=6)


@query(
    f"WITH {MEDIA_SQL}, u AS (SELECT idx, {_UNIT} AS w FROM media), l AS (SELECT idx, {_COS.format('w', 11)} * exp(2.0) - 1.5 AS l FROM u), s AS (SELECT idx, round(CASE WHEN l >= 0 THEN 1 / (1 + exp(-l)) ELSE exp(l) / (1 + exp(l)) END, 6) AS score FROM l) SELECT * FROM s WHERE score >= 0.005 ORDER BY score DESC, idx LIMIT 30"
)
def search_calibrated_sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    (q,) = _queries(spark, sf_dir, 11)
    return s.search_files(files(spark, sf_dir), ["mtime", "filename"], 30, 0.005, positive=q, scale=2.0, bias=-1.5, digits=6)


@query(f"WITH {MEDIA_SQL}, u AS (SELECT idx, {_UNIT} AS w FROM media), s AS (SELECT idx, round(0 - 0.5 * {_COS.format('w', 23)}, 6) AS score FROM u) SELECT * FROM s WHERE score >= 0.1 ORDER BY score DESC, idx LIMIT 10")
def search_negative_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query of negatives alone gives what is least like them."""
    (q,) = _queries(spark, sf_dir, 23)
    return s.search_files(files(spark, sf_dir), ["mtime", "filename"], 10, 0.1, negative=q, digits=6)


@query(
    "SELECT p_partkey, p_brand AS spec, CASE WHEN p_partkey % 4 = 0 THEN 0.005 WHEN p_partkey % 4 = 1 THEN 0.2 ELSE 0.1 END::DOUBLE AS floor FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'siglip:' WHEN 1 THEN 'openai-clip:' WHEN 2 THEN 'open-clip:' ELSE 'other:' END || p_brand AS p_brand FROM part)"
)
def search_default_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    backend = F.when(k == 0, "siglip:").when(k == 1, "openai-clip:").when(k == 2, "open-clip:").otherwise("other:")
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand").select("p_partkey", F.concat(backend, "p_brand").alias("spec"))
    return p.select("p_partkey", "spec", s.default_floor(F.col("spec")).alias("floor"))


@query(
    f"WITH {MEDIA_SQL}, u AS (SELECT vec_id, {_UNIT} AS w FROM media0), p AS (SELECT q.vec_id AS query, u.vec_id AS idx, list_dot_product(u.w, q.v) AS score FROM (SELECT * FROM media0 WHERE vec_id % 20 = 0) q, u), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, idx) AS rank FROM p) SELECT query, idx, round(score, 6) AS score, rank FROM r WHERE rank <= 5"
)
def search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth row as a query against all rows."""
    f = files(spark, sf_dir)
    q = f.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("v").alias("q"))
    return s.search_batch(f, q, 5, idx="vec_id").select("query", "idx", F.round("score", 6).alias("score"), "rank")
