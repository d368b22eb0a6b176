"""Near-duplicate pairs and groups, and neighbour joins of the layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.catalog import query
from fathom.functions.media import media_type
from fathom.operators import density, neighbours
from fathom.operators.components import connected_components
from fathom.plans.scratch import Scratch
from fathom.sources.surrogates import LAYOUT_SQL, MEDIA_SQL, files, layout

_UNIT = "(SELECT vec_id, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-12)) AS w FROM media0 WHERE filename NOT LIKE '%.mp4')"
_PAIRS = f"p AS (SELECT a.vec_id AS u, b.vec_id AS v, round(list_dot_product(a.w, b.w), 6) AS cosine FROM {_UNIT} a JOIN {_UNIT} b ON a.vec_id < b.vec_id WHERE round(list_dot_product(a.w, b.w), 6) >= 0.40)"


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where(media_type(F.col("filename")) == "image").select(F.col("vec_id").alias("node"), "v")


@query(f"WITH {MEDIA_SQL}, {_PAIRS} SELECT * FROM p")
def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.cosine_pairs(_images(spark, sf_dir), 0.40)


@query(
    f"""WITH RECURSIVE {MEDIA_SQL}, {_PAIRS}, e AS (SELECT u, v FROM p UNION SELECT v, u FROM p),
r(a, b) AS (SELECT u, u FROM e UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u)
SELECT a AS vec_id, min(b) AS component, count(*) AS size FROM r GROUP BY a"""
)
def near_duplicate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of each image that has a near-duplicate. Equal vectors are one node until the end."""
    scratch = Scratch(spark, "near-images")
    own = scratch.table(_images(spark, sf_dir), "images")
    classes = scratch.table(own.groupBy("v").agg(F.min("node").alias("node"), F.count("*").alias("copies")), "classes")
    pairs = neighbours.cosine_pairs(classes, 0.40)
    groups = connected_components(pairs.select("u", "v"), scratch)
    named = classes.join(groups.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("v", "copies", F.coalesce("component", "node").alias("component"))
    sizes = named.groupBy("component").agg(F.sum("copies").alias("size")).where("size > 1")
    return own.join(named.select("v", "component"), "v").join(sizes, "component").select(F.col("node").alias("vec_id"), "component", "size")


@query(
    f"WITH {LAYOUT_SQL}, d AS (SELECT a.vec_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS r FROM layout a JOIN layout b ON a.vec_id <> b.vec_id) SELECT vec_id, round(d, 6) AS d FROM d WHERE r = 10"
)
def knn_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.k_distances(layout(spark, sf_dir), 10, "vec_id").select(F.col("node").alias("vec_id"), F.round("d", 6).alias("d"))


@query(
    f"WITH {LAYOUT_SQL}, d AS (SELECT a.vec_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS r FROM layout a JOIN layout b ON a.vec_id <> b.vec_id), k AS (SELECT d FROM d WHERE r = 10) "
    + " UNION ALL ".join(f"SELECT {int(q * 100)} AS q, round(quantile_cont(d, {q}::DOUBLE), 6) AS d FROM k" for q in density.QUANTILES)
)
def k_distance_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = neighbours.k_distances(layout(spark, sf_dir), 10, "vec_id")
    qs = d.agg(F.percentile("d", F.array(*map(F.lit, density.QUANTILES))).alias("q"))
    return qs.select(F.posexplode("q").alias("_i", "d")).select(((F.col("_i") + 4) * 10).alias("q"), F.round("d", 6).alias("d"))


@query(f"WITH {LAYOUT_SQL} SELECT a.vec_id, count(*) AS n FROM layout a JOIN layout b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.2::DOUBLE * 0.2::DOUBLE GROUP BY 1")
def eps_neighbor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.neighbour_counts(layout(spark, sf_dir), 0.2, "vec_id").select(F.col("node").alias("vec_id"), "n")


@query(f"WITH {LAYOUT_SQL} SELECT count(*) AS pairs, count(*) <= 50000000 AS fits FROM layout a JOIN layout b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.3::DOUBLE * 0.3::DOUBLE")
def pair_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neighbours.grid_pairs(layout(spark, sf_dir), 0.3, "vec_id")
    return pairs.agg(F.count("*").alias("pairs"), (F.count("*") <= density.PAIR_BUDGET).alias("fits"))
