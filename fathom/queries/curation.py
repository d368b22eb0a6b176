"""Sampling, votes and curation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.catalog import query
from fathom.functions.media import basename, parent_name
from fathom.operators import sampling
from fathom.sources.surrogates import MEDIA_SQL, files, media
from fathom.sources.tables import table


@query()
def fps_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty rows, each the farthest from those before it; from row 0."""
    return sampling.farthest_points(files(spark, sf_dir), 20, [0], "vec_id").select("step", F.col("idx").alias("vec_id"))


@query()
def kmeans_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.kmeans_representatives(files(spark, sf_dir), 10, 7, "vec_id").select("cluster", F.col("idx").alias("vec_id"))


@query(f"WITH {MEDIA_SQL}, c AS (SELECT label, v AS c FROM media0 WHERE vec_id IN (SELECT min(vec_id) FROM media0 GROUP BY label)), d AS (SELECT m.label AS cluster, m.vec_id, round(sqrt(list_sum(list_transform(list_zip(m.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9) AS distance FROM media0 m JOIN c USING (label) WHERE m.vec_id % 2 = 1) SELECT cluster, arg_min(vec_id, struct_pack(d := distance, p := vec_id)) AS vec_id FROM d GROUP BY cluster")
def representative_of_fixed_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    centres = f.groupBy("label").agg(F.min_by("v", "vec_id").alias("c"))
    gap = F.zip_with("v", "c", lambda a, b: (a - b) * (a - b))
    d = F.round(F.sqrt(F.aggregate(gap, F.lit(0.0), lambda acc, x: acc + x)), 9)
    own = f.where("vec_id % 2 = 1").join(centres, "label").select(F.col("label").alias("cluster"), "vec_id", d.alias("distance"))
    return sampling.nearest_to_centres(own, order="vec_id", idx="vec_id")


@query()
def curation_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five runs of farthest-point sampling, and the fifteen rows with most votes; every seventh row is excluded."""
    own = media(spark, sf_dir).select("idx", "filename", "v")
    out = sampling.curate(own, 15, 5, 42, own.where("idx % 7 = 3").select("idx"))
    named = out.join(own.select("idx", "filename"), "idx")
    return named.select("idx", basename(F.col("filename")).alias("filename"), parent_name(F.col("filename")).alias("subfolder"), "count", "frequency", "selected")


@query("SELECT user_id, event_type, count(*) AS count, round_even(count(*) / 30.0 * 100, 1)::DOUBLE AS frequency FROM events GROUP BY 1, 2")
def vote_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "user_id", "event_type")
    return e.groupBy("user_id", "event_type").agg(F.count("*").alias("count")).withColumn("frequency", F.bround(F.col("count") / 30.0 * 100, 1))


@query(
    "WITH f AS (SELECT user_id, coalesce(nullif(least(100, count(*) * 7 % 101), 0), 100) AS f FROM events GROUP BY 1) SELECT CASE WHEN f >= 90 THEN 'high' WHEN f >= 70 THEN 'mid' ELSE 'low' END AS bucket, count(*) AS n FROM f GROUP BY 1"
)
def curation_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "events", "user_id").groupBy("user_id").agg(F.least(F.lit(100), F.count("*") * 7 % 101).cast("double").alias("f"))
    return f.groupBy(sampling.bucket(F.col("f")).alias("bucket")).agg(F.count("*").alias("n"))


@query("WITH f AS (SELECT user_id, count(*) AS c FROM events GROUP BY 1) SELECT user_id FROM f WHERE c * 7 % 101 >= 90 AND user_id % 4 <> 0")
def bulk_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newly excluded rows: those at the threshold that are not excluded yet."""
    f = table(spark, sf_dir, "events", "user_id").groupBy("user_id").agg((F.count("*") * 7 % 101).alias("f"))
    return f.where("f >= 90").select("user_id").join(f.where("user_id % 4 = 0").select("user_id"), "user_id", "left_anti")


@query(
    "SELECT 'Included' AS status, user_id, count(*) AS votes FROM events WHERE event_type = 'purchase' GROUP BY 2 UNION ALL SELECT 'Excluded', user_id, 0 FROM (SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase'))"
)
def curation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "user_id", "event_type")
    taken = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("votes"))
    left = e.select("user_id").distinct().join(taken, "user_id", "left_anti")
    return taken.select(F.lit("Included").alias("status"), "user_id", "votes").union(left.select(F.lit("Excluded"), "user_id", F.lit(0).cast("long")))
