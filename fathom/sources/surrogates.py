"""The input tables as media: an index of files with vectors, and a two-dimensional layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators.index import global_index
from fathom.plans.scratch import Scratch
from fathom.sources.tables import table

#: The same tables in SQL, as common table expressions.
MEDIA_SQL = """media0 AS (SELECT vec_id, ((vec_id * 7919) % 97)::DOUBLE AS mtime, 'dir' || (vec_id % 7) || '/img_' || lpad(vec_id::VARCHAR, 5, '0')
    || CASE WHEN vec_id % 10 = 0 THEN '.mp4' ELSE '.jpg' END AS filename, label, embedding::DOUBLE[] AS v FROM embeddings),
media AS (SELECT *, row_number() OVER (ORDER BY mtime, filename) - 1 AS idx FROM media0)"""
LAYOUT_SQL = "layout AS (SELECT vec_id, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, label FROM embeddings)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, mtime, filename, label, v of each row, without the global order."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    name = F.concat(
        F.lit("dir"), (F.col("vec_id") % 7).cast("string"), F.lit("/img_"), F.lpad(F.col("vec_id").cast("string"), 5, "0"),
        F.when(F.col("vec_id") % 10 == 0, ".mp4").otherwise(".jpg"),
    )
    return e.select("vec_id", F.pmod(F.col("vec_id") * 7919, F.lit(97)).cast("double").alias("mtime"), name.alias("filename"), "label", F.col("embedding").cast("array<double>").alias("v"))


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files with idx, the position by time and name; names are cut to five digits, so from id 100000 on two files can have both: then by id."""
    return global_index(files(spark, sf_dir), ["mtime", "filename", "vec_id"], Scratch(spark, "media"))


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    at = lambda i: F.element_at("embedding", i).cast("double") * 10
    return e.select("vec_id", at(1).alias("x"), at(2).alias("y"), "label")
