"""Positions, pages and views; what is shown with points and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.catalog import query
from fathom.operators import index as ix
from fathom.operators import map_view as mv
from fathom.operators import navigation as nav
from fathom.sources.surrogates import LAYOUT_SQL, MEDIA_SQL, files, layout, media
from fathom.sources.tables import table


@query(f"WITH {MEDIA_SQL} SELECT idx, filename, mtime FROM media WHERE idx = 37")
def image_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.image_info(media(spark, sf_dir), 37, "filename", "mtime")


@query("SELECT event_id, greatest(0, least(user_id - 50, 99)) AS idx, floor((user_id - 50) / 30.0)::BIGINT * 30 AS page, floor(user_id + 1000.0 * (event_id % 7) / 6 + 0.5)::BIGINT AS tick FROM events")
def clamped_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "user_id")
    at = F.col("user_id") - 50
    return e.select(
        "event_id", nav.clamped(at, F.lit(100)).alias("idx"), nav.page_start(at, 30).alias("page"),
        nav.tick(F.col("user_id"), F.col("user_id") + 1000, F.col("event_id") % 7, 7).alias("tick"),
    )


@query("SELECT o_orderkey FROM orders WHERE o_orderkey // 50 = 2 AND o_custkey % 3 <> 0")
def page_without_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    return nav.page(o, o.where("o_custkey % 3 = 0"), 120, 50, "o_orderkey").select("o_orderkey")


@query("SELECT event_id FROM events WHERE event_id * 3 - 500 >= 0 AND event_id * 3 - 500 < 900")
def refreshed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id").withColumn("idx", F.col("event_id") * 3 - 500)
    return nav.refreshed(e, 900).select("event_id")


@query(
    f"WITH {LAYOUT_SQL} SELECT vec_id, CASE WHEN x < -0.8 OR x > 0.8 THEN x - 1.0 ELSE -1.0 END AS low, CASE WHEN x < -0.8 OR x > 0.8 THEN x + 1.0 ELSE 1.0 END AS high FROM layout"
)
def recentred_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = nav.recentred(F.col("x"), F.lit(-1.0), F.lit(1.0))
    return layout(spark, sf_dir).select("vec_id", view.alias("view")).select("vec_id", "view.low", "view.high")


@query(
    "SELECT o_orderkey, (o_orderkey + 1) || '/' || (o_orderkey + 100) || ' (score=' || printf('%.4f', (o_custkey % 1000) / 1000.0) || ')' AS said, (o_orderkey % 90)::DOUBLE / 90 * 100 AS percent, CASE WHEN o_orderkey % 90 > 0 THEN 12.0 / (o_orderkey % 90) * (90 - o_orderkey % 90) END AS left_s FROM orders"
)
def result_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    said = nav.score_text(F.col("o_orderkey"), F.col("o_orderkey") + 100, F.col("o_custkey") % 1000 / 1000.0)
    done = nav.progress(F.col("o_orderkey") % 90, F.lit(90), F.lit(12.0))
    return o.select("o_orderkey", said.alias("said"), done.alias("p")).select("o_orderkey", "said", "p.percent", F.col("p.left").alias("left_s"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%y') AS day, strftime(o_orderdate, '%m/%Y') AS month FROM orders")
def shown_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    return o.select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yy").alias("day"), F.date_format("o_orderdate", "MM/yyyy").alias("month"))


_POINTS = f"WITH {LAYOUT_SQL}, p AS (SELECT vec_id AS idx, x, y, CASE WHEN label < 3 THEN -1 ELSE label END AS cluster FROM layout)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    cluster = F.when(F.col("label") < 3, -1).otherwise(F.col("label"))
    return layout(spark, sf_dir).select(F.col("vec_id").alias("idx"), "x", "y", cluster.alias("cluster"))


@query(f"{_POINTS} SELECT idx, cluster, 'c' || cluster AS colour, count(*) OVER (PARTITION BY cluster) AS size FROM p")
def point_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    colours = p.select("cluster").distinct().withColumn("colour", F.concat(F.lit("c"), F.col("cluster").cast("string")))
    return mv.point_info(p, colours)


@query(f"{_POINTS}, m AS (SELECT cluster, min(idx) AS idx, max(idx) AS medoid FROM p WHERE cluster <> -1 GROUP BY cluster) SELECT cluster, CASE WHEN medoid % 2 = 0 THEN medoid ELSE idx END AS idx FROM m")
def landmark_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The medoid of a landmark where it is among the visible points (here the even ones), else its own point."""
    p = _points(spark, sf_dir)
    own = p.where("cluster <> -1").groupBy("cluster")
    return mv.representatives(own.agg(F.min("idx").alias("idx")), own.agg(F.max("idx").alias("idx")), p.where("idx % 2 = 0"))


@query(f"{_POINTS} SELECT idx, CASE WHEN idx % 5 = 0 THEN 'high' ELSE 'low' END AS band FROM p WHERE idx % 5 IN (0, 1) AND idx % 3 <> 0")
def curation_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    bands = p.where("idx % 5 IN (0, 1)").select("idx", F.when(F.col("idx") % 5 == 0, "high").otherwise("low").alias("band"))
    return mv.overlay(p, bands, p.where("idx % 3 = 0")).select("idx", "band")


@query(f"WITH {MEDIA_SQL} SELECT bool_or(filename LIKE '%.mp4') AS has_video FROM media0")
def any_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).agg(F.bool_or(F.col("filename").endswith(".mp4")).alias("has_video"))


_KEYS = ", ".join(f"{k}::BIGINT" for k in nav._keys(7, 3))


def _once(x: str) -> str:
    h = lambda v: f"((({v}) * {nav._FACTOR} + k // 2) % {nav._PRIME})"
    right, left = h("z % b"), h("z // b")
    return f"list_reduce(list_prepend({x}, [{_KEYS}]), lambda z, k: CASE WHEN k % 2 = 0 THEN (z // b + {right} * {right} % {nav._PRIME}) % a * b + z % b ELSE z // b * b + (z % b + {left} * {left} % {nav._PRIME}) % b END)"


@query(
    f"""WITH s AS (SELECT count(*) AS n, floor(sqrt(count(*) - 1))::BIGINT + 1 AS a FROM embeddings), c AS (SELECT n, a, (n + a - 1) // a AS b FROM s),
    p AS (SELECT vec_id, list_reduce(list_prepend({_once('vec_id')}, range(1, a + 1)), lambda y, i: CASE WHEN y < n THEN y ELSE {_once('y')} END) AS place, n FROM embeddings, c),
    q AS (SELECT vec_id, place, n, vec_id = 0 AND place = 0 AS again FROM p)
    SELECT vec_id, CASE WHEN (SELECT bool_or(again) FROM q) AND place IN (0, n - 1) THEN n - 1 - place ELSE place END AS turn FROM q"""
)
def random_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's turn in a seeded random round, in which row 0, being shown, is not the first."""
    e = table(spark, sf_dir, "embeddings", "vec_id")
    return nav.shuffled(e, e.count(), seed=7, round_=3, shown=0, idx="vec_id").select("vec_id", F.col("_turn").alias("turn"))
