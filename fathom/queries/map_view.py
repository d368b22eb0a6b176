"""Map analytics: axes, landmarks, colours, walks and navigation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.catalog import query
from fathom.operators import map_view as mv
from fathom.sources.surrogates import LAYOUT_SQL, MEDIA_SQL, layout, media
from fathom.sources.tables import table

_MARKS = f"""{LAYOUT_SQL}, s AS (SELECT label, avg(x) AS m, stddev_pop(x) AS sd, max(x) - min(x) AS x_range, count(*) AS size FROM layout GROUP BY label),
near AS (SELECT * FROM layout JOIN s USING (label) WHERE abs(x - m) <= greatest(sd * 0.5, x_range * 0.2)),
marks AS (SELECT label AS cluster, size, x_range, arg_max(vec_id, struct_pack(y := y, p := -vec_id)) AS idx, arg_max(x, struct_pack(y := y, p := -vec_id)) AS x, max(y) AS y FROM near GROUP BY 1, 2, 3)"""


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = layout(spark, sf_dir).select(F.col("vec_id").alias("idx"), "x", "y", F.col("label").alias("cluster"))
    return mv.landmarks(own)


@query(f"WITH {LAYOUT_SQL} SELECT round(quantile_cont(x, 0.01::DOUBLE), 6) AS x_min, round(quantile_cont(x, 0.99::DOUBLE), 6) AS x_max, round(quantile_cont(y, 0.01::DOUBLE), 6) AS y_min, round(quantile_cont(y, 0.99::DOUBLE), 6) AS y_max FROM layout")
def axis_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = mv.axis_bounds(layout(spark, sf_dir))
    return b.select(*[F.round(c, 6).alias(c) for c in b.columns])


@query(f"WITH {_MARKS} SELECT cluster, idx, round(x, 6) AS x, round(y, 6) AS y, size, round(least(greatest(x_range / 10, 0.2), 2.0), 6) AS mark_size FROM marks")
def landmark_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _marks(spark, sf_dir)
    return m.select("cluster", "idx", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "size", F.round(mv.landmark_size(F.col("x_range")), 6).alias("mark_size"))


@query(f"WITH {_MARKS} SELECT cluster, size FROM marks WHERE x BETWEEN -1 AND 1 AND y BETWEEN 0 AND 4 ORDER BY size DESC, cluster LIMIT 5")
def clusters_in_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mv.in_view(_marks(spark, sf_dir), (-1.0, 1.0), (0.0, 4.0), 5).select("cluster", "size")


@query()
def landmarks_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mv.without_overlap(_marks(spark, sf_dir), 0.3).select("cluster", "idx", "size")


@query(
    f"WITH {MEDIA_SQL}, c AS (SELECT CASE WHEN label = 4 THEN -1 ELSE label END AS cluster, min(vec_id) AS f FROM media0 GROUP BY 1) SELECT cluster, CASE WHEN cluster = -1 THEN 'grey' ELSE ((row_number() OVER (ORDER BY f) - 1) % 17)::VARCHAR END AS colour FROM c"
)
def cluster_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings", "vec_id", "label")
    own = e.select(F.col("vec_id").alias("raw_pos"), F.when(F.col("label") == 4, -1).otherwise(F.col("label")).alias("cluster"))
    return mv.palette(own)


@query(f"WITH {LAYOUT_SQL}, m AS (SELECT * FROM layout WHERE label = 2), s AS (SELECT x AS sx, y AS sy FROM m ORDER BY vec_id LIMIT 1) SELECT vec_id, row_number() OVER (ORDER BY sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)), vec_id) - 1 AS step FROM m, s")
def proximity_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = layout(spark, sf_dir).where("label = 2")
    return mv.proximity_order(m, m.agg(F.min("vec_id")).first()[0], "vec_id").select("vec_id", "step")


@query()
def greedy_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk through every cluster from its first member."""
    own = layout(spark, sf_dir).select("vec_id", "x", "y", F.col("label").alias("cluster"))
    return mv.greedy_walk(own, own.groupBy("cluster").agg(F.min("vec_id").alias("vec_id")), idx="vec_id")


@query(
    f"WITH {MEDIA_SQL}, n AS (SELECT count(*) AS n FROM media) SELECT idx, CASE WHEN idx + 1 < n THEN idx + 1 END AS next_idx, CASE WHEN n > 1 THEN (idx - 1 + n) % n END AS previous_wrapped FROM media, n"
)
def lead_lag_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = media(spark, sf_dir).select("idx")
    n = F.lit(own.count())
    return own.select("idx", mv.neighbour_in_order(F.col("idx"), n, 1, False).alias("next_idx"), mv.neighbour_in_order(F.col("idx"), n, -1, True).alias("previous_wrapped"))


@query(f"WITH {_MARKS} SELECT l.vec_id AS idx, arg_min(m.cluster, m.cluster) AS cluster FROM layout l JOIN marks m ON abs(l.x - m.x) <= 0.5 AND abs(l.y - m.y) <= 0.5 GROUP BY 1")
def landmark_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = _marks(spark, sf_dir).select("cluster", F.col("cluster").alias("place"), "x", "y")
    return mv.hit(layout(spark, sf_dir).select(F.col("vec_id").alias("idx"), "x", "y"), marks, 0.5, 0.5)


@query(f"WITH {LAYOUT_SQL} SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'result' ELSE 'other' END AS part, CASE WHEN label = 4 THEN 0.2::DOUBLE ELSE 0.75::DOUBLE END AS opacity FROM layout")
def highlight_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in the search results, and the rest."""
    own = layout(spark, sf_dir).select("vec_id", F.when(F.col("label") == 4, -1).otherwise(F.col("label")).alias("cluster"))
    results = own.where("vec_id % 3 = 0").select("vec_id")
    cols = lambda part: ["vec_id", F.lit(part).alias("part"), mv.opacity(F.col("cluster"), True).alias("opacity")]
    return own.join(results, "vec_id", "left_semi").select(*cols("result")).union(own.join(results, "vec_id", "left_anti").select(*cols("other")))


@query("SELECT conv_id, turn, lead(turn) OVER w AS next_turn, lag(turn) OVER w AS previous_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def sequence_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations", "conv_id", "turn").select("conv_id", "turn", F.lead("turn").over(w).alias("next_turn"), F.lag("turn").over(w).alias("previous_turn"))
