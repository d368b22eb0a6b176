"""Density clustering and its radius."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.catalog import query
from fathom.operators import density
from fathom.operators import layout as neighbour
from fathom.sources.tables import table
from fathom.sources.surrogates import LAYOUT_SQL, layout

_DBSCAN = f"""{LAYOUT_SQL},
near AS (SELECT a.vec_id AS u, b.vec_id AS v FROM layout a JOIN layout b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.2::DOUBLE * 0.2::DOUBLE),
core AS (SELECT u FROM near GROUP BY u HAVING count(*) >= 10),
link AS (SELECT u, v FROM near WHERE u IN (FROM core) AND v IN (FROM core)),
reach(a, b) AS (SELECT u, u FROM core UNION SELECT reach.a, link.v FROM reach JOIN link ON reach.b = link.u),
root AS (SELECT a AS u, min(b) AS root FROM reach GROUP BY a),
num AS (SELECT u, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM root),
border AS (SELECT near.v AS u, min(cluster) AS cluster FROM near JOIN num ON near.u = num.u GROUP BY near.v),
labels AS (SELECT vec_id, coalesce(num.cluster, border.cluster, -1)::INTEGER AS cluster FROM layout LEFT JOIN num ON vec_id = num.u LEFT JOIN border ON vec_id = border.u)"""


@query(f"WITH RECURSIVE {_DBSCAN} SELECT vec_id, cluster FROM labels")
def dbscan_fixed_eps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.dbscan(layout(spark, sf_dir), 0.2, 10, "vec_id").select(F.col("node").alias("vec_id"), "cluster")


@query(f"WITH RECURSIVE {_DBSCAN} SELECT cluster, count(*) AS size FROM labels WHERE cluster <> -1 GROUP BY cluster")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.dbscan(layout(spark, sf_dir), 0.2, 10, "vec_id").where("cluster <> -1").groupBy("cluster").agg(F.count("*").alias("size"))


@query()
def adaptive_eps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen radius and the largest cluster's share at it."""
    points = layout(spark, sf_dir)
    eps = density.resolved_eps(points, node="vec_id")
    share = density.top_share(density.dbscan(points, eps, node="vec_id"))
    return spark.range(1).select(F.lit(eps).alias("eps"), F.lit(share).alias("top_share"))


_RADII = (0.4, 0.2, 0.1)
_PAIRS = " UNION ALL ".join(f"SELECT {r}::DOUBLE AS eps, count(*) AS pairs FROM layout a JOIN layout b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {r}::DOUBLE * {r}::DOUBLE" for r in _RADII)


@query(f"WITH {LAYOUT_SQL}, p AS ({_PAIRS}) SELECT eps, true AS bounded, pairs > 4 * n AS over FROM p, (SELECT count(*) AS n FROM layout)")
def pair_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For three radii: whether the bounds from squares agree with the decision over four pairs a point, and the decision."""
    points = layout(spark, sf_dir)
    budget = 4 * points.count()
    bounds = density.pair_bounds(points, list(_RADII), "vec_id")
    over = [density.exceeds(points, r, budget, "vec_id") for r in _RADII]
    rows = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(r).alias("eps"), F.lit((lo <= budget or o) and (up > budget or not o)).alias("bounded"), F.lit(o).alias("over")) for r, (lo, up), o in zip(_RADII, bounds, over)])).alias("r"))
    return rows.select("r.*")


@query()
def neighbour_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded layout of all vectors by their neighbours; to the third place, as sums differ in their last digits."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    at = neighbour.neighbour_layout(e.select(F.col("vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("v")))
    return at.select(F.col("node").alias("vec_id"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))
