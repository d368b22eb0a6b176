"""What a map of the layout shows: axes, landmarks, colours and walks through a cluster."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.operators.index import global_index
from fathom.plans.scratch import Scratch

WALK_LIMIT = 5000
PALETTE_SIZE = 17
NOISE_COLOUR = "grey"


def axis_bounds(points: DataFrame) -> DataFrame:
    q = F.array(F.lit(0.01), F.lit(0.99))
    p = points.agg(F.percentile("x", q).alias("x"), F.percentile("y", q).alias("y"))
    at = lambda c, i: F.coalesce(F.get(F.col(c), F.lit(i)), F.lit(0.0))
    return p.select(at("x", 0).alias("x_min"), at("x", 1).alias("x_max"), at("y", 0).alias("y_min"), at("y", 1).alias("y_max"))


def landmarks(points: DataFrame, cluster: str = "cluster", idx: str = "idx") -> DataFrame:
    """(cluster, idx, x, y, size, x_range): the highest point near a cluster's middle, the first in order among equals."""
    own = points.where(F.col(cluster) != -1)
    spread = own.groupBy(cluster).agg(F.avg("x").alias("_m"), F.stddev_pop("x").alias("_s"), (F.max("x") - F.min("x")).alias("x_range"), F.count("*").alias("size"))
    near = own.join(spread, cluster).where(F.abs(F.col("x") - F.col("_m")) <= F.greatest(F.col("_s") * 0.5, F.col("x_range") * 0.2))
    best = near.groupBy(cluster, "size", "x_range").agg(F.max_by(F.struct(idx, "x", "y"), F.struct("y", -F.col(idx))).alias("_b"))
    return best.select(cluster, f"_b.{idx}", "_b.x", "_b.y", "size", "x_range")


def landmark_size(x_range: Column) -> Column:
    return F.least(F.greatest(x_range / 10, F.lit(0.2)), F.lit(2.0))


def in_view(marks: DataFrame, x: tuple[float, float], y: tuple[float, float], most: int = 10, cluster: str = "cluster") -> DataFrame:
    """The largest clusters whose landmark is in the view."""
    return marks.where(F.col("x").between(*x) & F.col("y").between(*y)).orderBy(F.desc("size"), cluster).limit(most)


def without_overlap(marks: DataFrame, size: float, most: int = 18, cluster: str = "cluster") -> DataFrame:
    """Of the 100 largest clusters, landmarks placed largest first where none placed before is in the way."""

    def place(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (-r["size"], r[cluster]))
        placed: list[dict] = []
        for r in rows:
            if len(placed) < most and not any(abs(r["x"] - p["x"]) < size and abs(r["y"] - p["y"]) < size for p in placed):
                placed.append(r)
        return pa.Table.from_pylist(placed, t.schema)

    return marks.orderBy(F.desc("size"), cluster).limit(100).groupBy().applyInArrow(place, marks.schema)


def palette(points: DataFrame, cluster: str = "cluster", order: str = "raw_pos") -> DataFrame:
    """(cluster, colour): clusters take colours in order of first appearance, noise among them, though noise stays grey."""
    seen = points.groupBy(cluster).agg(F.min(order).alias("_first"))
    place = F.row_number().over(Window.orderBy("_first")) - 1
    return seen.select(cluster, F.when(F.col(cluster) == -1, NOISE_COLOUR).otherwise(F.pmod(place, F.lit(PALETTE_SIZE)).cast("string")).alias("colour"))


def opacity(cluster: Column, highlighting: bool = False) -> Column:
    return F.when(cluster == -1, 0.2 if highlighting else 0.08).otherwise(0.75)


def proximity_order(members: DataFrame, start: int, idx: str = "idx") -> DataFrame:
    """(idx, step) by distance to the start."""
    at = members.where(F.col(idx) == start).select(F.col("x").alias("_x"), F.col("y").alias("_y")).limit(1)
    d = F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y"))
    near = members.crossJoin(F.broadcast(at)).select(idx, d.alias("_d"))
    return global_index(near, ["_d", idx], Scratch(members.sparkSession, "proximity"), "step").select(idx, F.col("step").cast("int").alias("step"))


def greedy_walk(members: DataFrame, starts: DataFrame, cluster: str = "cluster", idx: str = "idx") -> DataFrame:
    """(cluster, idx, step): from the start always on to the nearest point not yet visited.

    Clusters above WALK_LIMIT members are ordered by distance to their start instead, by ranges of cluster and distance; so no
    task holds more than WALK_LIMIT rows of a walk, or a whole cluster above it.
    """
    sizes = members.groupBy(cluster).agg(F.count("*").alias("_n"))
    held = members.join(sizes, cluster).join(starts.select(F.col(cluster), F.col(idx).alias("_start")), cluster).select(cluster, idx, "x", "y", "_n", "_start")
    schema = members.select(cluster, idx).schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", step int"

    def walk(t: pa.Table) -> pa.Table:
        t = t.sort_by(idx)
        ids, x, y = (t.column(c).to_numpy() for c in (idx, "x", "y"))
        left = np.ones(len(ids), bool)
        at = int(np.flatnonzero(ids == t.column("_start")[0].as_py())[0])
        path = [at]
        left[at] = False
        while left.any():
            d = np.where(left, np.hypot(x - x[at], y - y[at]), np.inf)
            at = int(d.argmin())
            left[at] = False
            path.append(at)
        return pa.table({cluster: t.column(cluster).combine_chunks().take(pa.array(path)), idx: pa.array(ids[path]), "step": pa.array(np.arange(len(path), dtype=np.int32))})

    short = held.where(F.col("_n") <= WALK_LIMIT).groupBy(cluster).applyInArrow(walk, schema)
    long = held.where(F.col("_n") > WALK_LIMIT)
    at = long.where(F.col(idx) == F.col("_start")).select(cluster, F.col("x").alias("_x"), F.col("y").alias("_y"))
    d = F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y"))
    scratch = Scratch(members.sparkSession, "walk")
    far = scratch.table(global_index(long.join(at, cluster).select(cluster, idx, d.alias("_d")), [cluster, "_d", idx], scratch, "_at"), "far")
    first = far.groupBy(cluster).agg(F.min("_at").alias("_first"))
    far = far.join(F.broadcast(first), cluster).select(cluster, idx, (F.col("_at") - F.col("_first")).cast("int").alias("step"))
    return short.union(far)


def neighbour_in_order(idx: Column, n: Column, offset: int, wrap: bool) -> Column:
    """The position offset away; round the ends if wrap is set, null beyond them otherwise, and null if there is no other."""
    to = idx + offset
    return F.when(F.lit(wrap), F.when(n > 1, F.pmod(to, n))).otherwise(F.when((to >= 0) & (to < n), to))


def hit(points: DataFrame, marks: DataFrame, half_x: float, half_y: float, cell: float | None = None) -> DataFrame:
    """(idx, cluster): the first landmark whose box holds a point; joined by squares as wide as a box, not all with all."""
    w, h = 2 * half_x, 2 * half_y
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    m = marks.select("cluster", "place", F.col("x").alias("_x"), F.col("y").alias("_y"), F.explode(steps).alias("_s"))
    m = m.select("cluster", "place", "_x", "_y", (F.floor(F.col("_x") / w) + F.col("_s.i")).alias("_cx"), (F.floor(F.col("_y") / h) + F.col("_s.j")).alias("_cy"))
    p = points.select("idx", "x", "y", F.floor(F.col("x") / w).alias("_cx"), F.floor(F.col("y") / h).alias("_cy"))
    inside = (F.abs(F.col("x") - F.col("_x")) <= half_x) & (F.abs(F.col("y") - F.col("_y")) <= half_y)
    return p.join(m, ["_cx", "_cy"]).where(inside).groupBy("idx").agg(F.min_by("cluster", "place").alias("cluster"))


def representatives(marks: DataFrame, medoids: DataFrame, visible: DataFrame, cluster: str = "cluster", idx: str = "idx") -> DataFrame:
    """(cluster, idx) to show for each landmark: the medoid if it is visible, else the landmark's own point."""
    seen = medoids.join(visible.select(idx), idx, "left_semi").select(F.col(cluster).alias("_c"), F.col(idx).alias("_m"))
    return marks.join(seen, F.col(cluster) == F.col("_c"), "left").select(cluster, F.coalesce("_m", idx).alias(idx))


def point_info(points: DataFrame, colours: DataFrame, cluster: str = "cluster", idx: str = "idx") -> DataFrame:
    """(idx, cluster, colour, size) of each point: what its cluster is drawn with, and how many it has. colours: cluster, colour."""
    sizes = points.groupBy(cluster).agg(F.count("*").alias("size"))
    return points.select(idx, cluster).join(sizes.join(colours, cluster, "left"), cluster).select(idx, cluster, "colour", "size")


def overlay(points: DataFrame, bands: DataFrame, locked: DataFrame, idx: str = "idx") -> DataFrame:
    """Points of a curation with their band, without those that are locked. bands: idx, band."""
    return points.join(bands.select(idx, "band"), idx).join(locked.select(idx), idx, "left_anti")
