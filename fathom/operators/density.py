"""Density clustering of a two-dimensional layout, and the choice of its radius."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.operators.components import connected_components
from fathom.operators.index import global_index
from fathom.operators.neighbours import grid_pairs, k_distances
from fathom.plans.scratch import Scratch

#: Fixed values of the radius rules.
MIN_SAMPLES = 10
FALLBACK_EPS = 0.2
LEAST_EPS = 0.01
QUANTILES = (0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
LARGEST_SHARE = 0.25
SPAN_SHARE = 0.25
PAIR_BUDGET = 50_000_000
SHRINK = 0.7
GIVE_UP_EPS = 1e-6

SMALL = 1024  # comparisons of points that a pair of cells is worth
SPLIT = 4  # a cell in doubt is cut into so many strips each way


def _squared(points: DataFrame, side: float, node: str) -> DataFrame:
    """node, x, y and the square of each point that has finite coordinates."""
    whole = F.col("x").isNotNull() & F.col("y").isNotNull() & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf")) & ~F.isnan("x") & ~F.isnan("y")
    return points.where(whole).select(F.col(node).alias("node"), "x", "y", F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy"))


def _around(reach: int, half: bool = False) -> Column:
    """The squares around a square, itself among them; half: each pair of squares once, and no square with itself."""
    steps = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if not half or (i, j) > (0, 0)]
    return F.explode(F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i, j in steps]))


def _d2(dx: Column, dy: Column) -> Column:
    return dx * dx + dy * dy


def _apart(a: str, b: str, kind: str) -> Column:
    """Squared least or most distance of two boxes whose columns are named by a and b."""

    def along(axis: str) -> Column:
        lo_a, hi_a, lo_b, hi_b = (F.col(f"{x}{end}{axis}") for x in (a, b) for end in ("lo", "hi"))
        if kind == "least":
            return F.greatest(lo_b - hi_a, lo_a - hi_b, F.lit(0.0))
        return F.greatest(hi_b - lo_a, hi_a - lo_b)

    return _d2(along("x"), along("y"))


def _boxes(points: DataFrame, *keys: str) -> DataFrame:
    """For each key: number of points, the box that they fill, and the point of the first node."""
    return points.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("x").alias("lox"), F.max("x").alias("hix"), F.min("y").alias("loy"), F.max("y").alias("hiy"),
        F.min("node").alias("first"), F.min_by("x", "node").alias("px"), F.min_by("y", "node").alias("py"),
    )


_FIELDS = ("n", "lox", "hix", "loy", "hiy", "first", "px", "py")


def _named(boxes: DataFrame, side: str, *keys: str) -> DataFrame:
    return boxes.select(*[F.col(k).alias(f"{side}{k}") for k in (*keys, *_FIELDS)])


def _cells(points: DataFrame, side: float, level: int) -> DataFrame:
    """The cells of a level: each is cut out of a cell of the level before by squares of a fourth of the width."""
    at = lambda c, n: F.floor(F.col(c) / (side / SPLIT**n))
    return points.withColumn("up", F.concat_ws(",", F.col("cell"), at("x", level).cast("string"), at("y", level).cast("string")))


class _Doubt:
    """Pairs of cells of which it is not known whether their points are within a radius, cut finer until it is.

    A pair of cells is settled by the boxes that their points fill: all pairs of points are within the radius, or none is.
    Pairs of few points are compared point by point, at most SMALL comparisons each; the others are cut. No step compares the
    points of two crowded squares.
    """

    def __init__(self, points: DataFrame, side: float, eps: float, scratch: Scratch):
        self.points, self.side, self.limit, self.scratch = points.withColumn("cell", F.concat_ws(",", "cx", "cy")), side, eps * eps, scratch

    def boxes(self) -> DataFrame:
        return self.scratch.table(_boxes(self.points, "cx", "cy", "cell"), "squares")

    def pairs(self, boxes: DataFrame, reach: int) -> DataFrame:
        """Pairs of different squares that are not surely apart, each pair once."""
        a = _named(boxes, "a", "cell").join(boxes.select(F.col("cell").alias("acell"), _around(reach, half=True).alias("to")), "acell")
        b = _named(boxes.withColumn("to", F.struct("cx", "cy")), "b", "cell", "to")
        met = a.join(b, F.col("to") == F.col("bto")).drop("to", "bto")
        return met.where(_apart("a", "b", "least") <= self.limit)

    def compared(self, pairs: DataFrame) -> DataFrame:
        """(acell, bcell) for each two points within the radius, of pairs of cells with few points."""
        p = lambda s: self.points.select(F.col("cell").alias(f"{s}cell"), F.col("x").alias(f"_{s}x"), F.col("y").alias(f"_{s}y"))
        met = pairs.select("acell", "bcell", "aroot", "broot").join(p("a"), "acell").join(p("b"), "bcell")
        return met.where(_d2(F.col("_ax") - F.col("_bx"), F.col("_ay") - F.col("_by")) <= F.lit(self.limit)).select("aroot", "broot")

    def finer(self, pairs: DataFrame, level: int) -> DataFrame:
        """The pairs of the parts of each pair's cells that are not surely apart."""
        inside = pairs.select(F.col("acell").alias("cell")).union(pairs.select(F.col("bcell").alias("cell"))).distinct()
        self.points = self.scratch.table(_cells(self.points.join(inside, "cell", "left_semi"), self.side, level), "doubt")
        parts = self.scratch.table(_boxes(self.points, "cell", "up"), "parts")
        self.points = self.points.drop("cell").withColumnRenamed("up", "cell")
        a, b = (_named(parts, s, "cell", "up") for s in "ab")
        met = pairs.select("acell", "bcell", "aroot", "broot").join(a, "acell").join(b, "bcell")
        met = met.drop("acell", "bcell").withColumnRenamed("aup", "acell").withColumnRenamed("bup", "bcell")
        return met.where(_apart("a", "b", "least") <= self.limit)


def _square_links(core: DataFrame, side: float, eps: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Squares of cores (cx, cy, first) and links (u, v) between the first cores of squares that reach each other."""
    doubt = _Doubt(core, side, eps, scratch)
    squares = doubt.boxes()
    pairs = scratch.table(doubt.pairs(squares, 2).withColumns({"aroot": F.col("afirst"), "broot": F.col("bfirst")}), "square-pairs")
    links, level = None, 0
    while True:
        sure = (_d2(F.col("apx") - F.col("bpx"), F.col("apy") - F.col("bpy")) <= F.lit(doubt.limit)) | (_apart("a", "b", "most") <= F.lit(doubt.limit))
        few = F.col("an") * F.col("bn") <= SMALL
        found = pairs.where(sure).select("aroot", "broot").union(doubt.compared(pairs.where(~sure & few))).distinct()
        found = scratch.table(found.select(F.col("aroot").alias("u"), F.col("broot").alias("v")), "links")
        links = found if links is None else links.union(found)
        if pairs.where(~sure & ~few).isEmpty():
            return squares, links
        left = pairs.where(~sure & ~few).join(found, (F.col("aroot") == F.col("u")) & (F.col("broot") == F.col("v")), "left_anti")
        left = scratch.table(left, "left")
        if left.isEmpty():
            return squares, links
        level += 1
        pairs = scratch.table(doubt.finer(left, level), "finer")


def dbscan(points: DataFrame, eps: float, min_samples: int = MIN_SAMPLES, node: str = "node") -> DataFrame:
    """(node, cluster): -1 for noise. points: node (long, in row order), x, y.

    A point with min_samples neighbours, itself among them, is a core. Clusters are the components of cores within eps,
    numbered by their first core; a border point joins the smallest number among the cores in reach.

    The plane is cut into squares of side eps / sqrt(2), whose points all reach each other. A square of min_samples points has
    cores only, and no distance is computed for them. The other squares have fewer points, and these are compared with
    the points of the squares around, so a point is compared with fewer than 25 * min_samples others. Cores are linked by
    square: each square of cores is one node, and whether two squares reach each other is settled by boxes, finer where in
    doubt. Rows that are written grow with the points, however crowded an area is. Points without finite coordinates are noise.
    """
    scratch = Scratch(points.sparkSession, "dbscan")
    side = eps / math.sqrt(2) * (1 - 1e-9)
    own = scratch.table(_squared(points, side, node), "points")
    sizes = own.groupBy("cx", "cy").agg(F.count("*").alias("_n"))
    full = sizes.where(F.col("_n") >= min_samples).select("cx", "cy")
    thin = scratch.table(own.join(full, ["cx", "cy"], "left_anti"), "thin")

    def reached(some: DataFrame, others: DataFrame, *columns: str) -> DataFrame:
        a = some.select(F.col("node").alias("u"), F.col("x").alias("_x"), F.col("y").alias("_y"), _around(2).alias("_to")).select("u", "_x", "_y", "_to.cx", "_to.cy")
        return a.join(others, ["cx", "cy"]).where(_d2(F.col("_x") - F.col("x"), F.col("_y") - F.col("y")) <= F.lit(eps * eps)).select("u", *columns)

    enough = reached(thin, own).groupBy("u").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_samples).select(F.col("u").alias("node"))
    core = scratch.table(own.join(full, ["cx", "cy"], "left_semi").unionByName(thin.join(enough, "node", "left_semi")), "cores")
    squares, links = _square_links(core, side, eps, scratch)
    groups = connected_components(links, scratch)
    rooted = squares.select("cx", "cy", "first").join(groups, F.col("first") == groups["node"], "left").select("cx", "cy", F.coalesce("component", "first").alias("root"))
    rooted = scratch.table(rooted, "rooted")
    numbered = global_index(rooted.select("root").distinct(), ["root"], scratch, "cluster")
    of_square = scratch.table(rooted.join(numbered, "root").select("cx", "cy", F.col("cluster").cast("int").alias("cluster")), "numbered")
    of_core = core.join(of_square, ["cx", "cy"])
    border = thin.join(core.select("node"), "node", "left_anti")
    joined = reached(border, of_core, "cluster").groupBy(F.col("u").alias("_p")).agg(F.min("cluster").alias("_c"))
    labelled = of_core.select(F.col("node").alias("_p"), F.col("cluster").alias("_c")).unionByName(joined)
    out = points.select(F.col(node).alias("node")).join(labelled, F.col("node") == F.col("_p"), "left")
    return out.select("node", F.coalesce("_c", F.lit(-1)).cast("int").alias("cluster"))


def neighbour_counts(points: DataFrame, eps: float, node: str = "node") -> DataFrame:
    return grid_pairs(points, eps, node).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n"))


def pair_count(points: DataFrame, eps: float, node: str = "node") -> int:
    """Directed pairs within eps, each point with itself too; counted, never kept."""
    return grid_pairs(points, eps, node).count()


def top_share(clusters: DataFrame) -> float:
    """The largest cluster's share of all points."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    n, top = sizes.agg(F.sum("n"), F.max(F.when(F.col("cluster") != -1, F.col("n")))).first()
    return (top or 0) / n if n else 0.0


def k_distance_quantiles(points: DataFrame, k: int = MIN_SAMPLES, node: str = "node") -> list[float]:
    row = k_distances(points, k, node).agg(F.percentile("d", F.array(*map(F.lit, QUANTILES)))).first()[0]
    return [q for q in row or [] if q > 0]


def adaptive_eps(points: DataFrame, min_samples: int = MIN_SAMPLES, node: str = "node") -> float:
    """The last k-distance quantile, walking up, at which no cluster holds more than a quarter of the points."""
    chosen = None
    for q in k_distance_quantiles(points, min_samples, node):
        if chosen is None:
            chosen = q
        if top_share(dbscan(points, q, min_samples, node)) > LARGEST_SHARE:
            break
        chosen = q
    return FALLBACK_EPS if chosen is None else chosen


def span(points: DataFrame) -> float:
    r = points.agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))).first()[0]
    return float(r or 0.0)


def pair_bounds(points: DataFrame, radii: list[float], node: str = "node") -> list[tuple[int, int]]:
    """For each radius, a lower and an upper bound of the directed pairs within it, each point with itself too.

    One pass over the points counts the squares of all radii; after that only squares meet, each with those around it.
    """
    if not radii:
        return []
    sides = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(r / 2).alias("s"), F.lit(r).alias("r")) for i, r in enumerate(radii)])
    placed = _squared(points, 1.0, node).select("x", "y", F.explode(sides).alias("g"))
    cells = placed.groupBy(F.col("g.i").alias("i"), F.col("g.r").alias("r"), F.floor(F.col("x") / F.col("g.s")).alias("cx"), F.floor(F.col("y") / F.col("g.s")).alias("cy")).agg(
        F.count("*").alias("n"), F.min("x").alias("lox"), F.max("x").alias("hix"), F.min("y").alias("loy"), F.max("y").alias("hiy")
    )
    cells = Scratch(points.sparkSession, "bounds").table(cells, "cells")
    names = ("n", "lox", "hix", "loy", "hiy")
    a = cells.select("i", "r", *[F.col(c).alias(f"a{c}") for c in names], _around(3).alias("to")).select("*", "to.cx", "to.cy").drop("to")
    b = cells.select("i", "cx", "cy", *[F.col(c).alias(f"b{c}") for c in names])
    limit, product = F.col("r") * F.col("r"), F.col("an") * F.col("bn")
    both = a.join(b, ["i", "cx", "cy"]).groupBy("i").agg(
        F.sum(F.when(_apart("a", "b", "most") <= limit, product).otherwise(0)).alias("lower"), F.sum(F.when(_apart("a", "b", "least") <= limit, product).otherwise(0)).alias("upper")
    )
    got = {r["i"]: (int(r["lower"]), int(r["upper"])) for r in both.collect()}
    return [got.get(i, (0, 0)) for i in range(len(radii))]


def exceeds(points: DataFrame, eps: float, budget: int, node: str = "node") -> bool:
    """Whether more directed pairs than the budget lie within eps; only squares in doubt are cut finer, until that is known."""
    scratch = Scratch(points.sparkSession, "exceeds")
    side = eps / math.sqrt(2) * (1 - 1e-9)
    doubt = _Doubt(scratch.table(_squared(points, side, node), "points"), side, eps, scratch)
    squares = doubt.boxes()
    sure = int(squares.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0)
    pairs = scratch.table(doubt.pairs(squares, 2).withColumns({"aroot": F.col("afirst"), "broot": F.col("bfirst")}), "square-pairs")
    level = 0
    while True:
        within, few, product = _apart("a", "b", "most") <= F.lit(doubt.limit), F.col("an") * F.col("bn") <= SMALL, 2 * F.col("an") * F.col("bn")
        known, small, large = pairs.agg(*[F.coalesce(F.sum(F.when(c, product)), F.lit(0)) for c in (within, ~within & few, ~within & ~few)]).first()
        sure += int(known)
        if sure > budget or sure + small + large <= budget:
            return sure > budget
        sure += 2 * doubt.compared(pairs.where(~within & few)).count()
        if sure > budget or sure + large <= budget:
            return sure > budget
        level += 1
        pairs = scratch.table(doubt.finer(pairs.where(~within & ~few), level), "finer")


def within_budget(points: DataFrame, eps: float, budget: int = PAIR_BUDGET, node: str = "node") -> float:
    """The first of eps, SHRINK * eps and so on that has no more pairs than the budget, or that is GIVE_UP_EPS at most."""
    radii = [eps]
    while radii[-1] > GIVE_UP_EPS:
        radii.append(radii[-1] * SHRINK)
    for r, (lower, upper) in zip(radii, pair_bounds(points, radii[:-1], node)):
        if upper <= budget or lower <= budget and not exceeds(points, r, budget, node):
            return r
    return radii[-1]


def resolved_eps(points: DataFrame, requested: float | None = None, stored: float | None = None, min_samples: int = MIN_SAMPLES, budget: int | None = None, node: str = "node") -> float:
    """Requested, else stored, else adaptive. A derived radius is at most a quarter of the layout's span; the least radius
    holds for all. A pair budget, for callers that hold pairs, comes last; dbscan holds none, so by default there is none and
    the radius does not shrink with the number of points."""
    given = requested if requested is not None else stored
    if not points.limit(1).count():
        return FALLBACK_EPS if given is None else given
    eps = given
    if eps is None:
        eps = adaptive_eps(points, min_samples, node)
        if wide := span(points):
            eps = min(eps, SPAN_SHARE * wide)
    eps = max(eps, LEAST_EPS)
    return eps if budget is None else within_budget(points, eps, budget, node)
