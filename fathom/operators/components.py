"""Connected components of an edge table, by alternating large and small stars.

Each round is two aggregations and two equi-joins; a hub's minimum is aggregated before the shuffle and its edges are dealt
by a join that adaptive execution can split, so no node's neighbours meet in one task. Rounds are cut by written tables.
Before the first round every partition joins what it holds by union-find, which shortens paths and drops repeated edges.
A written table of FEW edges at most is finished by union-find in one task; its size is counted, never guessed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.plans.scratch import Scratch


FEW = 250_000
HELD = 200_000


class _Groups(dict):
    """Union-find: node -> a smaller node of its group, or itself."""

    def find(self, x: int) -> int:
        top = x
        while self.get(top, top) != top:
            top = self[top]
        while self.get(x, x) != top:
            self[x], x = top, self[x]
        return top

    def join(self, batch: pa.RecordBatch) -> None:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            u, v = self.find(u), self.find(v)
            if u != v:
                self[max(u, v)] = min(u, v)
                self.setdefault(min(u, v), min(u, v))

    def rows(self, names: list[str], roots: bool) -> pa.RecordBatch:
        own = [(x, y) for x, y in ((x, self.find(x)) for x in list(self)) if roots or x != y]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in own], pa.int64()), pa.array([y for _, y in own], pa.int64())], names=names)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as every node with its smallest; begun anew when HELD nodes are held."""
    groups = _Groups()
    for b in batches:
        groups.join(b)
        if len(groups) > HELD:
            yield groups.rows(["u", "v"], roots=False)
            groups = _Groups()
    yield groups.rows(["u", "v"], roots=False)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups = _Groups()
    for b in batches:
        groups.join(b)
    yield groups.rows(["node", "component"], roots=True)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("_m"))
    moved = edges.join(least, "u").where(F.col("v") != F.col("_m")).select(F.col("v").alias("u"), F.col("_m").alias("v"))
    return moved.union(least.select("u", F.col("_m").alias("v"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges: long columns u, v. A row (node, component) for each node of an edge; component is the smallest node reachable.

    Loops, repeated edges and null ends are ignored; an empty table gives an empty result.
    """
    own = edges.select("u", "v").where("u <> v").mapInArrow(_forest, "u long, v long")
    now = scratch.table(own, "forest")
    seen = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            break
        if mark[0] <= FEW:
            return now.repartition(1).mapInArrow(_whole, "node long, component long")
        seen, before = mark, now
        now = scratch.table(_small_star(_large_star(now)), "stars")
        scratch.drop(before)
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
