"""The trie of conversation prefixes, by partition refinement.

All conversations start in one class, the root. In round d every class that still has several members is split by its
members' d-th turns: the new classes are the nodes of depth d. A class of one member retires at once, and the rest of its
turns become a unary chain of nodes without any further round; a member whose turns have ended leaves its class. So there are
as many rounds as the longest prefix that two conversations share has turns, and a round reads the active members and the
turns of one depth only. Then the levels are folded back from the deepest to the root, which sums children, leaves and saved
characters.

Turns are numbered through ranges of the whole table in order, not by a window for each conversation, so a conversation that
holds a third of all rows is many ranges. A class is counted by partial aggregates; its members learn their new class by a
join in which classes of more than 1/HOT of all conversations, HOT at most in a round, are broadcast, and no other class is
large. The digest of the members that end at a node is one SHA-256 over all their ids, which can only be computed in order:
the ids meet as strings of up to CHUNK ids, and one task streams the strings of a node through the hash without keeping them.

Every conversation c is rebuilt first: it takes the first h turns of conversation c - c % BASE (all if fewer, none if that
does not exist) before its own turns after its first h, where h is the CRC-32 of c's decimal digits modulo HEADS.

Defined cases: a null role or text is empty; turns are in order of turn (null first), then role, then text, so turns that
share a number have a fixed order; repeated rows are turns of their own; rows with a null conv_id belong to no conversation;
a conversation that is rebuilt without any turn is a member of the root only; an empty table has no conversation, hence no
node; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.plans.scratch import Scratch

BASE = 100
HEADS = 6
HOT = 256
CHUNK = 512
_ROW_BITS = 33  # of monotonically_increasing_id, below the number of the partition


def numbered_turns(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """conv, pos (from 1), digest (of role and text), n (code points of the text)."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text"))
    keys = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = scratch.table(ordered.select("conv", F.monotonically_increasing_id().alias("place"), digest.alias("digest"), F.char_length("text").alias("n")), "placed")
    placed = placed.withColumn("range", F.shiftright("place", _ROW_BITS))
    parts = placed.groupBy("conv", "range").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("conv", "range", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("conv", "range").orderBy("place"))
    return placed.withColumn("within", within).join(offsets, ["conv", "range"]).select("conv", (F.col("before") + F.col("within")).alias("pos"), "digest", "n")


def rebuilt(turns: DataFrame, scratch: Scratch, base: int = BASE, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Lengths (conv, length) and turns (conv, pos, digest, n, last, band) of the rebuilt conversations."""
    head = F.sort_array(F.collect_list(F.struct("pos", "digest", "n")))
    first = turns.where((F.col("conv") % base == 0) & (F.col("pos") < heads)).groupBy(F.col("conv").alias("base")).agg(head.alias("head"))
    convs = turns.groupBy("conv").agg(F.max("pos").alias("own"))
    convs = convs.withColumn("h", (F.crc32(F.col("conv").cast("string")) % heads).cast("int")).withColumn("base", F.col("conv") - F.col("conv") % base)
    taken = F.coalesce(F.slice("head", 1, F.col("h")), F.expr("array()").cast("array<struct<pos:bigint,digest:binary,n:int>>"))
    convs = convs.join(first, "base", "left").select("conv", "own", "h", taken.alias("head")).withColumn("b", F.size("head"))
    convs = scratch.table(convs.withColumn("length", F.col("b") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "conversations")
    begun = convs.select("conv", "length", F.explode("head").alias("t")).select("conv", "t.pos", "t.digest", "t.n", "length")
    kept = turns.join(convs.select("conv", "h", "b", "length"), "conv").where("pos > h")
    kept = kept.select("conv", (F.col("pos") - F.col("h") + F.col("b")).alias("pos"), "digest", "n", "length")
    both = begun.unionByName(kept).select("conv", "pos", "digest", "n", (F.col("pos") == F.col("length")).alias("last"), _band(F.col("pos")).alias("band"))
    path = scratch.path("turns")
    both.write.partitionBy("band").parquet(path)
    return convs.select("conv", "length"), convs.sparkSession.read.schema(both.schema).parquet(path)


def _band(pos: Column) -> Column:
    """The number of binary digits of a position: few folders, of which a round reads one."""
    return F.length(F.bin(pos)).cast("int")


def _digests(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(depth, node, ids), in order, to (depth, node, ends_sha256); only the hash of the node at hand is kept."""
    at, digest = None, None
    for batch in rows:
        out = []
        for depth, node, ids in zip(batch["depth"], batch["node"], batch["ids"]):
            if (depth, node) == at:
                digest.update(b"," + ids.encode())
            else:
                if at is not None:
                    out.append((*at, digest.hexdigest()))
                at, digest = (depth, node), hashlib.sha256(ids.encode())
        if out:
            yield pd.DataFrame(out, columns=["depth", "node", "ends_sha256"])
    if at is not None:
        yield pd.DataFrame([(*at, digest.hexdigest())], columns=["depth", "node", "ends_sha256"])


def end_digests(ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """depth, node, ends_sha256 of (depth, node, conv) rows, each conv once: the ids in numeric order, comma-joined."""
    some = ends.groupBy("depth", "node", F.floor(F.col("conv") / F.lit(chunk)).alias("part")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    return some.repartition("depth", "node").sortWithinPartitions("depth", "node", "part").select("depth", "node", "ids").mapInPandas(_digests, "depth long, node long, ends_sha256 string")


class _Levels:
    """A table in one folder for each depth, written one depth at a time and readable as a whole."""

    def __init__(self, scratch: Scratch, name: str):
        self.spark, self.path, self.schema = scratch.spark, scratch.path(name), None

    def write(self, depth: int, df: DataFrame) -> DataFrame:
        self.schema = df.schema
        df.write.parquet(f"{self.path}/depth={depth}")
        return self.read(depth)

    def read(self, depth: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/depth={depth}")

    def all(self) -> DataFrame:
        return self.spark.read.option("basePath", self.path).schema(self.schema).parquet(self.path).withColumn("depth", F.col("depth").cast("long"))


def refine(lengths: DataFrame, turns: DataFrame, scratch: Scratch, hot: int = HOT) -> tuple[_Levels, _Levels | None, int]:
    """Splits classes round by round. Nodes of each depth (node, parent, n_convs, n, last), members that ended, and the deepest level.

    ``last`` holds where the node is the end of its only member. Ended members lie in the folder of the round that missed
    them, one deeper than the node at which they end.
    """
    spark = scratch.spark
    nodes, steps = _Levels(scratch, "nodes"), _Levels(scratch, "steps")
    root = lengths.agg(F.min("conv").alias("node"), F.count("*").alias("n_convs"), F.max("length").alias("longest")).where("n_convs > 0")
    top = nodes.write(0, root.select("node", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("binary").alias("digest"), "n_convs", F.lit(0).alias("n"), ((F.col("n_convs") == 1) & (F.col("longest") == 0)).alias("last"))).first()
    if top is None or top["n_convs"] == 1:
        return nodes, None, 0
    total, depth = top["n_convs"], 0
    active = lengths.select("conv", F.lit(top["node"]).cast("long").alias("class"))
    while True:
        depth += 1
        now = turns.where((F.col("band") == depth.bit_length()) & (F.col("pos") == depth)).select("conv", "digest", "n", "last")
        step = steps.write(depth, active.join(now, "conv", "left").select("conv", "class", "digest", "n", "last"))
        split = step.where("digest IS NOT NULL").groupBy("class", "digest").agg(F.min("conv").alias("node"), F.count("*").alias("n_convs"), F.min("n").alias("n"), F.min("last").alias("last"))
        level = nodes.write(depth, split.select("node", F.col("class").alias("parent"), "digest", "n_convs", "n", (F.col("last") & (F.col("n_convs") == 1)).alias("last")))
        size = level.agg(F.coalesce(F.max("n_convs"), F.lit(0)).alias("most")).first()["most"]
        if size < 2:
            return nodes, steps, depth
        many = level.where("n_convs > 1").select(F.col("parent").alias("class"), "digest", "node", "n_convs")
        going, limit = step.where("digest IS NOT NULL").select("conv", "class", "digest"), max(1, total // hot)
        if size > limit:
            large = F.broadcast(many.where(F.col("n_convs") > limit).select("class", "digest", F.col("node").alias("large")))
            held = going.join(large, ["class", "digest"], "left")
            rest = held.where("large IS NULL").join(many.where(F.col("n_convs") <= limit), ["class", "digest"])
            active = held.where("large IS NOT NULL").select("conv", F.col("large").alias("class")).unionByName(rest.select("conv", F.col("node").alias("class")))
        else:
            active = going.join(many, ["class", "digest"]).select("conv", F.col("node").alias("class"))


def fold(nodes: _Levels, deepest: int, scratch: Scratch) -> _Levels:
    """Sums from the deepest level to the root: node, parent, n_convs, last, n_children, n_leaves, saved."""
    folded, below = _Levels(scratch, "folded"), None
    for depth in range(deepest, -1, -1):
        level = nodes.read(depth)
        if below is None:
            sums = level.select(F.col("node").alias("up"), F.lit(0).cast("long").alias("children"), F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("under")).limit(0)
        else:
            sums = below.groupBy(F.col("parent").alias("up")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("under"))
        alone = F.col("n_convs") == 1
        chain = F.when(F.col("last"), 0).otherwise(1).cast("long")
        level = level.join(sums, F.col("node") == F.col("up"), "left").select(
            "node", "parent", "n_convs", "last",
            F.when(alone, chain).otherwise(F.coalesce("children", F.lit(0))).alias("n_children"),
            F.when(alone, F.lit(1)).otherwise(F.coalesce("leaves", F.lit(1))).cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("n") + F.coalesce("under", F.lit(0))).cast("long").alias("saved"),
        )
        below = folded.write(depth, level)
    return folded


def prefix_trie(conversations: DataFrame, base: int = BASE, heads: int = HEADS, hot: int = HOT) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    scratch = Scratch(conversations.sparkSession, "trie", tidy=True)
    turns = scratch.table(numbered_turns(conversations, scratch), "numbered")
    lengths, turns = rebuilt(turns, scratch, base, heads)
    nodes, steps, deepest = refine(lengths, turns, scratch, hot)
    folded = fold(nodes, deepest, scratch).all()
    empty = hashlib.sha256(b"").hexdigest()
    own = F.sha2(F.col("node").cast("string"), 256)
    folded = folded.withColumn("alone", F.when(F.col("n_convs") == 1, F.when(F.col("last"), own).otherwise(F.lit(empty))))
    if steps is not None:
        ended = steps.all().where("digest IS NULL").select((F.col("depth") - 1).alias("depth"), F.col("class").alias("node"), "conv")
        folded = folded.join(scratch.table(end_digests(ended), "ends"), ["depth", "node"], "left")
    else:
        folded = folded.withColumn("ends_sha256", F.lit(None).cast("string"))
    inner = folded.select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("alone", "ends_sha256", F.lit(empty)).alias("ends_sha256")
    )
    retired = folded.where("n_convs = 1").select(F.col("node").alias("conv"), F.col("depth").alias("at"))
    tails = turns.join(retired, "conv").where("pos > at").withColumn("node", F.col("conv"))
    one = F.lit(1).cast("long")
    chains = tails.select(
        F.col("conv").alias("conv_id"), F.col("pos").cast("long").alias("depth"), F.col("conv").alias("parent_conv_id"), one.alias("n_convs"),
        F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("last"), own).otherwise(F.lit(empty)).alias("ends_sha256"),
    )
    return inner.unionByName(chains)


_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda z: ascii(z)::BIGINT)),
  lambda a, z: list_reduce([xor(a, z), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, v: xor(u >> 1, CASE WHEN u % 2 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))))"""

ORACLE_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(struct_pack(r := role, x := text) ORDER BY turn NULLS FIRST, role, text) AS ts FROM t GROUP BY conv_id),
c AS (SELECT conv_id, ts, conv_id - conv_id % {BASE} AS b, {_CRC} % {HEADS} AS h FROM o),
r AS (SELECT c.conv_id, list_concat(coalesce(q.ts[1:c.h], []), c.ts[c.h + 1:]) AS ts FROM c LEFT JOIN o q ON q.conv_id = c.b),
p AS (SELECT conv_id, d, ts[1:d] AS k, len(ts) = d AS e FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM r)),
n AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE e), '') AS ends FROM p GROUP BY d, k),
u AS (SELECT n.d, n.k, n.conv_id, n.n_convs, n.ends, count(m.d) AS n_children, (n.n_convs - 1) * (CASE WHEN n.d = 0 THEN 0 ELSE length(n.k[n.d].x) END) AS own
  FROM n LEFT JOIN n m ON m.d = n.d + 1 AND m.k[1:n.d] = n.k GROUP BY ALL),
a AS (SELECT unnest(range(0, d + 1)) AS up, k, n_children, own FROM u),
s AS (SELECT up, k[1:up] AS k, sum((n_children = 0)::BIGINT) AS n_leaves, sum(own) AS saved FROM a GROUP BY 1, 2)
SELECT u.conv_id, u.d::BIGINT AS depth, m.conv_id AS parent_conv_id, u.n_convs, u.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(u.ends) AS ends_sha256
FROM u JOIN s ON s.up = u.d AND s.k = u.k LEFT JOIN n m ON m.d = u.d - 1 AND m.k = u.k[1:u.d - 1]
"""
