"""Hard-negative mining by distributed radix selection.

Every window (an anchor and a range of scores, over the rows of its label or those of all others) asks for its k best rows:
the highest inner products, ties by the smaller id. The rows are packed into blocks and so are the anchors, and a tile is one
block of rows with one block of anchors, so neither side is broadcast and no pair of rows is ever written. A pass counts, in
each tile, the scores of a window in buckets of its present range; the counts are summed, the bucket that holds the k-th best
becomes the next range, and the next pass counts that range in finer buckets. A window whose range is down to one score that
more rows have than are wanted goes on in the same way over the ids of these rows. A window that is decided takes no part in
later passes, nor does a block of anchors that has none left. Last, one pass gathers the rows at or above the thresholds.

A tile's histogram ends with the bucket that holds the k-th best of that tile: no lower bucket can hold the k-th best of all
rows, so nothing is lost, and a window gets at most k buckets from each tile, however many rows tie.

First the positives of each anchor are selected, then, in windows of low to high per cent of a positive's score, the
negatives; positives of one anchor with equal scores share a window.

Inner products are exact: components are integers, multiplied as doubles while no sum can pass 2**53 and as 64-bit integers
beyond that.

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take no part; a vector shorter than
the longest counts as filled with zeros; rows that have the anchor's id are not its positives; repeated rows take part each
for itself, as anchors too; an anchor with fewer positives or negatives than asked for gives those it has; inner products that
could pass 2**56 stop the job with an error; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.plans.scratch import Scratch

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
BUCKETS = 4096
ROWS_A_BLOCK = (1024, 16384)
ANCHORS_A_BLOCK = 4096
CELLS = 1 << 21  # scores that a tile holds at once
_ROW_BITS = 33  # of monotonically_increasing_id, below the number of the partition
_ASKED = ("slot", "w", "same", "k", "top", "lo", "hi", "at", "by_id", "above")
_BLOCK = "block long, ids binary, labels binary, cells binary, wide boolean"


def numbered(df: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """df, written, with a dense number n; the sizes of the partitions are all that meets."""
    placed = scratch.table(df.withColumn("_place", F.monotonically_increasing_id()), name)
    part = F.shiftright("_place", _ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("n", F.col("_before") + F.col("_place") - F.shiftleft("_part", _ROW_BITS)).drop("_part", "_place", "_before")


def packed(rows: DataFrame, size: int, dim: int, wide: bool, in_order: bool) -> DataFrame:
    """Blocks of size rows: ids, labels and components as bytes, in order of n or of label."""

    def pack(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("n" if in_order else ["label", "id"])
        cells = np.zeros((len(block), dim), np.int64)
        for at, v in zip(cells, block["vector"]):
            at[: len(v)] = v
        return pd.DataFrame([(block["block"].iloc[0], block["id"].to_numpy(np.int64).tobytes(), block["label"].to_numpy(np.int64).tobytes(), cells.astype(np.int64 if wide else np.int32).tobytes(), wide)], columns=["block", "ids", "labels", "cells", "wide"])

    return rows.withColumn("block", F.expr(f"n div {size}")).select("block", "n", "id", "label", "vector").groupBy("block").applyInPandas(pack, _BLOCK)


class _Tile:
    """One block of rows, which lie in order of label, and the scores of some anchors of another."""

    def __init__(self, rows: pd.Series, anchors: pd.Series, whole: bool):
        def read(b: pd.Series) -> tuple:
            ids, labels = (np.frombuffer(b[c], np.int64) for c in ("ids", "labels"))
            return ids, labels, np.frombuffer(b["cells"], np.int64 if b["wide"] else np.int32).reshape(len(ids), -1).astype(np.int64 if whole else np.float64)

        self.ids, self.labels, self.cells = read(rows)
        self.anchor_ids, self.anchor_labels, self.anchor_cells = read(anchors)

    def columns(self, slots: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The scores of all rows with each of the anchors."""
        step = max(1, CELLS // max(1, len(self.ids)))
        for i in range(0, len(slots), step):
            part = slots[i : i + step]
            for slot, scores in zip(part, self.anchor_cells[part] @ self.cells.T):
                yield slot, scores.astype(np.int64)

    def candidates(self, slot: int, scores: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.searchsorted(self.labels, self.anchor_labels[slot], "left"), np.searchsorted(self.labels, self.anchor_labels[slot], "right")
        if not same:
            return np.concatenate([self.ids[:a], self.ids[b:]]), np.concatenate([scores[:a], scores[b:]])
        other = self.ids[a:b] != self.anchor_ids[slot]
        return self.ids[a:b][other], scores[a:b][other]


def _windows(anchors: pd.Series) -> dict[int, list[dict]]:
    """The windows of each slot."""
    out: dict[int, list[dict]] = {}
    for row in zip(*[anchors[c].tolist() for c in _ASKED]):
        out.setdefault(row[0], []).append(dict(zip(_ASKED, row)))
    return out


def _width(lo: int, hi: int, buckets: int) -> int:
    return -(-(hi - lo + 1) // buckets)


def _counts(tile: _Tile, windows: dict[int, list[dict]], first: int, buckets: int) -> pd.DataFrame:
    out = []
    for slot, scores in tile.columns(np.array(sorted(windows))):
        held: dict = {}
        for x in windows[slot]:
            if x["same"] not in held:
                held[x["same"]] = tile.candidates(slot, scores, x["same"])
            ids, s = held[x["same"]]
            lo, hi, need = x["lo"], x["hi"], x["k"] - x["above"]
            if x["by_id"]:
                values = ids[(s == x["at"]) & (ids >= lo) & (ids <= hi)] - lo
            else:
                values = hi - s[(s >= lo) & (s <= hi)]
            bucket = values // _width(lo, hi, buckets)
            if len(bucket) > need:
                bucket = bucket[bucket <= np.partition(bucket, need - 1)[need - 1]]
            for b, c in zip(*np.unique(bucket, return_counts=True)):
                out.append((first + slot, x["w"], b, c))
    return pd.DataFrame(out, columns=["aid", "w", "bucket", "n"])


def _best(tile: _Tile, windows: dict[int, list[dict]], first: int, _: int) -> pd.DataFrame:
    """Rows at or above a window's threshold: a score of lo, or one of at with an id of hi at most. No tile gives over k."""
    out = []
    for slot, scores in tile.columns(np.array(sorted(windows))):
        held: dict = {}
        for x in windows[slot]:
            if x["same"] not in held:
                held[x["same"]] = tile.candidates(slot, scores, x["same"])
            ids, s = held[x["same"]]
            good = (s > x["at"]) | (s == x["at"]) & (ids <= x["hi"]) if x["by_id"] else s >= x["lo"]
            good &= s <= x["top"]
            ids, s = ids[good], s[good]
            for i in np.lexsort((ids, -s))[: x["k"]]:
                out.append((first + slot, x["w"], tile.anchor_ids[slot], ids[i], s[i]))
    return pd.DataFrame(out, columns=["aid", "w", "anchor_id", "id", "score"])


class _Selection:
    def __init__(self, rows: DataFrame, anchor: Column, scratch: Scratch, buckets: int):
        self.spark, self.scratch, self.buckets = scratch.spark, scratch, buckets
        rows = numbered(rows, scratch, "rows")
        size = F.size("vector")
        most = F.array_max(F.transform("vector", lambda x: F.abs(x)))
        s = rows.agg(F.count("*").alias("rows"), F.max(size).alias("dim"), F.max(most).alias("most"), F.min("id").alias("least"), F.max("id").alias("last")).first()
        self.rows, dim, self.most = s["rows"], s["dim"] or 0, s["most"] or 0
        self.reach = max(1, dim) * self.most * self.most
        if self.reach >= 1 << 56:
            raise ValueError("inner products of these components could pass 2**56")
        self.ids = (s["least"], s["last"])
        if not self.rows:
            return
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        each = min(ROWS_A_BLOCK[1], max(ROWS_A_BLOCK[0], -(-self.rows // (2 * tasks))))
        wide = self.most >= 1 << 31
        self.row_blocks = scratch.table(packed(rows, each, dim, wide, in_order=False), "row-blocks")
        self.n_blocks = -(-self.rows // each)
        anchors = numbered(rows.where(anchor).drop("n"), scratch, "anchors")
        self.anchors = anchors.select(F.col("n").alias("aid"))
        self.anchor_blocks = scratch.table(packed(anchors, ANCHORS_A_BLOCK, dim, wide, in_order=True), "anchor-blocks")

    def tiles(self, windows: DataFrame, count: Callable, schema: str) -> DataFrame:
        """count over each tile of a block of rows and a block of anchors that has windows."""
        whole, buckets, columns = self.reach >= 1 << 53, self.buckets, [c.split()[0] for c in schema.split(", ")]
        listed = windows.withColumns({"block": F.expr(f"aid div {ANCHORS_A_BLOCK}"), "slot": F.col("aid") % ANCHORS_A_BLOCK, "by_id": F.col("at").isNotNull(), "at": F.coalesce("at", F.lit(0))})
        listed = listed.groupBy("block").agg(F.collect_list(F.struct(*_ASKED)).alias("x"))
        live = sorted(r["block"] for r in listed.select("block").collect())
        if not live:
            return self.spark.createDataFrame([], schema)
        numbers = F.sequence(F.lit(0).cast("long"), F.lit(self.n_blocks - 1).cast("long"))
        asked = self.anchor_blocks.join(listed.select("block", *[F.col(f"x.{c}").alias(c) for c in _ASKED]), "block").withColumn("rows", F.explode(numbers))
        held = self.row_blocks.withColumnRenamed("block", "rows").withColumn("block", F.explode(F.array(*[F.lit(b).cast("long") for b in live])))

        def work(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(anchors):
                return pd.DataFrame(columns=columns)
            a = anchors.iloc[0]
            return count(_Tile(rows.iloc[0], a, whole), _windows(a), int(a["block"]) * ANCHORS_A_BLOCK, buckets)

        return held.groupBy("rows", "block").cogroup(asked.groupBy("rows", "block")).applyInPandas(work, schema)

    def thresholds(self, state: DataFrame) -> DataFrame:
        """Runs passes until every window is decided."""
        while True:
            state = self.scratch.table(state, "state")
            open_ = state.where("NOT done")
            if open_.isEmpty():
                return state
            counts = self.scratch.table(self.tiles(open_, _counts, "aid long, w int, bucket long, n long"), "counts")
            state = self.narrowed(state, counts)

    def narrowed(self, state: DataFrame, counts: DataFrame) -> DataFrame:
        summed = counts.groupBy("aid", "w", "bucket").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("aid", "w").orderBy("bucket"))
        need = state.where("NOT done").select("aid", "w", (F.col("k") - F.col("above")).alias("need"))
        reached = summed.withColumn("upto", upto).join(need, ["aid", "w"]).where("upto >= need")
        kth = reached.groupBy("aid", "w").agg(F.min(F.struct("bucket", "n", "upto")).alias("kth"))
        width = F.expr(f"(hi - lo + {self.buckets}) div {self.buckets}")
        b, by_id = F.col("kth.bucket"), F.col("at").isNotNull()
        x = state.join(kth, ["aid", "w"], "left").withColumn("width", width)
        lo = F.when(by_id, F.col("lo") + b * F.col("width")).otherwise(F.greatest(F.col("lo"), F.col("hi") - (b + 1) * F.col("width") + 1))
        hi = F.when(by_id, F.least(F.col("hi"), F.col("lo") + (b + 1) * F.col("width") - 1)).otherwise(F.col("hi") - b * F.col("width"))
        x = x.withColumns({"lo2": lo, "hi2": hi, "above2": F.col("above") + F.col("kth.upto") - F.col("kth.n")})
        found, one = F.col("kth").isNotNull() & ~F.col("done"), F.col("lo2") == F.col("hi2")
        exact = F.col("above2") + F.col("kth.n") == F.col("k")
        to_ids = found & one & ~exact & ~by_id
        return x.select(
            "aid", "w", "same", "k", "top",
            F.when(to_ids, F.lit(self.ids[0])).when(found, F.col("lo2")).otherwise(F.col("lo")).cast("long").alias("lo"),
            F.when(to_ids, F.lit(self.ids[1])).when(found, F.col("hi2")).otherwise(F.col("hi")).cast("long").alias("hi"),
            F.when(to_ids, F.col("lo2")).otherwise(F.col("at")).alias("at"),
            F.when(found, F.col("above2")).otherwise(F.col("above")).alias("above"),
            F.when(found, exact | (one & by_id)).otherwise(True).alias("done"),
        )

    def select(self, windows: DataFrame, k: int, same: bool, name: str) -> DataFrame:
        """aid, w, anchor_id, id, score, rank of the k best rows of each window (aid, w, lo, hi)."""
        state = windows.select("aid", "w", F.lit(same).alias("same"), F.lit(k).cast("long").alias("k"), F.col("hi").alias("top"), "lo", "hi", F.lit(None).cast("long").alias("at"), F.lit(0).cast("long").alias("above"), (F.col("lo") > F.col("hi")).alias("done"))
        decided = self.thresholds(state).where("lo <= hi")
        best = self.scratch.table(self.tiles(decided, _best, "aid long, w int, anchor_id long, id long, score long"), name)
        rank = F.row_number().over(Window.partitionBy("aid", "w").orderBy(F.desc("score"), "id"))
        return best.withColumn("rank", rank).where(F.col("rank") <= k)


def usable(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label and vector of the rows that take part; the components are as given."""
    v = F.col(vector_col)
    whole = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & whole).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("vector"))


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, buckets: int = BUCKETS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has id, label and vector, an array of whole numbers; ``anchor`` holds on the rows that are anchors.
    """
    scratch = Scratch(rows.sparkSession, "negatives", tidy=True)
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    all_rows = _Selection(rows, anchor, scratch, buckets)
    if not all_rows.rows:
        return rows.sparkSession.createDataFrame([], out)
    reach = F.lit(all_rows.reach).cast("long")
    near = all_rows.select(all_rows.anchors.select("aid", F.lit(0).alias("w"), (-reach).alias("lo"), reach.alias("hi")), positives, True, "positives")
    near = near.select("aid", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "rank")
    shared = F.min("rank").over(Window.partitionBy("aid", "positive_score"))
    near = scratch.table(near.withColumn("w", shared).drop("rank"), "pairs")
    least = F.expr(f"{low} * positive_score div 100 + CAST({low} * positive_score % 100 > 0 AS INT)")  # div rounds towards 0
    most = F.expr(f"{high} * positive_score div 100 - CAST({high} * positive_score % 100 < 0 AS INT)")
    windows = near.select("aid", "w", least.cast("long").alias("lo"), most.cast("long").alias("hi")).distinct()
    far = all_rows.select(windows, negatives, False, "far").select("aid", "w", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
    return near.join(far, ["aid", "w"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mined(embeddings: DataFrame) -> DataFrame:
    """The query's form: every seventh label wrong by one, components in 256ths, every 50th row an anchor."""
    rows = usable(embeddings, "vec_id", "embedding", "label")
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("id", label.alias("label"), F.transform("vector", lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("vector"))
    return hard_negatives(rows, F.col("id") % 50 == 0)


ORACLE_SQL = """
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, r.id, r.label = a.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score FROM r a, r WHERE a.id % 50 = 0 AND r.id <> a.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, s.id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.id) QUALIFY row_number() OVER w <= 3
"""
