"""Exact deduplication by a tree merge of sorted digest runs; DataFrame operations only.

Every input partition is a run. The space of digests is dealt into slices by range, and each slice has a merge tree of its
own, so the last round too is as many tasks as there are slices. Level 0 folds the rows of a run to one entry for each
digest, before any shuffle. In each round, ``fan_in`` neighbouring runs of a slice hand their entries to one task; there
they lie sorted by digest, and one pass over the sorted run folds equal digests. The only exchange of a round deals whole
runs, by slice and run, never single digests. An entry carries the row that stays and the number of copies, so a text that
fills a third of the table is one entry for each run from level 0 on, and no round gives a task more than ``fan_in`` entries
of one digest.

An entry's key is the SHA-256 of the text with its length and a second, independent hash as verification, checked at every
level: entries whose digests agree and whose verification does not stay apart.

Defined cases: a null text counts as empty and equals other empty texts; rows with a null id take part and lose to any row
with an id; when the largest id occurs on several rows of a group, one of them stays; an empty table gives an empty result;
other columns are not looked at, whatever their names and types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.plans.scratch import Scratch

FAN_IN = 16
KEY = ["_digest", "_bytes", "_second"]
SLICES_A_TASK = 4  # slices for each shuffle partition, so that hashing deals them evenly


def _keys(text: str) -> list[Column]:
    """A text's digest; its length and a second, independent hash stand beside it as verification."""
    t = F.coalesce(F.col(text), F.lit(""))
    return [F.unhex(F.sha2(t, 256)).alias("_digest"), F.octet_length(t).alias("_bytes"), F.xxhash64(t).alias("_second")]


def digest_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row of digests for each document row: _id, _uid (its place in the table), _run, and the key."""
    return docs.select(
        F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_uid"), F.spark_partition_id().alias("_run"), *_keys(text_col)
    )


def _slice(n: int) -> Column:
    """The slice of a digest: its first two bytes, cut into n ranges."""
    first = F.conv(F.hex(F.substring("_digest", 1, 2)), 16, 10).cast("int")
    return F.floor(first * n / 65536).cast("int")


def merge_runs(runs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One row for each text: the key, _keep (id and place of the row that stays) and _copies (rows).

    The largest of a struct has no hash aggregate, so every fold is a sort aggregate: it reads its run in order of the key.
    """
    last = runs.agg(F.max("_run")).first()[0] or 0
    slices = min(65536, SLICES_A_TASK * int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sliced = runs.withColumn("_slice", _slice(slices))
    level = sliced.groupBy("_slice", "_run", *KEY).agg(F.max(F.struct("_id", "_uid")).alias("_keep"), F.count("*").alias("_copies"))
    while last > 0:
        last //= fan_in
        level = (
            level.withColumn("_run", F.expr(f"_run div {fan_in}").cast("int"))
            .repartition("_slice", "_run")
            .groupBy("_slice", "_run", *KEY)
            .agg(F.max("_keep").alias("_keep"), F.sum("_copies").alias("_copies"))
        )
    return level.select(*KEY, "_keep", "_copies")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """A row for each document row: doc_id, keep_id, group_size, kept, text_sha256."""
    scratch = Scratch(docs.sparkSession, "exact")
    rows = scratch.table(digest_runs(docs, id_col, text_col), "runs")
    merged = scratch.table(merge_runs(rows, fan_in).where("_copies > 1"), "merged")
    held = rows.join(merged.select(*KEY, "_keep", "_copies"), KEY, "left")
    alone = F.col("_copies").isNull()
    return held.select(
        F.col("_id").alias("doc_id"),
        F.when(alone, F.col("_id")).otherwise(F.col("_keep._id")).alias("keep_id"),
        F.coalesce("_copies", F.lit(1)).alias("group_size"),
        (alone | (F.col("_uid") == F.col("_keep._uid"))).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """The rows of docs that stay, with all their columns, one for each text.

    Texts do not travel: what goes are (id, key) pairs, taken out by an anti join. Rows of one text that share the largest id
    can differ in other columns only; the one whose columns come first as JSON stays.
    """
    scratch = Scratch(docs.sparkSession, "survivors")
    runs = scratch.table(digest_runs(docs, id_col, text_col), "runs")
    merged = scratch.table(merge_runs(runs, fan_in).where("_copies > 1"), "merged")
    lost = runs.join(merged.select(*KEY, "_keep"), KEY).where(F.col("_uid") != F.col("_keep._uid"))
    gone = scratch.table(lost.select(F.col("_id").alias("_gid"), *[F.col(k).alias(f"_g{k}") for k in KEY], F.col("_id").eqNullSafe(F.col("_keep._id")).alias("_tied")).distinct(), "gone")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    keyed = docs.select(*[docs[c].alias(n) for c, n in zip(docs.columns, names)], F.col(id_col).alias("_id"), *_keys(text_col))

    def same(kind: str, which: DataFrame) -> DataFrame:
        on = F.col("_id").eqNullSafe(F.col("_gid"))
        for k in KEY:
            on = on & (F.col(k) == F.col(f"_g{k}"))
        return keyed.join(which, on, kind)

    stay = same("left_anti", gone).select(*names)
    tied = gone.where("_tied")
    if not tied.isEmpty():
        row = F.struct(*names)
        one = same("left_semi", tied).groupBy("_id", *KEY).agg(F.min_by(row, F.to_json(row)).alias("_row"))
        stay = stay.union(one.select(*[F.col(f"_row.{n}").alias(n) for n in names]))
    return stay.toDF(*docs.columns)


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
