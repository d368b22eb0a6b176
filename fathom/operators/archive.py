"""Archives of selected files, written in parallel: members are packed by partition, their places are prefix sums, one directory ends it.

Paths are those of folders that all machines have mounted. Each file is packed once, into a part beside the archive, and a
table keeps the part of the attempt that counted. Then every member has its place, and tasks put members and directory records
there; a second attempt puts the same bytes at the same place. The archive has its name only when it is whole.

Defined cases: links and files outside the roots are denied, null paths and absent files are missing, files that cannot be read
are failed with their error; none of these is in the archive and each has its row. Repeated rows are repeated members, and files
of one name in several folders are members of one name. An empty selection makes an empty archive.
"""

from __future__ import annotations

import os
import shutil
import struct
import time
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import media
from fathom.operators import transfers
from fathom.plans.scratch import Scratch

BLOCK = 1 << 20
#: The largest number in a plain field, and of members in a plain directory; the lengths of headers, records and their wide fields.
PLAIN, PLAIN_MEMBERS = 0xFFFFFFFF, 0xFFFF
HEADER, RECORD, WIDE_HEADER, WIDE_RECORD = 30, 46, 20, 28
STORED, DEFLATED = 0, 8

_PACKED = "id long, source string, name string, state string, error string, video boolean, part string, crc long, size long, packed long, stamp long"


class TooLarge(ValueError):
    pass


def arranged(packed: DataFrame, scratch: Scratch, plain: int = PLAIN, tasks: int | None = None) -> tuple[DataFrame, int, bool]:
    """packed with entry_at and record_at, places in the archive in order of id; where the directory begins; whether fields are wide.

    packed: id, source, name, size, packed and others. Rows are dealt by ranges of id, and only the ranges' sums, as many as
    tasks, come together.
    """
    dealt = packed.repartitionByRange(tasks or packed.sparkSession.sparkContext.defaultParallelism * 4, "id")
    own = scratch.table(dealt.withColumns({"_bucket": F.spark_partition_id(), "_n": F.octet_length("name").cast("long")}), "dealt")
    row = own.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("packed") + F.col("_n") + HEADER), F.lit(0)).alias("whole"), F.coalesce(F.max("size"), F.lit(0)).alias("most")).first()
    wide = row["n"] >= PLAIN_MEMBERS or max(row["whole"], row["most"]) >= plain
    begins = row["whole"] + wide * WIDE_HEADER * row["n"]
    own = own.withColumns({"_entry": F.col("packed") + F.col("_n") + HEADER + wide * WIDE_HEADER, "_record": F.col("_n") + RECORD + wide * WIDE_RECORD})
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy("_bucket").agg(F.sum("_entry").alias("_e"), F.sum("_record").alias("_r"))
    starts = sums.select("_bucket", F.sum("_e").over(before).alias("_e0"), F.sum("_r").over(before).alias("_r0"))
    inside = Window.partitionBy("_bucket").orderBy("id", "source").rowsBetween(Window.unboundedPreceding, -1)
    at = lambda start, length: F.coalesce(F.col(start), F.lit(0)) + F.coalesce(F.sum(length).over(inside), F.lit(0))
    out = own.join(F.broadcast(starts), "_bucket").withColumns({"entry_at": at("_e0", "_entry"), "record_at": at("_r0", "_record") + begins})
    return out.select(*packed.columns, "entry_at", "record_at"), begins, wide


def write_archive(rows: DataFrame, dest: str, roots: Sequence[str], most_bytes: int | None = None, tasks: int | None = None, plain: int = PLAIN) -> DataFrame:
    """Writes the files of rows (id, path) to a ZIP archive: videos stored, others deflated. Returns (id, path, name, state, error).

    TooLarge is raised, and nothing written, if the readable files have more than most_bytes.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "archive")
    parts, draft = f"{dest}.{uuid.uuid4().hex}.parts", f"{dest}.{uuid.uuid4().hex}.draft"
    asked = rows.select(F.col("id").cast("long").alias("id"), F.col("path").alias("source"), F.lit(None).cast("string").alias("dest"))
    stated = scratch.table(asked.mapInPandas(transfers._stating(list(roots)), transfers._STATED), "stated")
    total = stated.where("found AND allowed").agg(F.sum("size")).first()[0] or 0
    if most_bytes is not None and total > most_bytes:
        raise TooLarge(f"the selection has {total} bytes, and the limit is {most_bytes}")
    state = F.when(~F.col("allowed"), "denied").when(~F.col("found"), "missing").otherwise("ready")
    own = stated.select("id", "source", media.basename(F.col("source")).alias("name"), state.alias("state"), F.coalesce(media.media_type(F.col("source")) == "video", F.lit(False)).alias("video"))
    try:
        os.makedirs(parts)
        dealt = own.repartition(tasks or spark.sparkContext.defaultParallelism * 4)
        packed = scratch.table(dealt.mapInPandas(_packing(parts), _PACKED), "packed")
        placed, begins, wide = arranged(packed.where("state = 'done'"), scratch, plain, tasks)
        placed.mapInPandas(_placing(draft, wide), "id long").write.format("noop").mode("overwrite").save()
        ends = packed.where("state = 'done'").agg(F.count("*"), F.coalesce(F.sum(F.octet_length("name") + RECORD + wide * WIDE_RECORD), F.lit(0))).first()
        _close(draft, ends[0], begins, ends[1], wide)
        os.replace(draft, dest)
    finally:
        shutil.rmtree(parts, ignore_errors=True)
        if os.path.exists(draft):
            os.unlink(draft)
    return packed.select("id", F.col("source").alias("path"), "name", "state", "error")


def _packing(parts: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            out = []
            for r in p.itertuples():
                row = [r.id, r.source, r.name, r.state, None, r.video, None, 0, 0, 0, 0]
                if r.state == "ready":
                    part = os.path.join(parts, uuid.uuid4().hex)
                    try:
                        row[3], row[6:] = "done", [part, *_pack(r.source, part, r.video)]
                    except OSError as e:
                        row[3], row[4] = "failed", f"{type(e).__name__}: {e.strerror or e}"
                out.append(row)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _PACKED.split(", ")])

    return over


def _pack(source: str, part: str, video: bool) -> tuple[int, int, int, int]:
    """Writes the packed bytes of a file, a block at a time: its checksum, its size, that of the part, and its time."""
    crc = size = packed = 0
    deflater = None if video else zlib.compressobj(wbits=-15)
    with open(source, "rb") as f, open(part, "wb") as out:
        stamp = int(os.fstat(f.fileno()).st_mtime)
        while block := f.read(BLOCK):
            crc, size = zlib.crc32(block, crc), size + len(block)
            packed += out.write(deflater.compress(block) if deflater else block)
        if deflater:
            packed += out.write(deflater.flush())
    return crc, size, packed, stamp


def _common(r, wide: bool) -> tuple[bytes, bytes]:
    """What header and record of a member have in common, and its name."""
    name = r.name.encode("utf-8", "surrogateescape")
    t = time.gmtime(min(max(r.stamp, 315532800), 4354819198))  # the years that the format can say
    clock, day = t.tm_hour << 11 | t.tm_min << 5 | t.tm_sec // 2, t.tm_year - 1980 << 9 | t.tm_mon << 5 | t.tm_mday
    sizes = (PLAIN, PLAIN) if wide else (r.packed, r.size)
    method = STORED if r.video else DEFLATED
    return struct.pack("<HHHHHIII", 45 if wide else 20, 0 if name.isascii() else 0x800, method, clock, day, r.crc, *sizes), name


def _placing(draft: str, wide: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = os.open(draft, os.O_WRONLY | os.O_CREAT, 0o644)
        try:
            for p in frames:
                for r in p.itertuples():
                    common, name = _common(r, wide)
                    extra = struct.pack("<HHQQ", 1, 16, r.size, r.packed) if wide else b""
                    at = _put(out, r.entry_at, b"PK\3\4" + common + struct.pack("<HH", len(name), len(extra)) + name + extra)
                    with open(r.part, "rb") as f:
                        while block := f.read(BLOCK):
                            at = _put(out, at, block)
                    extra = struct.pack("<HHQQQ", 1, 24, r.size, r.packed, r.entry_at) if wide else b""
                    tail = struct.pack("<HHHHHII", len(name), len(extra), 0, 0, 0, 0o644 << 16, PLAIN if wide else r.entry_at)
                    _put(out, r.record_at, b"PK\1\2" + struct.pack("<H", 3 << 8 | 45) + common + tail + name + extra)
                yield p[["id"]]
        finally:
            os.close(out)

    return over


def _put(out: int, at: int, block: bytes) -> int:
    """Writes all of a block at a place; the place after it."""
    view = memoryview(block)
    while view:
        n = os.pwrite(out, view, at)
        at, view = at + n, view[n:]
    return at


def _close(draft: str, n: int, begins: int, length: int, wide: bool) -> None:
    """Writes what follows the directory."""
    end = b""
    if wide:
        end = b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 3 << 8 | 45, 45, 0, 0, n, n, length, begins) + b"PK\6\7" + struct.pack("<IQI", 0, begins + length, 1)
    plain = (PLAIN_MEMBERS, PLAIN_MEMBERS, PLAIN, PLAIN) if wide else (n, n, length, begins)
    out = os.open(draft, os.O_WRONLY | os.O_CREAT, 0o644)
    try:
        _put(out, begins + length, end + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, *plain, 0))
    finally:
        os.close(out)
