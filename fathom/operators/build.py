"""One call that builds an index or brings it up to date, and that goes on where an interrupted one has stopped."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.media import path_key
from fathom.operators.encoders import encoded
from fathom.operators.index import global_index, missing_files, new_files, updated, without_known_rejects
from fathom.plans.scratch import Scratch
from fathom.sources.derived import Derived, content_stamp
from fathom.sources.store import Store

BLOCKS = 16
_FILE = ["path", "size", "mtime"]

Judge = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


class Build:
    """An index, its rejected files and its layout in one folder, made by one encoder.

    Files are compared by case-folded path. New ones are judged, and the accepted ones encoded in BLOCKS parts, each kept as soon
    as it is written: what an interrupted build has encoded of a file of the same path, size and time is used by the next one.
    Rejected files, and those that cannot be encoded, are not tried again until their size, their time, the gate or the encoder
    changes. Another encoder's index is not read: all files are new then, and the version it left is replaced. Where no file is
    new and none is missing nothing is written. An index that another build has replaced meanwhile raises Conflict.
    """

    def __init__(self, spark: SparkSession, folder: str, spec: str, gate: str = ""):
        self.spark, self.folder, self.spec, self.gate = spark, folder.rstrip("/"), spec, gate
        self.index = Store(spark, f"{self.folder}/index")
        self.rejects = Derived(Store(spark, f"{self.folder}/rejects"))
        self.layouts = Derived(Store(spark, f"{self.folder}/layout"))
        self.work = f"{self.folder}/work-{zlib.crc32(spec.encode()):08x}"

    def current(self) -> DataFrame | None:
        """The rows of this encoder's index, or None: there is none yet, or it is of another encoder."""
        if not self.index.exists():
            return None
        rows = self.index.read()
        first = rows.select("model_id").first()
        return rows if first is None or first[0] == self.spec else None

    def run(self, live: DataFrame, judge: Judge | None = None, text: str = "path") -> DataFrame:
        """The index (path, size, mtime, v, model_id) of the live files (path, size, mtime and what judge and encoder read).

        judge gives (accepted, rejected) of new files; without it all are accepted. Of live rows with equal folded paths one stays.
        """
        read = self.index.current()
        own = self.current()
        live = live.groupBy(path_key(F.col("path")).alias("_key")).agg(F.min_by(F.struct(*live.columns), F.struct("path", "mtime", "size")).alias("r")).select("r.*")
        stamp = f"{self.gate}|{self.spec}"
        rejected = self.rejects.read(stamp)
        found = live if own is None else new_files(live, own)
        found = found if rejected is None else without_known_rejects(found, rejected)
        some = not found.isEmpty()
        if own is not None and not some and missing_files(own, live).isEmpty():
            return own
        fresh, bad = (self._encoded(found, judge, text) if some else (None, None))
        none = live.select(*_FILE, F.lit(None).cast("array<double>").alias("v"), F.lit(self.spec).alias("model_id")).limit(0)
        base = none if own is None else own
        version = self.index.replace(updated(base, live, none if fresh is None else fresh.withColumn("model_id", F.lit(self.spec)).select(*none.columns)), read)
        if bad is not None:
            kept = bad if rejected is None else rejected.unionByName(bad).distinct()
            self.rejects.store.write(kept.withColumn("_stamp", F.lit(stamp)))
        self._forget()
        return self.index.read(version)

    def laid_out(self, layout: Callable[[DataFrame], DataFrame], settings: str = "") -> DataFrame:
        """(path, x, y) of the index by layout, from (node, v) to (node, x, y); kept until the index or the settings change."""
        rows = self.index.read().select("path", "mtime", "v")

        def make() -> DataFrame:
            placed = global_index(rows, ["mtime", "path"], Scratch(self.spark, "build"), "node")
            return layout(placed.select("node", "v")).join(placed.select("node", "path"), "node").select("path", "x", "y")

        return self.layouts.get(f"{content_stamp(rows, 'path', 'mtime')}|{self.spec}|{settings}", make)

    def _encoded(self, found: DataFrame, judge: Judge | None, text: str) -> tuple[DataFrame, DataFrame]:
        accepted, rejected = judge(found) if judge else (found, found.limit(0))
        todo = accepted
        if done := self._parts():
            todo = accepted.join(self._table(done).select(*_FILE), _FILE, "left_anti")
        columns = list(dict.fromkeys([*_FILE, text]))
        listed = Scratch(self.spark, "build").table(todo.select(*columns).withColumn("_block", F.pmod(F.xxhash64("path"), F.lit(BLOCKS))), "todo")
        for (block,) in sorted(listed.select("_block").distinct().collect()):
            part = encoded(listed.where(F.col("_block") == block).drop("_block"), self.spec, text).select(*_FILE, "v", "bad")
            part.write.parquet(f"{self.work}/{uuid.uuid4().hex}")
        if not (parts := self._parts()):
            return found.select(*_FILE, F.lit(None).cast("array<double>").alias("v")).limit(0), self._keys(rejected)
        made = accepted.select(*_FILE).join(self._table(parts).dropDuplicates(_FILE), _FILE)
        return made.where("NOT bad").select(*_FILE, "v"), self._keys(rejected).union(self._keys(made.where("bad")))

    def _keys(self, files: DataFrame) -> DataFrame:
        return files.select(path_key(F.col("path")).alias("key"), "size", "mtime")

    def _table(self, parts: list[str]) -> DataFrame:
        return self.spark.read.parquet(*parts)

    def _fs(self, name: str = ""):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.work}{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _parts(self) -> list[str]:
        """Parts that were written to their end."""
        folder, fs = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(f"{self.work}/{n}" for n in names if fs.exists(self._fs(f"/{n}/_SUCCESS")[0]))

    def _forget(self) -> None:
        folder, fs = self._fs()
        fs.delete(folder, True)
