"""Lineage cuts that survive lost executors: tables written to the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; only where that is unset (tests, one machine) a local one is made."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.fathom.scratch", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            root = "file://" + tempfile.mkdtemp(prefix="fathom-scratch-")
            spark.conf.set("spark.fathom.scratch", root)
    return root.rstrip("/")


class Scratch:
    """Tables of one job. Each is a Parquet folder, so a later read has sizes for the planner and needs no recomputation.

    A tidy job has the shuffle files of a table removed as soon as it is written, not when the driver next collects garbage.
    """

    def __init__(self, spark: SparkSession, job: str, tidy: bool = False):
        self.spark = spark
        self.tidy = tidy
        self.folder = f"{scratch_root(spark)}/{job}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.folder}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        before = self.spark.conf.get(_CLEANUP, None)
        if self.tidy:
            self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            if self.tidy and before is None:
                self.spark.conf.unset(_CLEANUP)
            elif self.tidy:
                self.spark.conf.set(_CLEANUP, before)
        return self._read(df, path)

    def _read(self, df: DataFrame, path: str) -> DataFrame:
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            for f in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
                if f.split("/")[-2] == self.folder.rsplit("/", 1)[-1]:
                    p = jvm.org.apache.hadoop.fs.Path(f)
                    p.getFileSystem(conf).delete(p, True)
