"""Versioned tables: a write goes to a new folder, and one small row says which is current."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer came first: read again, and decide again."""


class Store:
    """A table under a path. Readers of an older version are not disturbed by a write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        fs_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = fs_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            return []
        names = [s.getPath() for s in fs.listStatus(fs_path)]
        own = [int(n.getName()[1:]) for n in names if n.getName().startswith("v") and n.getName()[1:].isdigit()]
        success = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(v for v in own if fs.exists(success(f"{self.path}/v{v}/_SUCCESS")))

    def _claim(self) -> int:
        """A version number that no other writer has: the file that claims it can be made once only."""
        jvm = self.spark.sparkContext._jvm
        fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        version = (self._versions() or [0])[-1] + 1
        while not fs.createNewFile(jvm.org.apache.hadoop.fs.Path(f"{self.path}/_claims/v{version}")):
            version += 1
        return version

    def write(self, df: DataFrame) -> int:
        """A new version with df alone. Writers at one time have versions of their own; the last number is current."""
        version = self._claim()
        df.write.mode("errorifexists").parquet(f"{self.path}/v{version}")
        return version

    def current(self) -> tuple[int, tuple[str, ...]]:
        """The current version (0: none) and the parts added to it, for a write that holds only while both stay so."""
        version = (self._versions() or [0])[-1]
        return version, tuple(self._parts(version))

    def replace(self, df: DataFrame, read: tuple[int, tuple[str, ...]]) -> int:
        """A new version made of what was read; Conflict, and nothing written, if that is no longer current.

        Of several writers that read the same version one gets the next number. A failed write gives its number back; one whose
        driver died keeps it until `release`. Parts added meanwhile are a conflict too, up to the moment before the last step.
        """
        jvm = self.spark.sparkContext._jvm
        path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        version = read[0] + 1
        if self.current() != read or not fs.createNewFile(path(f"_claims/v{version}")):
            raise Conflict(f"{self.path}: version {read[0]} is no longer current or is being replaced")
        try:
            df.write.mode("overwrite").parquet(f"{self.path}/_claims/rows-v{version}")
            if self.current() != read or not fs.rename(path(f"_claims/rows-v{version}"), path(f"v{version}")):
                raise Conflict(f"{self.path}: version {read[0]} was added to or replaced")
        except BaseException:
            self.release(version)
            raise
        return version

    def release(self, version: int) -> None:
        """Gives back the number of a write that has ended without a result."""
        jvm = self.spark.sparkContext._jvm
        for name in (f"rows-v{version}", f"v{version}"):
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_claims/{name}")
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def append(self, df: DataFrame, part: str) -> None:
        """Rows added to the current version under a name; the same name again replaces what it added."""
        current = (self._versions() or [0])[-1]
        df.write.mode("overwrite").parquet(f"{self.path}/v{current}-parts/{part}")

    def _parts(self, version: int) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{version}-parts")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def read(self, version: int | None = None, without: str | None = None) -> DataFrame:
        """The rows of a version, the current one if none is named, and what was added to it but for one part."""
        versions = self._versions()
        current = version or (versions[-1] if versions else 0)
        folders = [f"{self.path}/v{current}"] if current in versions else []
        folders += [f"{self.path}/v{current}-parts/{p}" for p in self._parts(current) if p != without]
        if not folders:
            raise FileNotFoundError(self.path)
        return self.spark.read.parquet(*folders)

    def exists(self) -> bool:
        return bool(self._versions() or self._parts(0))

    def drop(self) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def save_index(store: Store, index: DataFrame, model_id: str) -> int:
    """Writes an index with its encoder's name and the time of the write."""
    return store.write(index.withColumns({"model_id": F.lit(model_id), "written_at": F.lit(time.time())}))


def load_index(store: Store, model_id: str | None = None) -> DataFrame:
    """The current index. Vectors of two encoders are never compared: another model_id is an error."""
    df = store.read()
    found = [r[0] for r in df.select("model_id").distinct().limit(2).collect()]
    if len(found) > 1 or model_id is not None and found and found[0] != model_id:
        raise ValueError(f"the index is of {found}, not {model_id}")
    return df


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_vocabulary(phrases: DataFrame, path: str, value: str = "phrase") -> None:
    phrases.select(value).orderBy(value).write.mode("overwrite").text(path)
