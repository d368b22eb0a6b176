"""Copies, moves and deletions of files by a journal, so that a run that was killed is finished by the next one.

Paths are those of folders that all machines have mounted. A journal's plan is written before any file is touched and says what
stood where; a file appears under its name whole or not at all. What a lost task, a second attempt or a killed run has
done already is recognised by the plan and the files, and not done again.
"""

from __future__ import annotations

import os
import shutil
import zlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators.upkeep import SIDE_SUFFIXES

OPS = ("copy", "export", "move", "trash", "unlink")
LEAVING = ("move", "trash", "unlink")
_STATED = "id long, source string, dest string, found boolean, allowed boolean, taken boolean, size long"


def resolved(stated: DataFrame, op: str) -> DataFrame:
    """stated with state: what a walk through the rows by id would find before it touched each file.

    stated: id (unique), source, dest (of each source one; null for unlink), found, allowed, taken. denied: a link, or outside the
    roots. missing: no such file, or an earlier row has taken it away. same: a move into its own folder. exists: dest is taken, by
    a file or an earlier row. ready: all others. Rows of one dest, however many, meet in an aggregate only, those of one source in a join that can be split.
    """
    if op not in OPS:
        raise ValueError(op)
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    own = F.when(~F.col("allowed"), "denied").when(~F.col("found"), "missing")
    if op == "move":
        own = own.when(folder(F.col("source")) == folder(F.col("dest")), "same")
    judged = stated.withColumn("_own", own.when(F.col("taken"), "exists"))
    firsts = judged.where("_own IS NULL").groupBy("source", "dest").agg(F.min("id").alias("_id"))
    winners = firsts if op == "unlink" else firsts.groupBy("dest").agg(F.min("_id").alias("_id"))
    ways = firsts.join(winners.select("_id", F.lit(True).alias("_wins")), "_id", "left").select("source", "_id", "_wins")
    again = "missing" if op in LEAVING else "exists"
    state = F.coalesce("_own", F.when(F.col("_wins"), F.when(F.col("id") == F.col("_id"), "ready").otherwise(again)), F.lit("exists"))
    return judged.join(ways, "source", "left").select(*stated.columns, state.alias("state"))


class Transfers:
    """One journal in a folder of Parquet tables: the plan, and the outcome once a run has come to its end."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.mark = f".parts-{zlib.crc32(self.folder.encode()):08x}"

    def _written(self, name: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def plan(self, rows: DataFrame, op: str, roots: Sequence[str]) -> DataFrame:
        """Writes what is to be done with rows (id, source, dest); a plan that is there already stays as it is."""
        if not self._written("plan"):
            cols = ["id", "source", "dest"] if "dest" in rows.columns else ["id", "source", F.lit(None).cast("string").alias("dest")]
            stated = rows.select(*cols).mapInPandas(_stating(list(roots)), _STATED)
            # what stood where is read once: looked at anew for each branch of the plan it could differ
            stated.write.mode("overwrite").parquet(f"{self.folder}/stated")
            stated = self.spark.read.parquet(f"{self.folder}/stated")
            resolved(stated, op).withColumn("op", F.lit(op)).drop("found", "allowed", "taken").write.mode("overwrite").parquet(f"{self.folder}/plan")
        return self.spark.read.parquet(f"{self.folder}/plan")

    def run(self, tasks: int | None = None) -> DataFrame:
        """(id, source, dest, op, state, error) after all that was ready is done; failed rows have their error and nothing half-made."""
        if not self._written("outcome"):
            plan = self.spark.read.parquet(f"{self.folder}/plan")
            dealt = plan.repartition(tasks or self.spark.sparkContext.defaultParallelism * 4, "id")
            out = dealt.mapInPandas(_doing(self.mark), "id long, source string, dest string, op string, state string, error string")
            out.write.mode("overwrite").parquet(f"{self.folder}/outcome")
        done = self.spark.read.parquet(f"{self.folder}/outcome")
        folders = done.where("dest IS NOT NULL").select(F.regexp_replace("dest", "/[^/]*$", "").alias("d")).distinct()
        folders.mapInPandas(_tidying(self.mark), "d string").write.format("noop").mode("overwrite").save()
        return done


def after(index: DataFrame, outcome: DataFrame, path: str = "filename") -> DataFrame:
    """The index after a journal: moved files under their new paths, deleted ones gone; copies change nothing."""
    done = outcome.where("state = 'done'").select(F.col("source").alias("_from"), F.col("dest").alias("_to"), F.col("op").alias("_op"))
    own = index.join(done.where(F.col("_op").isin(*LEAVING)), F.col(path) == F.col("_from"), "left")
    kept = own.where("_op IS NULL OR _op = 'move'")
    return kept.withColumn(path, F.coalesce("_to", path)).select(*index.columns)


def _stating(roots: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def over(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        real = [os.path.realpath(r) for r in roots]
        for p in parts:
            inside = lambda s: any(os.path.realpath(s).startswith(r.rstrip("/") + "/") for r in real)
            files = [s is not None and "\0" not in s and os.path.isfile(s) for s in p["source"]]
            yield p.assign(
                found=files,
                allowed=[not f or (inside(s) and not os.path.islink(s)) for s, f in zip(p["source"], files)],
                taken=[d is not None and os.path.lexists(d) for d in p["dest"]],
                size=[os.path.getsize(s) if f else -1 for s, f in zip(p["source"], files)],
            )

    return over


def _doing(mark: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def over(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempt = TaskContext.get().taskAttemptId()
        for p in parts:
            states, errors = [], []
            for r in p.itertuples():
                state, error = r.state, None
                if state == "ready":
                    try:
                        _done(r.op, r.source, r.dest, r.size, f"{mark}/{r.id}-{attempt}")
                        state = "done"
                    except OSError as e:
                        state, error = "failed", f"{type(e).__name__}: {e.strerror or e}"
                states.append(state)
                errors.append(error)
            yield p.assign(state=states, error=errors)[["id", "source", "dest", "op", "state", "error"]]

    return over


def _done(op: str, source: str, dest: str | None, size: int, part: str) -> None:
    """Brings one planned row about, from wherever an earlier attempt has left it."""
    if op == "unlink":
        _gone(source)
        return
    here = os.path.isfile(dest) and os.path.getsize(dest) == size
    if not here:
        _appear(source, dest, part)
    if op == "export":
        for suffix in SIDE_SUFFIXES:
            side, own = os.path.splitext(source)[0] + suffix, os.path.splitext(dest)[0] + suffix
            if own != dest and os.path.isfile(side) and not os.path.islink(side):
                _appear(side, own, part + suffix, over=True)
    if op in LEAVING:
        _gone(source)


def _appear(source: str, dest: str, part: str, over: bool = False) -> None:
    """A copy that has its name only when it is whole. A file of that name is an error, unless over is set."""
    own = os.path.join(os.path.dirname(dest), part)
    os.makedirs(os.path.dirname(own), exist_ok=True)
    shutil.copy2(source, own)
    if over:
        os.replace(own, dest)
        return
    try:
        os.link(own, dest)
    except FileExistsError:
        if os.path.getsize(dest) != os.path.getsize(own):
            raise
    finally:
        _gone(own)


def _gone(path: str) -> None:
    try:
        os.unlink(path)
    except FileNotFoundError:
        pass


def _tidying(mark: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def over(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for d in p["d"]:
                shutil.rmtree(os.path.join(d, mark), ignore_errors=True)
            yield p

    return over
