"""Directory scans, text and CSV vocabularies, and remote listings."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fathom.functions import media as m


def media_files(spark: SparkSession, roots: str | Sequence[str], files: Sequence[str] = ()) -> DataFrame:
    """(path, size, mtime, media) of the media files under directories, without pruned ones, and of single files, wherever they are.

    A file that is named and also found is one row. Contents are not read.
    """
    roots = [roots] if isinstance(roots, str) else list(roots)
    if not (roots or files) or not all(isinstance(r, str) for r in [*roots, *files]):
        raise ValueError("roots and files must be paths, one at least")
    parts = [_listed(spark, list(files))] if files else []
    for root in roots:
        found = _listed(spark, root)
        base = "/" + root.split(":", 1)[-1].strip("/") + "/"
        inside = F.substring_index(F.regexp_replace("path", "^[a-z]+:/*", "/"), base, -1)
        parts.append(found.where(~m.is_pruned(inside)))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.dropDuplicates(["path"]).withColumn("media", m.media_type(F.col("path"))).where("media IS NOT NULL")


def _listed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return found.select("path", F.col("length").alias("size"), (F.unix_micros("modificationTime") / F.lit(1e6)).alias("mtime"))


def described(paths: Sequence[str], limit: int = 3) -> str:
    """What a scan reads, in one line for a log: a few paths as they are, of more their number and the folder of all."""
    if len(paths) <= limit:
        return ", ".join(paths)
    try:
        where = os.path.commonpath(paths)
    except ValueError:  # relative and absolute ones
        where = "multiple locations"
    return f"{len(paths)} explicit paths under {where}"


def on_disk(listing: DataFrame, existing: DataFrame, where: str) -> tuple[DataFrame, int]:
    """The listed paths that exist, and how many do not. If something is listed and nothing of it exists, that is an error.

    listing and existing: path.
    """
    there = listing.select("path").join(existing.select("path").distinct().withColumn("_there", F.lit(True)), "path", "left")
    n, found = there.agg(F.count("*"), F.count("_there")).first()
    if n and not found:
        raise FileNotFoundError(f"none of {n} listed files are under {where}")
    return there.where("_there").select("path"), n - found


def gated(files: DataFrame, sizes: Callable[[DataFrame], DataFrame], floor: int = 8192, sure: int = 500 * 1024, least: int = 256) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected). Only images between the two byte limits are opened: sizes adds width and height to these."""
    unsure = (F.col("media") == "image") & F.col("size").between(floor, sure)
    opened = sizes(files.where(unsure))
    clear = files.where(~unsure).withColumns({"width": F.lit(None).cast("int"), "height": F.lit(None).cast("int")})
    judged = clear.unionByName(opened).withColumn("_ok", m.passes_gate(F.col("media"), F.col("size"), F.col("width"), F.col("height"), floor, sure, least))
    return judged.where("_ok").drop("_ok"), judged.where("NOT _ok").drop("_ok")


def vocabulary_lines(spark: SparkSession, path: str) -> DataFrame:
    """(phrase) of a text file: lower case, without blank lines and those that begin with #."""
    line = F.lower(F.trim("value"))
    return spark.read.text(path).select(line.alias("phrase")).where((F.col("phrase") != "") & ~F.col("phrase").startswith("#"))


def csv_by_header(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    return spark.read.option("header", True).csv(path).select(*columns)


def confident_labels(rows: DataFrame, key: str, confidence: str) -> DataFrame:
    """(key, n): how often each label is certain."""
    return rows.where(F.col(confidence).cast("double") >= 1).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))


class ListingSource(DataSource):
    """Pages of remote listings as a table (board, ordinal, path); one partition for each board.

    fetch(board, offset, limit) gives (total, names). A listing that comes out shorter than its stated total is walked once
    more, and then fails. Names that would leave their folder are left out.
    """

    fetch: Callable[[str, int, int], tuple[int, list[str]]] | None = None
    PAGE = 1000

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "board string, ordinal long, path string"

    def reader(self, schema) -> "ListingReader":
        return ListingReader(self.options.get("boards", "").split(","), type(self).fetch, int(self.options.get("page", self.PAGE)))


class ListingReader(DataSourceReader):
    def __init__(self, boards: list[str], fetch, page: int):
        self.boards, self.fetch, self.page = [b for b in boards if b], fetch, page

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(b) for b in self.boards]

    def _walk(self, board: str) -> tuple[int, list[str]]:
        names: list[str] = []
        while True:
            total, more = self.fetch(board, len(names), self.page)
            names += more
            if not more or len(names) >= total:
                return total, names

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        board = partition.value
        total, names = self._walk(board)
        if len(names) < total:
            total, names = self._walk(board)
            if len(names) < total:
                raise RuntimeError(f"{board}: {len(names)} of {total} names were listed")
        for i, n in enumerate(names):
            if n and not n.startswith(("/", "\\")) and ".." not in n.replace("\\", "/").split("/") and "\x00" not in n:
                yield board, i, n


def ordered_paths(listing: DataFrame) -> DataFrame:
    """Each path once, at its first place."""
    return listing.groupBy("path").agg(F.min(F.struct("board", "ordinal")).alias("place"))
