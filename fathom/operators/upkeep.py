"""What goes along with an index: side files of exports, kept frames, preferences, tables of records, folders to choose from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Files that go with a medium of the same stem.
SIDE_SUFFIXES = (".txt", ".caption", ".json")


def sidecars(plan: DataFrame, existing: DataFrame) -> DataFrame:
    """(source, dest) of the side files of planned copies, those that exist; they take the copy's new stem."""
    stem = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    each = plan.select(stem("source").alias("_s"), stem("dest").alias("_d"), F.explode(F.array(*map(F.lit, SIDE_SUFFIXES))).alias("_x"))
    asked = each.select(F.concat("_s", "_x").alias("source"), F.concat("_d", "_x").alias("dest"))
    return asked.join(existing.select(F.col("path").alias("source")), "source", "left_semi")


def unused_frames(kept: DataFrame, index: DataFrame, file: str = "filename") -> DataFrame:
    """Kept frames of videos that the index no longer has at that time. Both: mtime and the column that tells files apart."""
    return kept.join(index.select(file, "mtime"), [file, "mtime"], "left_anti")


def preference_state(log: DataFrame) -> DataFrame:
    """(device, key, value) that a log of device, written, op, key, value leaves.

    patch writes a key, replace clears the device first, forget only clears it. The last write of a key holds; of writes at one
    time the greatest value.
    """
    cleared = log.where("op IN ('replace', 'forget')").groupBy("device").agg(F.max("written").alias("_cleared"))
    live = log.join(cleared, "device", "left").where("op <> 'forget' AND (_cleared IS NULL OR written >= _cleared)")
    return live.groupBy("device", "key").agg(F.max(F.struct("written", "value")).alias("_last")).select("device", "key", "_last.value")


def with_defaults(state: DataFrame, devices: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """(device, key, value): what every device gets, its own values and defaults for keys that it has not set, or null.

    devices: device. Keys without a default are kept as they are.
    """
    each = F.explode(F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair]).cast("map<string,string>")).alias("key", "_value")
    asked = devices.select("device").distinct().select("device", each)
    own = state.join(devices.select("device").distinct(), "device", "left_semi")
    return asked.join(own, ["device", "key"], "full").select("device", "key", F.coalesce("value", "_value").alias("value"))


def without_empty(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows without those that are empty in all the columns, and without the columns that are then empty in all rows."""
    filled = [F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "" for c in columns]
    left = rows.where(reduce(lambda a, b: a | b, filled))
    used = left.agg(*[F.bool_or(f) for f in filled]).first()
    return left.drop(*[c for c, u in zip(columns, used) if not u])


def subfolders(files: DataFrame, root: str, hidden: bool = False) -> DataFrame:
    """(name, has_children) of the folders right under root that hold files somewhere; those with a dot only if hidden."""
    root = root.rstrip("/") + "/"
    shown = lambda name: F.lit(True) if hidden else ~name.startswith(".")
    parts = F.split(F.substr(F.col("path"), F.lit(len(root) + 1)), "/")
    own = files.where(F.col("path").startswith(root)).select(parts.alias("_p")).where(F.size("_p") > 1)
    name, inner = F.get("_p", F.lit(0)), F.get("_p", F.lit(1))
    each = own.select(name.alias("name"), ((F.size("_p") > 2) & shown(inner)).alias("_deep")).where(shown(F.col("name")))
    return each.groupBy("name").agg(F.bool_or("_deep").alias("has_children"))


def cluster_results(points: DataFrame, clicked: int, visible: DataFrame) -> DataFrame:
    """(idx, distance) of the visible members of the clicked point's cluster; by (distance, idx) the point itself is first."""
    own = points.where(F.col("idx") == clicked).select(F.col("cluster").alias("_c"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    shown = points.join(visible.select("idx"), "idx", "left_semi")
    dx, dy = F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
    # own is one row: idx is unique
    return shown.join(F.broadcast(own), F.col("cluster") == F.col("_c")).select("idx", F.sqrt(dx * dx + dy * dy).alias("distance"))
