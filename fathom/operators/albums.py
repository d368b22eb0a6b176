"""Album records: floors, radii, locks, and what a selection of an album's files holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.operators.search import default_floor

#: Fixed value: the floor that albums of every encoder once began with.
OLD_FLOOR = 0.2


def migrated_floor(floor: Column, spec: Column) -> Column:
    """A floor that is the old one of all encoders, and not this encoder's, becomes this encoder's; any other is kept."""
    own = default_floor(spec)
    return F.when((floor == OLD_FLOOR) & (own != OLD_FLOOR), own).otherwise(floor)


def eps_state(stored: Column, derived: Column) -> Column:
    """(eps, auto): the radius in use, and whether nobody has chosen it."""
    return F.struct(F.coalesce(stored, derived).alias("eps"), stored.isNull().alias("auto"))


def unlocked(albums: DataFrame, keys: list[str] | None, key: str = "key") -> DataFrame:
    """The albums of a locked deployment; all of them where nothing is locked."""
    return albums if not keys else albums.where(F.col(key).isin(keys))


def first_existing(paths: DataFrame, roots: list[str], existing: DataFrame) -> DataFrame:
    """(rel, path): each relative path under the first of an album's roots that has it, null if none. existing: path."""
    tried = F.posexplode(F.array(*map(F.lit, roots))).alias("ordinal", "_root")
    asked = paths.select("rel").distinct().select("rel", tried).select("rel", "ordinal", F.concat("_root", F.lit("/"), "rel").alias("_p"))
    found = asked.join(existing.select(F.col("path").alias("_e")).distinct(), F.col("_p") == F.col("_e"))
    best = found.groupBy(F.col("rel").alias("_r")).agg(F.min_by("_p", "ordinal").alias("path"))
    return paths.join(best, F.col("rel") == F.col("_r"), "left").select("rel", "path")


def selection_bytes(selection: DataFrame, most: int) -> DataFrame:
    """(n, bytes, too_large) of the files of a selection that may be read. selection: size, readable."""
    own = selection.where("readable").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return own.select("n", "bytes", (F.col("bytes") > most).alias("too_large"))


def dropped_videos(index: DataFrame, listed: DataFrame) -> DataFrame:
    """(n): indexed videos that a new listing does not have. index: path, media; listed: path."""
    return index.where("media = 'video'").join(listed.select("path").distinct(), "path", "left_anti").agg(F.count("*").alias("n"))


def exclusion_counts(votes: DataFrame, excluded: DataFrame, least: float) -> DataFrame:
    """(n_excluded, n_new) after leaving out all that were chosen at least so often. votes: idx, frequency; excluded: idx."""
    out = excluded.select("idx", F.lit(0).alias("_new")).union(votes.where(F.col("frequency") >= least).select("idx", F.lit(1).alias("_new")))
    each = out.groupBy("idx").agg(F.min("_new").alias("_new"))
    return each.agg(F.count("*").alias("n_excluded"), F.coalesce(F.sum("_new"), F.lit(0)).alias("n_new"))
