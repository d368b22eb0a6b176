"""Expressions on media paths, sizes and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The suffixes of the two media types.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".gif", ".webp", ".tiff", ".heif", ".heic")
VIDEO_SUFFIXES = (
    ".mp4", ".m4v", ".mov", ".webm", ".ogv", ".ogg", ".mkv", ".avi", ".wmv", ".flv", ".asf", ".mpg", ".mpeg", ".m2v", ".vob", ".m2ts", ".mts", ".3gp", ".3g2"
)
#: The types that videos are served as, one for each suffix above, and the suffixes that browsers play.
VIDEO_TYPES = {
    ".mp4": "video/mp4", ".m4v": "video/x-m4v", ".mov": "video/quicktime", ".webm": "video/webm", ".ogv": "video/ogg", ".ogg": "video/ogg", ".mkv": "video/x-matroska",
    ".avi": "video/x-msvideo", ".wmv": "video/x-ms-wmv", ".flv": "video/x-flv", ".asf": "video/x-ms-asf", ".mpg": "video/mpeg", ".mpeg": "video/mpeg", ".m2v": "video/mpeg",
    ".vob": "video/mpeg", ".m2ts": "video/mp2t", ".mts": "video/mp2t", ".3gp": "video/3gpp", ".3g2": "video/3gpp2",
}
OTHER_TYPE = "application/octet-stream"
PLAYED = (".mp4", ".m4v", ".mov", ".webm")
#: Fixed value: directories that a scan leaves out, besides those whose names begin with a dot.
PRUNED = r"(^|/)(\..*?|fathom_index|@eadir|__macosx)/"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def media_type(path: Column) -> Column:
    """image, video, or null for anything else."""
    return F.when(suffix(path).isin(*IMAGE_SUFFIXES), "image").when(suffix(path).isin(*VIDEO_SUFFIXES), "video")


def served_type(path: Column) -> Column:
    """The type that a video is served as; no video's type for any other file."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in VIDEO_TYPES.items() for x in pair]), suffix(path)), F.lit(OTHER_TYPE))


def is_played(path: Column) -> Column:
    """Whether browsers play such a file as a rule."""
    return suffix(path).isin(*PLAYED)


def shown(kind: Column, only: str) -> Column:
    """Whether a filter shows a medium: images (those of no known kind too) or videos; any other filter shows all."""
    if only == "images":
        return F.coalesce(kind, F.lit("image")) == "image"
    return F.coalesce(kind == "video", F.lit(False)) if only == "videos" else F.lit(True)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_name(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit(""))


def path_key(path: Column) -> Column:
    """Case-folded path with forward slashes; equal keys name one file."""
    return F.lower(F.translate(path, "\\", "/"))


def is_pruned(relative: Column) -> Column:
    return F.lower(relative).rlike(PRUNED)


def passes_gate(kind: Column, size: Column, width: Column, height: Column, floor: int = 8192, sure: int = 500 * 1024, least: int = 256) -> Column:
    """Videos pass; small files do not; large ones pass unread; between, both sides must be long enough."""
    if not floor and not least:
        return F.lit(True)
    return (
        F.when(kind == "video", True)
        .when(size < floor, False)
        .when(size > sure, True)
        .otherwise(F.coalesce((width >= least) & (height >= least), F.lit(False)))
    )


def relative_path(path: Column, roots: list[str]) -> Column:
    """The path under the first root that holds it, else its last part."""
    ways = [F.when(path.startswith(r.rstrip("/") + "/"), F.substr(path, F.lit(len(r.rstrip("/")) + 2))) for r in roots]
    return F.coalesce(*ways, basename(path))


def inside(path: Column, root: str) -> Column:
    return path.startswith(root.rstrip("/") + "/")


def canonical(path: Column) -> Column:
    """The path without empty parts, . and ..; what would go above the top stays at the top."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", up(acc)).otherwise(F.concat(acc, F.array(x))))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))
