"""Text formatting and parsing expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def phrase(x: Column, least: int = 3, most: int = 60) -> Column:
    """A vocabulary phrase: trimmed, lower case, single spaces; null if too short or too long."""
    p = F.trim(F.regexp_replace(F.lower(F.trim(x)), r"[_\s]+", " "))
    return F.when(F.length(p).between(least, most), p)


def human_bytes(n: Column) -> Column:
    """Decimal units: one decimal for GB, none for MB."""
    return (
        F.when(n >= 1_000_000_000, F.format_string("%.1f GB", n / F.lit(1e9)))
        .when(n >= 1_000_000, F.format_string("%.0f MB", n / F.lit(1e6)))
        .otherwise(F.format_string("%d bytes", n))
    )


def duration(seconds: Column) -> Column:
    """m:ss or h:mm:ss, rounded half to even; Unknown if negative, missing or not finite."""
    s = F.bround(seconds, 0).cast("long")
    ok = seconds.isNotNull() & ~F.isnan(seconds) & (seconds >= 0) & (seconds < float("inf"))
    h, m, sec = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    text = F.when(s >= 3600, F.format_string("%d:%02d:%02d", h, m, sec)).otherwise(F.format_string("%d:%02d", F.floor(s / 60), sec))
    return F.when(ok, text).otherwise("Unknown")


def frames_per_second(fps: Column) -> Column:
    whole = F.abs(fps - F.bround(fps, 0)) < 0.01
    text = F.when(whole, F.format_string("%d fps", F.bround(fps, 0).cast("long"))).otherwise(F.format_string("%.2f fps", fps))
    return F.when((fps > 0) & (fps < float("inf")), text).otherwise("Unknown")


def resolution(width: Column, height: Column) -> Column:
    return F.when((width > 0) & (height > 0), F.concat(width.cast("string"), F.lit("×"), height.cast("string")))


def escaped(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def file_stem(spec: Column) -> Column:
    """An encoder's name as part of a file name."""
    return F.regexp_replace(spec, "[/:]", "__")


def spec_part(spec: Column, part: str) -> Column:
    """backend, model or pretrained of backend:model[/pretrained]."""
    if part == "backend":
        return F.substring_index(spec, ":", 1)
    rest = F.when(F.contains(spec, F.lit(":")), F.regexp_extract(spec, r"^[^:]*:(.*)$", 1))
    if part == "model":
        return F.substring_index(rest, "/", 1)
    return F.when(F.contains(rest, F.lit("/")), F.regexp_extract(rest, r"^[^/]*/(.*)$", 1))


def version_tuple(version: Column) -> Column:
    """The leading numbers of a version; arrays compare part by part."""
    found = F.regexp_extract(version, r"^(\d+(?:\.\d+)*)", 1)
    return F.when(found != "", F.transform(F.split(found, r"\."), lambda x: x.cast("int"))).otherwise(F.array().cast("array<int>"))


def masked(key: Column, mark: str = "●") -> Column:
    return F.when(F.length(key) > 4, F.concat(F.repeat(F.lit(mark), F.length(key) - 4), F.right(key, F.lit(4)))).otherwise(F.repeat(F.lit(mark), F.length(key)))


def is_light(colour: Column) -> Column:
    """Perceived brightness of #rrggbb above 180."""
    part = lambda i: F.conv(F.substring(colour, i, 2), 16, 10).cast("int")
    return (part(2) * 299 + part(4) * 587 + part(6) * 114) / 1000 > 180


def quoted(path: Column) -> Column:
    """URL quoting that keeps slashes and writes a space as %20."""
    return F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def is_uuid_name(name: Column) -> Column:
    return F.lower(name).rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\.[a-z0-9]+$")


def is_colour(x: Column) -> Column:
    return x.rlike(r"^#([0-9a-fA-F]{3}|[0-9a-fA-F]{6})$")
