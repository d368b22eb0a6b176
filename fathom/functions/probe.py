"""A video tool's report as columns: container, length, codec and frame rate.

The report is a tree by indentation. Everything under a heading of tags is text of the file's own and is not read. What is
left is cut at colons and commas, and each piece is known by its place or its unit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAGS = "Metadata:"


def report_lines(banner: Column) -> Column:
    """The lines that are not under a heading of tags, without indentation.

    A line is under a heading when it and all lines since are indented deeper than the heading.
    """
    lines = F.transform(F.split(F.replace(banner, F.lit("\r")), "\n"), lambda x: F.struct(F.ltrim(x).alias("text"), (F.length(x) - F.length(F.ltrim(x))).alias("deep")))

    def free(all_: Column) -> Column:
        depths = F.transform(all_, lambda x: x["deep"])
        heads = F.filter(F.transform(all_, lambda x, i: F.struct(i.alias("at"), x["deep"].alias("deep"), x["text"].alias("text"))), lambda h: F.rtrim(h["text"]) == TAGS)
        own = F.filter(all_, lambda x, i: (F.rtrim(x["text"]) != TAGS) & ~F.exists(heads, lambda h: (h["at"] < i) & (F.array_min(F.slice(depths, h["at"] + 2, i - h["at"])) > h["deep"])))
        return F.transform(own, lambda x: x["text"])

    return F.transform(F.array(lines), free)[0]


def _first(lines: Column, test) -> Column:
    return F.get(F.filter(lines, test), F.lit(0))


def _number(x: Column) -> Column:
    return x.try_cast("double")


def probed(banner: Column) -> Column:
    """(container, duration, codec, fps); what cannot be read is null. Cover art is not a video stream."""

    def read(lines: Column) -> Column:
        source = F.split(_first(lines, lambda x: x.startswith("Input #")), ", ")
        container = F.when(F.get(source, F.lit(2)).startswith("from "), F.trim(F.get(source, F.lit(1))))
        told_length = F.get(F.split(_first(lines, lambda x: x.startswith("Duration:")), ":", 2), F.lit(1))
        parts = F.transform(F.split(F.trim(F.get(F.split(told_length, ","), F.lit(0))), ":"), _number)
        length = F.when(F.size(parts) == 3, F.get(parts, F.lit(0)) * 3600 + F.get(parts, F.lit(1)) * 60 + F.get(parts, F.lit(2)))
        kind = lambda x: F.get(F.split(x, ": "), F.lit(1))
        stream = _first(lines, lambda x: x.startswith("Stream #") & (kind(x) == "Video") & ~F.contains(F.lower(x), F.lit("attached pic")))
        told = F.split(F.get(F.split(stream, ": ", 3), F.lit(2)), ",")
        codec = F.get(F.split(F.trim(F.get(told, F.lit(0))), " "), F.lit(0))
        rate = F.get(F.split(F.trim(_first(told, lambda x: F.rtrim(x).endswith(" fps"))), " "), F.lit(0))
        return F.struct(container.alias("container"), length.alias("duration"), F.when(codec != "", codec).alias("codec"), _number(rate).alias("fps"))

    return F.transform(F.array(report_lines(banner)), read)[0]
