"""Moving through an index or a result set: clamping, ticks, pages, refreshes, random rounds, and the view of the map."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamped(idx: Column, total: Column) -> Column:
    """A position within 0 .. total - 1; null in an empty index."""
    return F.when(total > 0, F.greatest(F.lit(0), F.least(idx, total - 1)))


def tick(low: Column, high: Column, i: Column, ticks: int) -> Column:
    """The i-th of evenly spaced whole positions; halves are rounded up."""
    return F.floor(low + (high - low) * i / F.lit(ticks - 1) + 0.5).cast("long")


def page_start(idx: Column, size: int) -> Column:
    return (F.floor(idx / size) * size).cast("long")


def page(rows: DataFrame, loaded: DataFrame, at: int, size: int, idx: str = "idx") -> DataFrame:
    """The rows of the page that a position is on, without those that are loaded."""
    own = rows.where(page_start(F.col(idx), size) == at // size * size)
    return own.join(loaded.select(idx), idx, "left_anti")


def refreshed(results: DataFrame, total: int, idx: str = "idx") -> DataFrame:
    """Results whose position the index still has."""
    return results.where((F.col(idx) >= 0) & (F.col(idx) < total))


#: A prime below 2**31, so that squares of remainders fit a long, and the factor of a common generator modulo it.
_PRIME, _FACTOR = 2147483647, 48271
_MIXES, _WALK = 6, 64


def _shape(total: int) -> tuple[int, int]:
    """a * b, the least such rectangle that holds total places and is about square."""
    a = max(1, math.isqrt(max(0, total - 1)) + 1)
    return a, max(1, -(-total // a))


def _keys(seed: int, round_: int) -> list[int]:
    """The keys of the mixing steps; the lowest bit says which half a step changes."""
    digest = hashlib.sha256(f"{seed}/{round_}".encode()).digest()
    return [int.from_bytes(digest[4 * i : 4 * i + 4], "big") % _PRIME * 2 + i % 2 for i in range(_MIXES)]


def row_in_round(place: int, total: int, seed: int, round_: int) -> int:
    """The row that has a place in a round, without making the round."""
    a, b = _shape(total)
    while True:
        for key in reversed(_keys(seed, round_)):
            left, right = divmod(place, b)
            h = ((right if key % 2 == 0 else left) * _FACTOR + key // 2) % _PRIME
            h = h * h % _PRIME
            place = (left - h) % a * b + right if key % 2 == 0 else left * b + (right - h) % b
        if place < total:
            return place


def place_in_round(idx: Column, total: int, seed: int, round_: int) -> Column:
    """The place of a row, 0 to total - 1, in a round of all rows in random order: a keyed permutation, computed row by row.

    A row number is a place in an a * b rectangle, and six steps shift one of its two coordinates by a hash of the other. A
    number that comes out beyond total goes through the steps again. Fewer than a places lie beyond, about one in a, so 64
    times are enough: always where a is at most 64, and otherwise but for a chance of a to the power of -64.
    """
    a, b = _shape(total)
    keys = F.array(*[F.lit(k).cast("long") for k in _keys(seed, round_)])

    def step(x: Column, key: Column) -> Column:
        left, right = F.call_function("div", x, F.lit(b)), x % b
        h = (F.when(key % 2 == 0, right).otherwise(left) * _FACTOR + F.shiftright(key, 1)) % _PRIME
        h = h * h % _PRIME
        return F.when(key % 2 == 0, (left + h) % a * b + right).otherwise(left * b + (right + h) % b)

    once = lambda x: F.aggregate(keys, x, step)
    walk = F.sequence(F.lit(1), F.lit(min(a, _WALK)))
    return F.aggregate(walk, once(idx.cast("long")), lambda x, _: F.when(x < total, x).otherwise(once(x)))


def shuffled(rows: DataFrame, total: int, seed: int, round_: int = 0, shown: int | None = None, idx: str = "idx") -> DataFrame:
    """rows with _turn, their place in a round: each of 0 to total - 1 once. A round neither sorts nor shuffles.

    Where the row that is shown would come first, it changes places with the last.
    """
    turn = place_in_round(F.col(idx), total, seed, round_)
    if shown is not None and total > 1 and row_in_round(0, total, seed, round_) == shown:
        last = row_in_round(total - 1, total, seed, round_)
        turn = F.when(F.col(idx) == shown, F.lit(total - 1).cast("long")).when(F.col(idx) == last, F.lit(0).cast("long")).otherwise(turn)
    return rows.withColumn("_turn", turn)


def recentred(at: Column, low: Column, high: Column, pad: float = 0.1) -> Column:
    """(low, high) of an axis of the view: moved to have a point in the middle if it is within the pad of an edge, or outside."""
    edge, half = (high - low) * pad, (high - low) / 2
    out = (at < low + edge) | (at > high - edge)
    return F.struct(F.when(out, at - half).otherwise(low).alias("low"), F.when(out, at + half).otherwise(high).alias("high"))


def score_text(place: Column, total: Column, score: Column) -> Column:
    """What is shown with a search result; place counts from 0."""
    return F.format_string("%d/%d (score=%.4f)", place + 1, total, score)


def cluster_text(place: Column, total: Column, cluster: Column, label: Column) -> Column:
    named = F.when(F.coalesce(label, F.lit("")) != "", F.concat(F.lit(" · "), label)).otherwise("")
    which = F.when(cluster == -1, "unclustered").otherwise(F.concat(F.lit("Cluster "), cluster.cast("string")))
    return F.concat(F.format_string("%d/%d (", place + 1, total), which, named, F.lit(")"))


def progress(done: Column, total: Column, elapsed: Column) -> Column:
    """(percent, left): what is done of a job, and the seconds that the rest will take at this rate."""
    percent = F.when(total > 0, done / total * 100).otherwise(0.0)
    return F.struct(percent.alias("percent"), F.when(done > 0, elapsed / done * (total - done)).alias("left"))
