"""Document fingerprints: bottom-k sketches of shingle hashes; DataFrame functions only.

A text's words are its runs of characters other than ASCII white space, A-Z lower-cased; its shingles are the runs of SIZE
words, and a text of fewer words is one shingle. A shingle's hash is the first 64 bits of its MD5, in hexadecimal, so that
the order of hashes is that of the strings. The sketch is the K smallest distinct hashes, in order.

Sketches merge: the K smallest hashes of two sketches together are the sketch of both texts' shingles. The K smallest of the
merged hashes are a uniform sample of all shingles of the two texts, and from what of that sample each sketch holds follow
resemblance and containment; the K-th smallest hash gives the number of distinct shingles. With fewer than K shingles a sketch
is the whole set, and the figures are exact. One standard error of a resemblance of one half is about 0.044 at K = 128.

``with_next`` gives every row the row after it in descending order of an integer id, without one task for the table: ranges
of ids are windows of their own, and the first row of a range is sent to the range before it as well. Bounds come from a pass
over ids alone; where one id (or null) makes a range several times the mean, a second pass orders equal ids by a hash of their
texts too. Rows that agree in id and text lie in one range.

Defined cases: a null text is the empty text; texts without words have the empty sketch, which resembles itself by 1 and all
others by 0; null ids come last; rows that share an id are ordered by a hash of the text and the text; after the last row
comes the first, in a table of one row the row itself; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE = 5
K = 128
DIGITS = 16
RANGES_A_TASK = 4
UNEVEN = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), "[ \t-\r]+"), lambda w: w != "")


def shingle_hashes(text: Column, size: int = SIZE) -> Column:
    """The hashes of a text's shingles, in order of place and with repeats."""

    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(1)))
        hashes = F.transform(starts, lambda i: F.substring(F.md5(F.array_join(F.slice(w, i, size), " ")), 1, DIGITS))
        return F.when(F.size(w) > 0, hashes).otherwise(F.array().cast("array<string>"))

    return _let(words(text), of)


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, size: int = SIZE, k: int = K) -> Column:
    return bottom(shingle_hashes(F.coalesce(text, F.lit("")), size), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the shingles of two texts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merged(df: DataFrame, keys: list[str], sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each key, over all its rows: keys, sketch. Null sketches are skipped; keys without any hash have none.

    Each task sends at most k hashes of a key on, so a key that holds a third of all rows is bounded from the start.
    """
    hashes = df.select(*keys, F.explode(sketch_col).alias("_hash")).groupBy(*keys, "_hash").agg(F.lit(1).alias("_one"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_hash"))
    least = hashes.withColumn("_place", place).where(F.col("_place") <= k)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("_hash")).alias("sketch"))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of either text that both have; 1 for two empty sketches."""

    def of(u: Column) -> Column:
        both = F.size(F.array_intersect(F.array_intersect(u, a), b))
        return F.when(F.size(u) == 0, 1.0).otherwise(both / F.size(u))

    return _let(merge(a, b, k), of)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of a's text that b's has; 1 if a has none, null if no shingle of a is in the sample."""

    def of(u: Column) -> Column:
        return _let(F.array_intersect(u, a), lambda own: F.when(F.size(a) == 0, 1.0).otherwise(F.try_divide(F.size(F.array_intersect(own, b)), F.size(own))))

    return _let(merge(a, b, k), of)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, then (k - 1) over the k-th smallest hash as a part of the range."""
    part = F.conv(F.substring(F.element_at(a, -1), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / part)


def fingerprint(a: Column) -> Column:
    return F.array_join(a, "")


def _order(text: Column | None) -> Column:
    """Ascending in this key is descending in id, nulls last; ``~id`` has no overflow where ``-id`` has."""
    return F.struct(F.col("_id").isNull().alias("n"), F.coalesce(F.bitwise_not("_id"), F.lit(0).cast("long")).alias("r"), (F.xxhash64(text) if text is not None else F.lit(0).cast("long")).alias("h"))


def _ranges(rows: DataFrame, key: Column) -> list:
    """First key and number of rows of each range."""
    n = RANGES_A_TASK * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.select(key.alias("_key")).repartitionByRange(n, "_key")
    return sorted(ranged.groupBy(F.spark_partition_id().alias("_p")).agg(F.min("_key").alias("_first"), F.count("*").alias("_n")).collect(), key=lambda r: tuple(r["_first"]))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Window]:
    """_id, _text, _next (the text of the row after it), _halo, and the window in which that row lies.

    Rows of which _halo holds stand in for the first row of the next range; they are to be dropped after the last use of the
    window.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    key = _order(None)
    ranges = _ranges(rows, key)
    if ranges and max(r["_n"] for r in ranges) > UNEVEN * sum(r["_n"] for r in ranges) / len(ranges):
        key = _order(F.col("_text"))
        ranges = _ranges(rows, key)
    m = max(1, len(ranges))
    bounds = F.array(*[F.struct(F.lit(r["_first"]["n"]).alias("n"), F.lit(r["_first"]["r"]).cast("long").alias("r"), F.lit(r["_first"]["h"]).cast("long").alias("h")) for r in ranges]) if ranges else F.array(key)
    at = F.size(F.filter(bounds, lambda b: b <= F.col("_key"))) - 1
    own = F.struct(F.col("_at").alias("range"), F.lit(False).alias("halo"))
    back = F.struct(F.pmod(F.col("_at") - 1, F.lit(m)).alias("range"), F.lit(True).alias("halo"))
    first = F.get(bounds, F.col("_at")) == F.col("_key")
    placed = rows.withColumn("_key", key).withColumn("_at", at)
    dealt = placed.withColumn("_place", F.explode(F.when(first, F.array(own, back)).otherwise(F.array(own))))
    dealt = dealt.select("_id", "_text", "_key", F.col("_place.range").alias("_range"), F.col("_place.halo").alias("_halo"))
    w = Window.partitionBy("_range").orderBy("_halo", "_key", "_text")
    return dealt.withColumn("_next", F.lead("_text").over(w)), w


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, k: int = K) -> DataFrame:
    """A row for each document row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last third of the text's characters replaced by the first as many of the next document.
    """
    rows, w = with_next(docs, id_col, text_col)
    third = F.expr("char_length(_text) div 3").cast("int")
    edited = F.concat(F.expr("left(_text, char_length(_text) - cast(char_length(_text) div 3 AS int))"), F.left("_next", third))
    own = rows.select("_id", "_key", "_range", "_halo", "_text", F.coalesce(edited, F.lit("")).alias("_edited"), sketch(F.col("_text"), size, k).alias("_sketch"))
    both = own.withColumn("_after", F.lead("_sketch").over(w)).where("NOT _halo")
    both = both.select("_id", "_text", "_edited", "_sketch", "_after", sketch(F.col("_edited"), size, k).alias("_other"))
    return both.select(
        F.col("_id").alias("doc_id"),
        F.char_length("_text").cast("long").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"),
        fingerprint(F.col("_sketch")).alias("fingerprint"),
        fingerprint(F.col("_other")).alias("edited_fingerprint"),
        resemblance(F.col("_sketch"), F.col("_other"), k).alias("near_edited"),
        resemblance(F.col("_sketch"), F.col("_after"), k).alias("near_next"),
    )


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS x FROM d),
e AS (SELECT doc_id, t, x, left(t, length(t) - length(t) // 3) || left(x, length(t) // 3) AS y FROM n),
l AS (SELECT DISTINCT t FROM (SELECT t FROM e UNION ALL SELECT y FROM e)),
w AS (SELECT t, list_filter(string_split_regex(translate(t, '{UPPER}', '{LOWER}'), '[ \\t-\\r]+'), lambda z: z <> '') AS ws FROM l),
s AS (SELECT t, CASE WHEN len(ws) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(ws) - {SIZE - 1}, 1) + 1),
        lambda i: substr(md5(array_to_string(ws[i:i + {SIZE - 1}], ' ')), 1, {DIGITS}))))[1:{K}] END AS k FROM w),
j AS (SELECT e.*, a.k AS ka, b.k AS kb, c.k AS kc FROM e JOIN s a ON a.t = e.t JOIN s b ON b.t = e.y JOIN s c ON c.t = e.x),
u AS (SELECT *, list_sort(list_distinct(list_concat(ka, kb)))[1:{K}] AS ub, list_sort(list_distinct(list_concat(ka, kc)))[1:{K}] AS uc FROM j)
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(y) AS edited_sha256, array_to_string(ka, '') AS fingerprint, array_to_string(kb, '') AS edited_fingerprint,
  CASE WHEN len(ub) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(list_intersect(ub, ka), kb))::DOUBLE / len(ub) END AS near_edited,
  CASE WHEN len(uc) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(list_intersect(uc, ka), kc))::DOUBLE / len(uc) END AS near_next
FROM u
"""
