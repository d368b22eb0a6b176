"""Benchmark decontamination with one Aho-Corasick automaton over normalised test questions and answers.

Normalising lower-cases A-Z and keeps words, runs of digits, letters and non-ASCII characters. The automaton's symbols are
words, numbered as they come in the benchmark; a word that the benchmark does not have is 0. A window is ``window``
consecutive words of an item, or the whole item if it has fewer; the automaton holds every window, and one scan of a text's
words finds all of them, overlapping ones too. Hits are word positions, mapped back to code points of the text.

An automaton has at most ``most_nodes`` nodes, about 55 bytes each, so what is broadcast and what a worker holds has a fixed
bound however large the benchmark is. One block of items is usual, and each text is scanned once. A larger benchmark goes in
blocks, longer items in overlapping parts; the driver holds one block at a time, and each block is a scan of its own, whose
hits alone, by row, come together at the end. No two blocks' automata are in one worker.

Defined cases: null and empty texts have no words and are clean; items without words never match; a null item_id counts as
an item named by the empty string; repeated items count once for each distinct id; an empty benchmark leaves every text
clean; an empty table gives an empty result; other columns are carried by ``clean`` and not looked at.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm import remembered
from fathom.plans.scratch import Scratch

WINDOW = 10
MOST_NODES = 4_000_000

_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Windows:
    """The windows of a block of items, as an automaton over numbered words.

    An occurrence gives a window's number. Windows that the same items have, such as those of a common template, are one group,
    and a group's items are looked up once for a text, however often its windows occur.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        places: dict[str, int] = {}
        having: list[list[int]] = []  # of each window, the items
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for name, own in items:
            item = places.setdefault(name, len(places))
            symbols = [self.number.setdefault(w, len(self.number) + 1) for w in own]
            for i in range(max(1, len(symbols) - window + 1)) if symbols else ():
                key = tuple(symbols[i : i + window])
                at = self.automaton.get(key, None)
                if at is None:
                    self.automaton.add_word(key, (len(key), len(having)))
                    having.append([item])
                elif having[at[1]][-1] != item:
                    having[at[1]].append(item)
        groups: dict[tuple[int, ...], int] = {}
        self.group = [groups.setdefault(tuple(own), len(groups)) for own in having]
        names = list(places)
        self.items = [[names[i] for i in own] for own in groups]
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()


def scan(windows: Windows | None, text: str | None) -> tuple[int, np.ndarray, set[str]]:
    """A text's number of words, a mask of its hit words, and the items found in it."""
    own = words(text)
    names: set[str] = set()
    mask = np.zeros(len(own), bool)
    if windows is None or windows.empty or not own:
        return len(own), mask, names
    number = windows.number
    seen: set[int] = set()
    for end, (length, found) in windows.automaton.iter(tuple([number.get(w, 0) for w in own])):
        mask[end - length + 1 : end + 1] = True
        seen.add(windows.group[found])
    for group in seen:
        names.update(windows.items[group])
    return len(own), mask, names


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """Word ranges of hit words, end exclusive."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as code points of the original text, end exclusive."""
    if not ranges:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


def _blocks(benchmark: DataFrame, window: int, most_nodes: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items' words in blocks whose windows have at most most_nodes words; the driver holds one block at a time."""
    most = max(window, most_nodes // window)
    block, size = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").alias("t")).where("t IS NOT NULL")
    for r in rows.toLocalIterator():
        own = words(r.t)
        for at in range(0, max(1, len(own) - window + 1), most - window + 1):
            part = own[at : at + most]
            if size and size + len(part) > most:
                yield block
                block, size = [], 0
            if part:
                block.append((r.i, part))
                size += len(part)
    if block:
        yield block


_BUILT: dict[str, Windows] = {}


def _built(held, window: int, key: str) -> Windows:
    """A worker keeps the automaton of the last block that it has built."""
    remembered.only(_BUILT)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Windows(held.value, window)
    return _BUILT[key]


_FOUND = "_n long, _ranges array<array<long>>, _items array<string>"


def _found(own: DataFrame, held, key: str, window: int) -> DataFrame:
    """own (its last column text) with _n, _ranges and _items, the hits of one block, instead of the text."""
    carried = own.columns[:-1]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name in carried] + [_FOUND])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _built(held, window, key) if held else None
        for b in batches:
            rows = [scan(windows, t) for t in b.column(len(carried)).to_pylist()]
            new = [
                pa.array([n for n, _, _ in rows], pa.int64()),
                pa.array([runs(mask) if names else [] for _, mask, names in rows], pa.list_(pa.list_(pa.int64()))),
                pa.array([sorted(names) for _, _, names in rows], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carried)], *new], names=[*carried, "_n", "_ranges", "_items"])

    return own.mapInArrow(over, schema)


def _merged(ranges: Column) -> Column:
    """Sorted ranges with those that overlap or touch made one."""
    pair = lambda a, b: F.array(a.cast("long"), b.cast("long"))

    def step(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(pair(last[0], F.greatest(last[1], r[1]))))
        return F.when((F.size(acc) > 0) & (r[0] <= last[1]), joined).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(F.array_sort(ranges), F.array().cast("array<array<long>>"), step)


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_nodes: int = MOST_NODES) -> DataFrame:
    """docs: any columns, the last text. The others with _n (words), _ranges (hit word ranges) and _items (their ids)."""
    spark = docs.sparkSession
    blocks = _blocks(benchmark, window, most_nodes)
    first, second = next(blocks, None), next(blocks, None)

    def scanned(own: DataFrame, block) -> DataFrame:
        return _found(own, spark.sparkContext.broadcast(block), hashlib.sha256(repr((window, block)).encode()).hexdigest(), window)

    if first is None:
        return _found(docs, None, "", window)
    if second is None:
        return scanned(docs, first)
    scratch = Scratch(spark, "leaks")
    held = scratch.table(docs.withColumn("_uid", F.monotonically_increasing_id()), "texts")
    counted = scratch.table(_found(held.select("_uid", *docs.columns), None, "", window).drop("_ranges", "_items"), "counted")
    parts, texts = None, held.select("_uid", docs.columns[-1])
    for block in itertools.chain((first, second), blocks):
        part = scratch.table(scanned(texts, block).where(F.size("_items") > 0), "hits")
        parts = part if parts is None else parts.union(part)
    scratch.drop(held)
    found = parts.groupBy(F.col("_uid").alias("_huid")).agg(F.flatten(F.collect_list("_ranges")).alias("_ranges"), F.array_distinct(F.flatten(F.collect_list("_items"))).alias("_items"))
    out = counted.join(found, F.col("_uid") == F.col("_huid"), "left")
    ranges = F.coalesce(_merged(F.col("_ranges")), F.array().cast("array<array<long>>"))
    return out.select(*docs.columns[:-1], "_n", ranges.alias("_ranges"), F.coalesce(F.array_sort("_items"), F.array().cast("array<string>")).alias("_items"))


def with_spans(found: DataFrame) -> DataFrame:
    """found (_ranges, and _text) with _spans, the code points of each range in the text."""
    schema = found.withColumn("_spans", F.array().cast("array<array<long>>")).schema
    at, of = found.columns.index("_text"), found.columns.index("_ranges")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [spans(t, r) if r else [] for t, r in zip(b.column(at).to_pylist(), b.column(of).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.list_(pa.list_(pa.int64())))], names=schema.names)

    return found.mapInArrow(over, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_nodes: int = MOST_NODES) -> DataFrame:
    """A row for each document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, ranges (of words)."""
    found = hits(docs.select("doc_id", "text"), benchmark, window, most_nodes)
    n_hit = F.aggregate("_ranges", F.lit(0).cast("long"), lambda acc, r: acc + r[1] - r[0])
    return found.select(
        "doc_id",
        F.col("_n").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.col("_items").alias("items"),
        F.col("_ranges").alias("ranges"),
    )


def leaked_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_nodes: int = MOST_NODES) -> DataFrame:
    """(doc_id, text, items, spans) of the documents with hits; spans are code points of the text, end exclusive."""
    found = hits(docs.select("doc_id", F.col("text").alias("_text"), "text"), benchmark, window, most_nodes).where(F.size("_ranges") > 0)
    return with_spans(found).select("doc_id", F.col("_text").alias("text"), F.col("_items").alias("items"), F.col("_spans").alias("spans"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_nodes: int = MOST_NODES) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of the benchmark occurs."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    inner = docs.select(*[docs[c].alias(n) for c, n in zip(docs.columns, names)], docs["text"].alias("_text"))
    found = hits(inner, benchmark, window, most_nodes)
    return found.where(F.size("_ranges") == 0).select(*names).toDF(*docs.columns)


#: The words as written in the contract, in SQL: windows by word position, joined on equality, so no pairs of all rows.
ORACLE_SQL = r"""
WITH low AS (SELECT 0 AS kind, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 1, item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(t, '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS ws FROM low),
iw AS (SELECT DISTINCT id AS item_id, least(len(ws), 10) AS k, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS win
  FROM (SELECT id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM w WHERE kind = 1 AND len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT id AS doc_id, k, i, array_to_string(ws[i : i + k - 1], ' ') AS win
  FROM (SELECT id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, ks WHERE kind = 0 AND len(ws) >= k)),
hit AS (SELECT doc_id, k, i, item_id FROM dw JOIN iw USING (k, win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256, list(s ORDER BY s) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT w.id AS doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos ON pos.doc_id = w.id LEFT JOIN its ON its.doc_id = w.id WHERE kind = 0
"""
