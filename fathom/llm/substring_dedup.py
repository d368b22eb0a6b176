"""Substring deduplication by collinear chaining of shared k-mer seeds.

1. Words are lower-cased runs of letters, digits and non-ASCII characters. A text's node is a digest of its words; copies
   have one node and one entry from here on, and come back at the end as passages that are whole texts.
2. Seeds are word k-mers, the smallest by hash of each run of ``SPAN`` k-mers, so two texts that share ``SPAN + K - 1`` words
   in a row share a seed. Short and dense seeds are for worn passages: 45 words that are 80 % alike by changed words have at
   least six k-mers of 4 words in common, and of three neighbouring k-mers at least one is a seed. A seed that several nodes
   have links each of them to the smallest, its anchor: as many links as occurrences, however often a passage repeats.
3. The links of two nodes are put in order and chained: the best chain that ends in a link is the best before it in both
   texts, found by prefix maxima in a Fenwick tree, less a cost for the gap. Every chain is aligned: it runs over gaps, so
   its ends do not tell what it covers.
4. The words around a chain are aligned: between seeds by longest common subsequence, beyond the ends as long as matches
   make up for what differs. Every stretch that reaches ``LEAST_WORDS`` words and ``LEAST_SHARE`` of them alike is in a
   passage, whatever the rest of its chain is like. Passages inside a passage of the same text with at least as many words alike are not rows of their own.

5. The anchors of a passage's seeds may be different third texts, for instance where its lines are frequent elsewhere. So each
   window of ``LEAST_WORDS`` words whose seeds are all shared is hashed too, and linked to the smallest node that has it: every
   word of an exact passage of that length is in a row, and runs of windows with one anchor at one offset make one row.
   A worn passage has no such window. Its shared seeds are keyed in pairs, two that are ``NEAR`` to ``FAR`` words apart, and a
   pair is linked to the smallest node that has it: a third text that holds a phrase or a line of the passage has not both.
6. Third texts can hold both seeds of every such pair, and a node that is no anchor can be the only one that has the passage.
   So every pair of a node's shared seeds at these distances whose words are not inside one of its passages by then is linked
   to all smaller nodes that have it, and these chains are aligned too. Where a passage was found its anchor stands for the others.

A text is read once: from then on its node's words are 32-bit hashes, so two different words that meet in an alignment count
as alike with probability 2^-32; k-mers and windows are hashed to 64 bits. Rows go to their seed in one exchange, and seeds
that very many nodes have are linked without one (see ``linked``).

Texts are cut out by ranges, and only cut-out words travel to the alignment. Most chains are a phrase that ends at once, so the
first ranges go ``STEP`` words beyond a chain; those that a much-shared text is asked for start at its seeds, so they are few. An alignment that is still alike at the end of what was cut out is asked for again with
a range three times as wide, until it ends inside its range or with its text.

Defined cases: null and empty texts and texts of fewer than K words have no seeds and no passages; passages repeated within
one text only are not looked for; rows with a null id are copies like others, with a null id in the result; a text's copies
refer to the smallest id of the text, once for each row; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from operator import add, lt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import decontaminate, remembered
from fathom.plans.scratch import Scratch

K = 4
SPAN = 3
LEAST_WORDS = 45
LEAST_SHARE = 0.8
GAP = 256
STEP = 8
GAP_COST = 0.05
DROP = 10
HOLE = 14
SEEN_NODES = 500_000
SAMPLE = 64
HOT_ROWS = 2_000
HOT_KEYS = 10_000
NEAR = 16
FAR = 40
PAIRS = 4
PAIR_BLOCK = 50_000
TEXTS = 256

_MUL = np.uint64(0x9E3779B97F4A7C15)


words = decontaminate.words


def hashes(own: list[bytes]) -> np.ndarray:
    """A 32-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own)) & np.uint64(0xFFFFFFFF)


def node_of(own: list[bytes]) -> int:
    return int.from_bytes(hashlib.blake2b(b" ".join(own), digest_size=8).digest(), "little", signed=True)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words in a row."""
    return grams_at(h, slice(0, len(h) - k + 1), k)


def grams_at(h: np.ndarray, at: np.ndarray | slice, k: int) -> np.ndarray:
    """The hashes of the k words from each of these places on."""
    g = h[at]
    for i in range(1, k):
        g = (g ^ (g >> np.uint64(29))) * _MUL + h[i:][at]
    g = (g ^ (g >> np.uint64(32))) * _MUL
    return g ^ (g >> np.uint64(29))


def _firsts(n: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of texts of n words that follow each other, the places of the first count words of each."""
    return np.repeat(np.cumsum(n) - n, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def chosen(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k-mers, runs, choices) of texts of n words that follow each other in h: the hash at each word, the places where the
    runs of SPAN k-mers begin, and the place of each run's smallest. A text of fewer k-mers has one run."""
    own = np.maximum(n - K + 1, 0)
    g = np.full(len(h) + SPAN, ~np.uint64(0))
    within = _firsts(n, own)
    if len(within):
        g[within] = grams(h, K)[within]
    runs = _firsts(n, np.where(own, np.maximum(own - SPAN + 1, 1), 0))
    best, choice = g[runs], runs.copy()
    for i in range(1, SPAN):
        there = g[runs + i]
        less = there < best
        best, choice = np.where(less, there, best), np.where(less, runs + i, choice)
    return g, runs, choice


def _distinct(places: np.ndarray) -> np.ndarray:
    """Which of places in order are not the one before."""
    new = np.ones(len(places), bool)
    new[1:] = places[1:] != places[:-1]
    return new


def seeds(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of a text's seeds; a seed counts at its first place only."""
    own, _, at = seeds_of(h, np.array([len(h)]))
    return own, at


def seeds_of(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, texts, positions) of the seeds of texts of n words that follow each other in h."""
    g, _, choice = chosen(h, n)
    at = choice[_distinct(choice)]
    ends = np.cumsum(n)
    text = np.searchsorted(ends, at, "right")
    own = g[at]
    cuts = np.searchsorted(at, ends).tolist()
    first = np.ones(len(at), bool)
    for lo, hi in zip([0, *cuts[:-1]], cuts):
        part = own[lo:hi]
        held = np.sort(part)
        if (held[1:] == held[:-1]).any():
            first[lo:hi] = False
            first[lo + np.unique(part, return_index=True)[1]] = True
    own, text, at = own[first], text[first], at[first]
    return own.view(np.int64), text, (at - (ends - n)[text]).astype(np.int32)


def windows(h: np.ndarray, shared: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the windows of width words that another text can have: all their seeds are shared.

    Only seeds that words inside the window choose count, since the others depend on what is around it.
    """
    at = window_places(h, np.array([len(h)]), shared, np.zeros(len(shared), np.int64), width)
    return grams_at(h, at, width).view(np.int64), at.astype(np.int32)


def window_places(h: np.ndarray, n: np.ndarray, shared: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """Places in h, where texts of n words follow each other. shared: shared seeds, each of the text with that number."""
    at = _firsts(n, np.maximum(n - width + 1, 0))
    inside = width - K - SPAN + 2  # runs of SPAN k-mers in a window
    if inside > 0 and len(at):
        g, runs, choice = chosen(h, n)
        new = _distinct(choice)
        place = choice[new]
        of_text = np.searchsorted(np.cumsum(n), place, "right").astype(np.uint64)  # a seed counts in its own text only
        is_shared = np.isin(g[place] ^ of_text * _MUL, shared.view(np.uint64) ^ text.astype(np.uint64) * _MUL)
        good = np.zeros(len(h) + 1, np.int64)
        good[runs + 1] = is_shared[np.cumsum(new) - 1]
        good = np.cumsum(good)
        at = at[good[at + inside] - good[at] == inside]
    return at


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    g = (a.view(np.uint64) ^ (a.view(np.uint64) >> np.uint64(31))) * _MUL + b.view(np.uint64)
    g = (g ^ (g >> np.uint64(29))) * _MUL
    return (g ^ (g >> np.uint64(32))).view(np.int64)


def near(text: np.ndarray, pos: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All two places of one text that are NEAR to FAR words apart, in blocks; texts are numbered, places in order of text and pos."""
    far = text * (1 << 32) + pos  # no pair reaches into another text
    low, high = np.searchsorted(far, far + NEAR), np.searchsorted(far, far + FAR, "right")
    for at in range(0, len(pos), PAIR_BLOCK):
        n = (high - low)[at : at + PAIR_BLOCK]
        i = np.repeat(np.arange(at, at + len(n)), n)
        yield i, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[i]


def seed_pairs(seed: np.ndarray, pos: np.ndarray, anode: np.ndarray, apos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, pos * 64 + distance) of a node's pairs of shared seeds, in order of pos."""
    return pairs_of(np.zeros(len(pos), np.int64), seed, pos, anode, apos)[1:]


def pairs_of(text: np.ndarray, seed: np.ndarray, pos: np.ndarray, anode: np.ndarray, apos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first seeds, keys, pos * 64 + distance) of the pairs of shared seeds of numbered texts, in order of text and pos. Of
    each first seed the PAIRS smallest keys.

    A pair whose seeds have one anchor, there as near to each other, is left out: that anchor is the smallest node with the
    pair too, and is linked already. Every node that has the pair leaves it out alike, so the choice of keys is the same in all.
    """
    firsts, keys, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in near(text, pos):
        there = apos[j] - apos[i]
        new = (anode[i] != anode[j]) | (there < NEAR) | (there > FAR)
        i, j = i[new], j[new]
        key = mixed(seed[i], seed[j])
        order = np.lexsort((key, i))
        i, j, key = i[order], j[order], key[order]
        first = np.maximum.accumulate(np.where(np.concatenate([[True], i[1:] != i[:-1]]), np.arange(len(i)), 0)) if len(i) else i
        kept = np.arange(len(i)) - first < PAIRS
        i, j = i[kept], j[kept]
        firsts.append(i)
        keys.append(key[kept])
        places.append(pos[i].astype(np.int64) * 64 + (pos[j] - pos[i]))
    return np.concatenate(firsts), np.concatenate(keys), np.concatenate(places)


def word_table(docs: DataFrame) -> DataFrame:
    """(_id, node, n_words, words) of each document row; a task gives a node's words once, however many copies it reads."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in remembered.pieces(batches):
            own = [words(t) for t in b.column(1).to_pylist()]
            nodes = [node_of(w) for w in own]
            held: list[bytes | None] = []
            for w, node in zip(own, nodes):
                fresh = len(w) >= K and node not in seen
                held.append(hashes(w).astype(np.uint32).tobytes() if fresh else None)
                if fresh and len(seen) < SEEN_NODES:
                    seen.add(node)
            cols = [b.column(0), pa.array(nodes, pa.int64()), pa.array([len(w) for w in own], pa.int32()), pa.array(held, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["_id", "node", "n_words", "words"])

    return docs.select("_id", "text").mapInArrow(over, f"_id {docs.schema['_id'].dataType.simpleString()}, node long, n_words int, words binary")


def unpacked(held: bytes) -> np.ndarray:
    return np.frombuffer(held, np.uint32).astype(np.uint64)


def _flat(held: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The packed items of all rows, and how many each has."""
    offsets = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1] // np.dtype(kind).itemsize
    flat = held.buffers()[2]
    return np.frombuffer(flat, kind, offsets[-1])[offsets[0] :] if flat else np.zeros(0, kind), np.diff(offsets)


def seed_table(texts: DataFrame) -> DataFrame:
    """(seed, node, pos). texts: (node, words), a row for each node."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in remembered.pieces(batches, TEXTS):
            h, n = _flat(b.column(1), np.uint32)
            own, text, at = seeds_of(h.astype(np.uint64), n)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(b.column(0).to_numpy()[text]), pa.array(at)], names=["seed", "node", "pos"])

    return texts.select("node", "words").mapInArrow(over, "seed long, node long, pos int")


def sampled(df: DataFrame) -> DataFrame:
    """The rows of one node in SAMPLE; a node is a digest. Only the plan depends on them."""
    return df.where(F.pmod("node", F.lit(SAMPLE)) == 0)


def linked(rows: DataFrame, sample: DataFrame | None = None, hot_rows: int = HOT_ROWS, ranked: bool = False) -> DataFrame:
    """(key, node, anode, apos, pos) of the keys that several nodes have. rows: (key, node, pos).

    The anchor is the smallest (node, pos) of its key; of its own rows that one is given, with itself as anchor. The pairs of the
    other nodes are left to other_links. A key's rows follow each other in a sorted partition. Keys with at least hot_rows rows in
    sample, a share of rows by node, are not dealt by key: their anchors, at most HOT_KEYS, are aggregated where the rows are, and
    broadcast. Further ones are dealt like all others. ranked: with third, whether another node may lie between node and anchor.
    """
    key, place = rows.columns[0], rows.schema["pos"].dataType.simpleString()
    out = f"{key} long, node long, anode long, apos {place}, pos {place}"
    out += ", third boolean" * ranked
    names = [c.split()[0] for c in out.split(", ")]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _whole(batches, 1):
            several = ~_distinct(cols[0])
            several[:-1] |= several[1:]
            k, node, pos = (c[several] for c in cols)
            order = np.lexsort((pos, node, k))
            k, node, pos = k[order], node[order], pos[order]
            start = np.maximum.accumulate(np.where(_distinct(k), np.arange(len(k)), 0))
            anode, apos = node[start], pos[start]
            other = np.flatnonzero(node != anode)
            second = other[node[other - 1] == anode[other]]  # the first row of another node: the anchor is given with it
            take = np.concatenate([second, other])
            own = [k[take], np.concatenate([anode[second], node[other]]), anode[take], apos[take], np.concatenate([apos[second], pos[other]])]
            if ranked:
                group = np.cumsum(_distinct(k))
                own.append(np.concatenate([np.zeros(len(second), bool), node[other] != node[second][np.searchsorted(group[second], group[other])]]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in own], names=names)

    def dealt(part: DataFrame) -> DataFrame:
        return part.repartition(key).sortWithinPartitions(key).mapInArrow(over, out)

    often = [] if sample is None else sample.groupBy(key).count().where(F.col("count") >= hot_rows).orderBy(F.desc("count"), key).limit(HOT_KEYS).collect()
    if not often:
        return dealt(rows)
    hot = F.broadcast(rows.sparkSession.createDataFrame([(r[0],) for r in often], f"{key} long"))
    some = rows.join(hot, key, "left_semi")
    anchors = some.groupBy(key).agg(F.min(F.struct("node", "pos")).alias("_a"), F.max("node").alias("_last")).where("_a.node < _last")
    some = some.join(F.broadcast(anchors), key).where("node <> _a.node OR pos = _a.pos")
    return dealt(rows.join(hot, key, "left_anti")).union(some.select(key, "node", F.col("_a.node").alias("anode"), F.col("_a.pos").alias("apos"), "pos", *[(F.col("node") != F.col("_a.node")).alias("third")] * ranked))


class Fenwick:
    """Prefix maxima of (value, item)."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(-1e18, -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def before(self, i: int) -> tuple[float, int]:
        """The largest of the places below i."""
        out = (-1e18, -1)
        while i > 0:
            if self.best[i] > out:
                out = self.best[i]
            i -= i & -i
        return out


def _predecessors(pos: list[int], apos: list[int], score: list[float], back: list[int]) -> None:
    """Fills in the score of each link's best chain and the link before it there."""
    n = len(pos)
    places = sorted(set(pos))
    tree = Fenwick(len(places))
    i = 0
    while i < n:
        j = i
        while j < n and apos[j] == apos[i]:
            value, k = tree.before(bisect_left(places, pos[j]))
            gain = value - GAP_COST * (pos[j] + apos[j])
            score[j] = K + max(0.0, gain)
            back[j] = k if gain > 0 else -1
            j += 1
        for m in range(i, j):
            tree.put(bisect_left(places, pos[m]), (score[m] + GAP_COST * (pos[m] + apos[m]), m))
        i = j


def chains(pos: list[int], apos: list[int]) -> list[tuple[float, list[int]]]:
    """Chains of links in order of apos: (score, links). Gap costs are linear, so a link's best predecessor is a prefix maximum."""
    n = len(pos)
    score, back = [0.0] * n, [-1] * n
    if all(map(lt, pos, pos[1:])) and all(map(lt, apos, apos[1:])):  # each link's best predecessor is the one before it
        value = -1e18
        for j, place in enumerate(map(add, pos, apos)):
            gain = value - GAP_COST * place
            score[j] = K + max(0.0, gain)
            back[j] = j - 1 if gain > 0 else -1
            value = score[j] + GAP_COST * place
    else:
        _predecessors(pos, apos, score, back)
    out, used = [], [False] * n
    for end in sorted(range(n), key=score.__getitem__, reverse=True):
        if used[end]:
            continue
        chain, at = [], end
        while at >= 0 and not used[at]:
            used[at] = True
            chain.append(at)
            at = back[at]
        out.append((score[end] - (score[at] if at >= 0 else 0.0), chain[::-1]))
    return out


def _by_group(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The groups of batches that are sorted by their first columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        own = [b.column(i).to_numpy() for i in range(keys)]
        change = np.zeros(b.num_rows, bool)
        for c in own:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and last != tuple(c[0] for c in own)
        last = tuple(c[-1] for c in own)
        at = 0
        for cut in [*np.flatnonzero(change).tolist(), b.num_rows]:
            if cut < b.num_rows or change[0] and cut == 0:
                if cut > at:
                    held.append(b.slice(at, cut - at))
                if held:
                    yield pa.Table.from_batches(held)
                held = []
            elif cut > at:
                held.append(b.slice(at, cut - at))
            at = cut
    if held:
        yield pa.Table.from_batches(held)


def _whole(batches: Iterator[pa.RecordBatch], keys: int, more: int = 0) -> Iterator[list[np.ndarray]]:
    """The columns of batches that are sorted by their first ones; no group of those is in two parts. Parts have more rows than
    that, but for the last."""
    held: list[list[np.ndarray]] = []  # from the first row of a group on
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy() for c in b.columns]
        n += b.num_rows
        cut = 0
        if n > more:
            other = np.flatnonzero(np.any([c != c[-1] for c in cols[:keys]], axis=0))
            cut = int(other[-1]) + 1 if len(other) else 0
            if not cut and held and any(h[-1] != c[0] for h, c in zip(held[-1][:keys], cols)):
                yield [np.concatenate(c) for c in zip(*held)]
                held, n = [], b.num_rows
        if cut:
            held.append([c[:cut] for c in cols])
            yield [np.concatenate(c) for c in zip(*held)]
            held, n = [], b.num_rows - cut
        held.append([c[cut:] for c in cols])
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


CHAIN = "node long, score double, anode long, s int, e int, a_s int, a_e int, links array<int>"
_CHAIN = pa.schema(
    [("node", pa.int64()), ("score", pa.float64()), ("anode", pa.int64()), ("s", pa.int32()), ("e", pa.int32()), ("a_s", pa.int32()), ("a_e", pa.int32()), ("links", pa.list_(pa.int32()))]
)


def _flush(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def chain_table(links: DataFrame) -> DataFrame:
    """The chains of each pair of nodes; links alternate position and anchor's position.

    links: (node, anode, apos, pos), places as of pairs, place * 64 + distance to the second seed; of one seed the distance is 0.
    """

    def made(node: np.ndarray, anode: np.ndarray, apos: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((pos, apos, anode, node))
        node, anode, apos, pos = node[order], anode[order], apos[order], pos[order]
        pair = np.ones(len(node), bool)
        pair[1:] = (node[1:] != node[:-1]) | (anode[1:] != anode[:-1])
        new = pair.copy()
        new[1:] |= (apos[1:] != apos[:-1]) | (pos[1:] != pos[:-1])
        node, anode, apos, pos, at = node[new], anode[new], apos[new], pos[new], np.flatnonzero(pair[new])
        ends = np.append(at[1:], len(node))
        first = at[ends == at + 2]  # pairs of two links are one chain or two
        gain = K + GAP_COST * (pos[first] + apos[first]) - GAP_COST * (pos[first + 1] + apos[first + 1])
        chained = (pos[first] < pos[first + 1]) & (apos[first] < apos[first + 1]) & (gain > 0)
        one = np.concatenate([at[ends == at + 1], first[~chained], first[~chained] + 1])  # chains as they are
        two = first[chained]
        for start, end, score in ((one, one, np.full(len(one), float(K))), (two, two + 1, K + gain[chained])):
            n = 2 if end is one else 4
            flat = np.stack([c[x] for x in (start, end)[: n // 2] for c in (pos, apos)], axis=1).astype(np.int32).reshape(-1)
            own = [node[start], score, anode[start], pos[start], pos[end] + K, apos[start], apos[end] + K]
            links = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(start) + 1, n, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*[pa.array(c, f.type) for c, f in zip(own, _CHAIN)], links], schema=_CHAIN)
        rows: list[tuple] = []
        more = ends > at + 2
        for i, j in zip(at[more].tolist(), ends[more].tolist()):
            p, q = pos[i:j].tolist(), apos[i:j].tolist()
            for score, chain in chains(p, q):
                flat = [x for k in chain for x in (p[k], q[k])]
                rows.append((int(node[i]), score, int(anode[i]), flat[0], flat[-2] + K, flat[1], flat[-1] + K, flat))
        yield _flush(rows, _CHAIN)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _whole(batches, 1):
            pair = np.flatnonzero(cols[3] & 63)  # both seeds are links
            places = [np.concatenate([c >> 6, (c[pair] >> 6) + (c[pair] & 63)]) for c in cols[2:]]
            yield from made(*[np.concatenate([c, c[pair]]) for c in cols[:2]], *places)

    dealt = links.repartition("node", "anode").sortWithinPartitions("node")
    return dealt.select("node", "anode", "apos", "pos").mapInArrow(over, CHAIN)


def _packed(node: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Nodes in order, once each, and the bytes of their items."""
    at = np.flatnonzero(_distinct(node))
    ends = (np.append(at, len(node)) * (items.nbytes // max(1, len(items)))).astype(np.int32)
    return node[at], pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(items))])


def by_place(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Columns in order of the first two. Spark sorts by one number fastest, so what is within a node is left to its task."""
    order = np.lexsort((cols[1], cols[0]))
    return [c[order] for c in cols]


def packed_by_node(rows: DataFrame, name: str) -> DataFrame:
    """(node, name): of each node the distinct rows, their other columns packed."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _whole(batches, 1):
            order = np.lexsort(cols[::-1])
            cols = [c[order] for c in cols]
            new = np.any([_distinct(c) for c in cols], axis=0)
            node, held = _packed(cols[0][new], np.stack([c[new] for c in cols[1:]], axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(node), held], names=["node", name])

    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(over, f"node long, {name} binary")


def pair_table(shared: DataFrame) -> DataFrame:
    """(pair, node, pos, shared): the pairs of each node's shared seeds, and for each node a row with its packed shared seeds.

    shared: (seed, node, anode, apos, pos).
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, pos, seed, anode, apos in map(by_place, _whole(batches, 1)):
            first, keys, places = pairs_of(np.cumsum(_distinct(node)), seed, pos, anode, apos)
            own, packed = _packed(node, seed)
            n, m = len(keys), len(own)
            cols = [[pa.array(keys), pa.nulls(m, pa.int64())], [pa.array(node[first]), pa.array(own)], [pa.array(places), pa.nulls(m, pa.int64())], [pa.nulls(n, pa.binary()), packed]]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in cols], names=["pair", "node", "pos", "shared"])

    dealt = shared.select("node", "pos", "seed", "anode", "apos").repartition("node").sortWithinPartitions("node")
    return dealt.mapInArrow(over, "pair long, node long, pos long, shared binary")


def pair_links(held: DataFrame) -> DataFrame:
    """(node, anode, apos, pos), the places of pairs that several nodes have. held: (pair, node, pos)."""
    return linked(held, sampled(held)).where("node <> anode").select("node", "anode", "apos", "pos")


def open_pairs(shared: DataFrame, whole: DataFrame) -> DataFrame:
    """(pair, s1, s2, node, pos, a1, a2): of each node all pairs of seeds whose words are not inside one of its passages; a1 and a2
    are the anchors that it was held against for them. A smaller node that has both and is neither lies between it and either
    anchor, so only seeds with third count. shared: (seed, node, anode, pos, third); whole: passages."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _whole(batches, 1):
            order = np.lexsort((-cols[2], cols[1], cols[0]))  # passages before seeds at one place
            node, pos, end, seed, anode = (c[order] for c in cols)
            text = np.cumsum(_distinct(node))
            reach = np.maximum.accumulate(text * (1 << 32) + end) & 0xFFFFFFFF  # where the passages that began in this text end
            at = np.flatnonzero(end == 0)
            node, pos, seed, anode, reach = node[at], pos[at], seed[at], anode[at], reach[at]
            for i, j in near(text[at], pos):
                left = pos[j] + K > reach[i]
                i, j = i[left], j[left]
                own = [mixed(seed[i], seed[j]), seed[i], seed[j], node[i], pos[i].astype(np.int64) * 64 + (pos[j] - pos[i]), anode[i], anode[j]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in own], names=["pair", "s1", "s2", "node", "pos", "a1", "a2"])

    passages = whole.selectExpr("node", "start_word AS pos", "end_word AS end", "0L AS seed", "node AS anode")
    rows = shared.where("third").selectExpr("node", "pos", "0 AS end", "seed", "anode").union(passages)
    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(over, "pair long, s1 long, s2 long, node long, pos long, a1 long, a2 long")


def every_pair(shared: DataFrame) -> DataFrame:
    """(pair, node, pos): all pairs of each node's seeds. shared: (seed, node, pos)."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, pos, seed in map(by_place, _whole(batches, 1)):
            for i, j in near(np.cumsum(_distinct(node)), pos):
                own = [mixed(seed[i], seed[j]), node[i], pos[i].astype(np.int64) * 64 + (pos[j] - pos[i])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in own], names=["pair", "node", "pos"])

    dealt = shared.select("node", "pos", "seed").repartition("node").sortWithinPartitions("node")
    return dealt.mapInArrow(over, "pair long, node long, pos long")


def other_links(shared: DataFrame, left: DataFrame) -> DataFrame:
    """(node, anode, apos, pos): links of the pairs in left, as open_pairs gives them, to every smaller node that has the pair, but
    for the anchors that the node was held against. Such a node is no anchor of either seed: shared has no anchors' rows."""
    seeds = left.select(F.col("s1").alias("seed")).union(left.select("s2")).distinct()
    held = every_pair(shared.join(seeds, "seed", "left_semi")).toDF("pair", "other", "apos")
    new = (F.col("other") < F.col("node")) & (F.col("other") != F.col("a1")) & (F.col("other") != F.col("a2"))
    return left.join(held, "pair").where(new).select("node", F.col("other").alias("anode"), "apos", "pos")


def _slices(texts: DataFrame, ranges: DataFrame) -> DataFrame:
    """(node, lo, hi, words) of the distinct ranges."""
    held = packed_by_node(ranges, "ranges").join(texts, "node").select("node", "ranges", "words")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in remembered.pieces(batches):
            flat, n = _flat(b.column(2), np.uint32)
            ranges, m = _flat(b.column(1), np.int32)
            lo, hi = ranges.reshape(-1, 2).T
            own = np.repeat(np.arange(len(m)), m // 2)
            size = np.minimum(hi, n[own]) - lo
            ends = np.cumsum(size)
            cut = flat[np.repeat((np.cumsum(n) - n)[own] + lo - (ends - size), size) + np.arange(size.sum())]
            words = pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(np.append(0, 4 * ends).astype(np.int32)), pa.py_buffer(cut)])
            cols = [pa.array(b.column(0).to_numpy()[own]), pa.array(np.ascontiguousarray(lo)), pa.array(np.ascontiguousarray(hi)), words]
            yield pa.RecordBatch.from_arrays(cols, names=["node", "lo", "hi", "words"])

    return held.mapInArrow(over, "node long, lo int, hi int, words binary")


def window_table(texts: DataFrame, shared: DataFrame, width: int) -> DataFrame:
    """(window, node, pos) of the windows that another text can have. shared: (node, seed), or (node, shared) as in pair_table."""
    held = (shared if "shared" in shared.columns else packed_by_node(shared.select("node", "seed"), "shared")).join(texts, "node").select("node", "shared", "words")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in remembered.pieces(batches, TEXTS):
            h, n = _flat(b.column(2), np.uint32)
            h = h.astype(np.uint64)
            own, m = _flat(b.column(1), np.int64)
            at = window_places(h, n, own, np.repeat(np.arange(len(m)), m), width)
            text = np.searchsorted(np.cumsum(n), at, "right")
            pos = at - (np.cumsum(n) - n)[text]
            yield pa.RecordBatch.from_arrays([pa.array(grams_at(h, at, width).view(np.int64)), pa.array(b.column(0).to_numpy()[text]), pa.array(pos.astype(np.int32))], names=["window", "node", "pos"])

    return held.mapInArrow(over, "window long, node long, pos int")


def exact_runs(held: DataFrame, width: int) -> DataFrame:
    """Passages of equal words: of each node, the windows in a row at one offset to one anchor. held: (window, node, pos)."""
    links = linked(held, sampled(held)).where("node <> anode").select("node", "anode", (F.col("pos") - F.col("apos")).alias("shift"), "pos")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _whole(batches, 1):
            order = np.lexsort(cols[::-1])
            node, anode, shift, pos = (c[order] for c in cols)
            new = np.any([_distinct(c) for c in (node, anode, shift)], axis=0)
            new[1:] |= pos[1:] > pos[:-1] + 1
            at = np.flatnonzero(new)
            s, e = pos[at], pos[np.append(at[1:], len(pos)) - 1]
            own = (node[at], anode[at], s, e + width, s - shift[at], e + width - shift[at], e + width - s, np.zeros(len(s)))
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(own, _PASSAGE)], schema=_PASSAGE)

    dealt = links.repartition("node").sortWithinPartitions("node")
    return dealt.mapInArrow(over, PASSAGE)


def _joined(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs (i, j, length) of equal words, those that go on at the same offset made one."""
    out: list[tuple[int, int, int]] = []
    for i, j, n in runs:
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            i, j, m = out.pop()
            n += m
        out.append((i, j, n))
    return out


def _common(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """The longest common subsequence as runs.

    A row of its table is the bits of the columns at which the length grows by one, so a row is made from the last at once.
    """
    at: dict[int, int] = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    if at.keys().isdisjoint(a):
        return []
    every = (1 << len(b)) - 1
    flat, rows = every, [0]
    for x in a:
        if x in at:
            met = flat & at[x]
            flat = ((flat + met) | (flat - met)) & every
        rows.append(every ^ flat)
    i, j, below, out = len(a), len(b), every, []
    while rows[i] & below:
        if a[i - 1] == b[j - 1]:
            i, j, below = i - 1, j - 1, below >> 1
            out.append((i, j, 1))
        elif (rows[i - 1] & below).bit_count() == (rows[i] & below).bit_count():
            i -= 1
        else:
            j, below = j - 1, below >> 1
    return _joined(out[::-1])


def _beyond(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """The runs in which two texts stay alike from their beginning. A match gains one, a difference costs two."""
    return _reach(a, b)[0]


def _reach(a: list[int], b: list[int]) -> tuple[list[tuple[int, int, int]], bool, bool]:
    """_beyond, and whether the words of a, and those of b, ended before the likeness did."""
    i = j = score = best = 0
    out: list[tuple[int, int, int]] = []
    kept = 0
    n_a, n_b = len(a), len(b)
    while i < n_a and j < n_b:
        if a[i] == b[j]:
            n, most = 1, min(n_a - i, n_b - j)
            while n < most and a[i + n] == b[j + n]:
                n += 1
            out.append((i, j, n))
            i, j, score = i + n, j + n, score + n
            if score > best:
                best, kept = score, len(out)
        else:
            for x, y in _SKIPS:
                if i + x + 1 < n_a and j + y + 1 < n_b and a[i + x] == b[j + y] and a[i + x + 1] == b[j + y + 1]:
                    break
            else:
                break
            i, j, score = i + x, j + y, score - 2 * max(x, y)
            if score < best - DROP:
                return out[:kept], False, False
    return out[:kept], i + 5 > n_a, j + 5 > n_b


def _before(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """The runs in which two texts stay alike back from their end."""
    return [(len(a) - i - n, len(b) - j - n, n) for i, j, n in reversed(_beyond(a[::-1], b[::-1]))]


def _alike(a: list[int], b: list[int]) -> int:
    """How many words are equal from the first on."""
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _between(a: list[int], b: list[int]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], bool]:
    """The runs between two seeds, and whether too little is alike there: then the runs next to the first and next to the second."""
    head = _alike(a, b)
    tail = _alike(a[head:][::-1], b[head:][::-1])
    first, last = [(0, 0, head)] * (head > 0), [(len(a) - tail, len(b) - tail, tail)] * (tail > 0)
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    gap = max(len(a), len(b))
    if gap <= GAP:
        own = [(i + head, j + head, n) for i, j, n in _common(x, y)]
        if gap <= HOLE or head + tail + sum(n for _, _, n in own) >= 0.5 * gap:
            return first + own + last, [], False
    after = _beyond(x, y)
    i, j = (after[-1][0] + after[-1][2], after[-1][1] + after[-1][2]) if after else (0, 0)
    back = [(u + i + head, v + j + head, n) for u, v, n in _before(x[i:], y[j:])]
    return first + [(u + head, v + head, n) for u, v, n in after], back + last, True


def stretches(runs: list[tuple[int, int, int]], least_words: int, least_share: float) -> list[tuple[int, int]]:
    """(first run, last run) of stretches that reach both leasts. Every run that is in any such stretch is in one of these."""
    p, q, n = (np.array(c, np.int64) for c in zip(*runs))
    total = np.concatenate([[0], np.cumsum(n)])
    widest: list[tuple[int, int]] = []
    reach = -1
    for i in range(len(runs)):
        at = max(reach + 1, i)
        own, other = (p + n)[at:] - p[i], (q + n)[at:] - q[i]
        good = np.flatnonzero((np.minimum(own, other) >= least_words) & (total[at + 1 :] - total[i] >= least_share * np.maximum(own, other)))
        if len(good):
            reach = at + int(good[-1])
            widest.append((i, reach))
        if reach == len(runs) - 1:
            break
    out: list[tuple[int, int]] = []
    for k, (i, j) in enumerate(widest):  # one that the last and the next one cover between them is left out
        if not out or k + 1 == len(widest) or widest[k + 1][0] > out[-1][1]:
            out.append((i, j))
    return out


def align(
    a: np.ndarray, b: np.ndarray, links: list[int], lo: int, alo: int, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE
) -> list[tuple[int, int, int, int, int, int]]:
    """Passages along a chain: (s, e, a_s, a_e, alike, holes)."""
    return aligned(a, b, links, lo, alo, least_words, least_share)[0]


Ends = tuple[list[tuple[int, int, int]], tuple[bool, bool], list[tuple[int, int, int]], tuple[bool, bool]]


def beyond_ends(a: np.ndarray, b: np.ndarray, links: list[int], lo: int, alo: int) -> Ends:
    """The runs before a chain, counted back from it, with whether a, and b, ended before the likeness did; the same behind it."""
    e, f = links[0] - lo, links[1] - alo
    ahead, *began = _reach(a[:e][::-1].tolist(), b[:f][::-1].tolist())
    behind, *ended = _reach(a[links[-2] + K - lo :].tolist(), b[links[-1] + K - alo :].tolist())
    return ahead, tuple(began), behind, tuple(ended)


def too_little(a: np.ndarray, b: np.ndarray, links: list[int], lo: int, alo: int, outside: int, least: float) -> bool:
    """Whether fewer than least words can be alike along a chain, outside of them beyond its ends. Bounds from above: the words
    of the shorter side, then those of either side that the other one has, in whatever order."""
    e, e2, f, f2 = links[0] - lo, links[-2] + K - lo, links[1] - alo, links[-1] + K - alo
    if outside + min(e2 - e, f2 - f) < least:
        return True
    x, y = a[e:e2].tolist(), b[f:f2].tolist()
    return outside + sum(map(set(y).__contains__, x)) < least or outside + sum(map(set(x).__contains__, y)) < least


def aligned(
    a: np.ndarray, b: np.ndarray, links: list[int], lo: int, alo: int, least_words: int, least_share: float, ends: Ends | None = None
) -> tuple[list[tuple[int, int, int, int, int, int]], tuple[bool, bool], tuple[bool, bool]]:
    """Passages along a chain, and whether a, and b, ended before the likeness did: before the chain, and behind it.

    The chain is cut where too little is alike, and each part gives the stretches that reach the leasts. Runs that are in
    none of them, but in a stretch over such a place, come with that stretch, and holes is 1.
    """
    pairs = [(links[i] - lo, links[i + 1] - alo) for i in range(0, len(links), 2)]
    ahead, began, behind, ended = ends or beyond_ends(a, b, links, lo, alo)
    if too_little(a, b, links, lo, alo, sum(n for _, _, n in ahead + behind), least_share * least_words):
        return [], began, ended
    a, b = a.tolist(), b.tolist()
    e, f = pairs[0]
    runs, cuts = [(e - i - n, f - j - n, n) for i, j, n in reversed(ahead)], set()
    for p, q in pairs:
        n = K
        if p < e or q < f:  # this seed overlaps the last: take what is new
            new = max(e - p, f - q)
            if new >= K:
                continue
            p, q, n = p + new, q + new, K - new
        if p - e == q - f and a[e:p] == b[f:q]:
            runs.append((e, f, p - e + n))
        else:
            own, back, cut = _between(a[e:p], b[f:q])
            runs += [(e + i, f + j, m) for i, j, m in own]
            if cut:
                cuts.add((e + back[0][0], f + back[0][1]) if back else (p, q))
            runs += [(e + i, f + j, m) for i, j, m in back]
            runs.append((p, q, n))
        e, f = p + n, q + n
    runs = _joined(runs + [(e + i, f + j, n) for i, j, n in behind])
    if sum(n for _, _, n in runs) < least_share * least_words:  # no stretch can reach both leasts
        return [], began, ended
    starts = [i for i in range(1, len(runs)) if runs[i][:2] in cuts or max(runs[i][0] - runs[i - 1][0], runs[i][1] - runs[i - 1][1]) - runs[i - 1][2] > HOLE]

    out, inside = [], set()
    for x, y in zip([0, *starts], [*starts, len(runs)]):
        for i, j in stretches(runs[x:y], least_words, least_share):
            out.append((x + i, x + j, 0))
            inside.update(range(x + i, x + j + 1))
    if starts:
        out += [(i, j, 1) for i, j in stretches(runs, least_words, least_share) if not inside.issuperset(range(i, j + 1))]
    found = [
        (runs[i][0] + lo, runs[j][0] + runs[j][2] + lo, runs[i][1] + alo, runs[j][1] + runs[j][2] + alo, sum(n for _, _, n in runs[i : j + 1]), holes)
        for i, j, holes in out
    ]
    return found, began, ended


def wider(a: int, b: int, lo: int, hi: int, alo: int, ahi: int, began: tuple[bool, bool], ended: tuple[bool, bool]) -> tuple[int, int, int, int] | None:
    """The ranges to cut out next, or None if all that is alike was seen. a, b: how many words the ranges lo-hi, alo-ahi had."""

    def goes_on(out: tuple[bool, bool], more: tuple[bool, bool]) -> bool:
        return any(o and m for o, m in zip(out, more))

    before, after = goes_on(began, (lo > 0, alo > 0)), goes_on(ended, (a == hi - lo, b == ahi - alo))
    if not before and not after:
        return None
    n, m = hi - lo, ahi - alo
    return max(0, lo - 2 * n * before), hi + 2 * n * after, max(0, alo - 2 * m * before), ahi + 2 * m * after


_SKIPS = ((1, 1), (1, 0), (0, 1), (2, 2), (2, 0), (0, 2), (3, 3))  # words of each text that _reach may leave out


def _around(held: pa.Array, at: np.ndarray, step: int, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's packed words, those from word at on (step 1) or back from it (step -1) in STEP + 5 columns, those that
    there are not being fill, and how many there are."""
    offsets = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1]
    flat = np.frombuffer(held.buffers()[2], np.uint32, offsets[-1] // 4)
    start, end = offsets[:-1, None] // 4, offsets[1:, None] // 4
    place = start + at[:, None] + step * np.arange(STEP + 5)
    inside = (place >= start) & (place < end) & (np.arange(STEP + 5) < STEP)
    n = at + 1 if step < 0 else end[:, 0] - start[:, 0] - at
    return np.where(inside, flat[np.where(inside, place, 0)].astype(np.int64), fill), n


def _stops(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words are alike from the first on, and whether _reach ends there."""
    m, rows = (a == b).argmin(axis=1), np.arange(len(a))
    on = np.zeros(len(a), bool)
    for x, y in _SKIPS:
        on |= (a[rows, m + x] == b[rows, m + y]) & (a[rows, m + x + 1] == b[rows, m + y + 1])
    return m, ~on


def nothing_more(batch: pa.RecordBatch, least_words: int, least_share: float) -> np.ndarray:
    """Rows (lo, hi, alo, ahi, links, _a, _b) of a short chain whose words differ soon on both sides: aligned finds nothing in
    them and wider asks for no more. Most chains are such, and are told so for a batch at once."""
    lo, hi, alo, ahi = (batch.column(c).to_numpy() for c in ("lo", "hi", "alo", "ahi"))
    out = np.zeros(batch.num_rows, bool)
    n = batch.column("links").value_lengths().to_numpy()
    links, last = batch.column("links").flatten().to_numpy(), np.cumsum(n)
    if not len(n):
        return out
    p, q, p2, q2 = links[last - n] - lo, links[last - n + 1] - alo, links[last - 2] + K - lo, links[last - 1] + K - alo
    most = np.minimum(p2 - p, q2 - q)  # of the words that can be alike
    one = np.flatnonzero(most < least_share * least_words)
    if not len(one):
        return out
    own = batch.take(pa.array(one))
    lo, hi, alo, ahi, p, q, p2, q2, most = (c[one] for c in (lo, hi, alo, ahi, p, q, p2, q2, most))
    a, b = own.column("_a"), own.column("_b")
    good = np.ones(len(one), bool)
    sides = []
    for step, x, y in ((-1, p - 1, q - 1), (1, p2, q2)):
        (u, n), (v, m) = _around(a, x, step, -1), _around(b, y, step, -2)
        alike, ends = _stops(u, v)
        most = most + alike
        good &= (n <= STEP) & (m <= STEP) & ends
        sides.append((alike + 5 > n, alike + 5 > m, n, m))
    (began_a, began_b, *_), (ended_a, ended_b, n, m) = sides
    total = p2 + n
    good &= (most < least_share * least_words) & ~((began_a & (lo > 0)) | (began_b & (alo > 0)))
    out[one] = good & ~((ended_a & (total == hi - lo)) | (ended_b & (q2 + m == ahi - alo)))
    return out


PASSAGE = "node long, anode long, start_word int, end_word int, other_start int, other_end int, alike int, holes int"
_PASSAGE = pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.int32()) for x in PASSAGE.split(", ")])


ALIGNED = PASSAGE + ", lo int, hi int, alo int, ahi int, links array<int>"
_ALIGNED = pa.schema([*_PASSAGE, *[(c, pa.int32()) for c in ("lo", "hi", "alo", "ahi")], ("links", pa.list_(pa.int32()))])


def outermost(found: DataFrame) -> DataFrame:
    """Of each node, the distinct passages inside no other of its passages that has as many words alike and no holes."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _whole(batches, 1):
            node, anode, s, e, other, other_end, alike, holes = cols
            order = np.lexsort((other_end, other, anode, holes, -alike, -e, s, node))
            cols = [c[order] for c in cols]
            cols = [c[np.any([_distinct(x) for x in cols], axis=0)] for c in cols]
            kept: list[int] = []
            reach: list[tuple[int, int]] = []  # those kept that end furthest and have the most words alike: ends fall, alike rises
            rows = zip(_distinct(cols[0]).tolist(), cols[3].tolist(), cols[6].tolist(), cols[7].tolist())
            for i, (new, e, n, hole) in enumerate(rows):
                if new:
                    reach = []
                elif any(x >= e and y >= n for x, y in reach):
                    continue
                kept.append(i)
                if not hole:
                    reach = [(x, y) for x, y in reach if x > e or y > n] + [(e, n)]
            yield pa.RecordBatch.from_arrays([pa.array(c[kept], f.type) for c, f in zip(cols, _PASSAGE)], schema=_PASSAGE)

    return found.select(*_PASSAGE.names).repartition("node").sortWithinPartitions("node").mapInArrow(over, PASSAGE)


def passages(docs: DataFrame, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """A row for each passage of a document that another document has too.

    doc_id, start_word, end_word (words of the document, end exclusive), other_id, other_start, other_end, share (of the
    longer side's words that are alike). A document that is a copy of another has one row, the whole text.
    """
    scratch = Scratch(docs.sparkSession, "substring", tidy=True)
    text = F.coalesce(docs["text"], F.lit(""))
    rows = scratch.table(word_table(docs.select(docs["doc_id"].alias("_id"), text.alias("text"))), "words")
    texts = scratch.table(rows.where("words IS NOT NULL").select("node", "words").repartition("node").groupBy("node").agg(F.any_value("words").alias("words")), "texts")
    nodes = scratch.table(rows.drop("words"), "nodes")
    scratch.drop(rows)

    shared = scratch.table(linked(seed_table(texts), seed_table(sampled(texts)), ranked=True), "shared")
    packed = scratch.table(pair_table(shared), "pairs")
    pairs = scratch.table(pair_links(packed.where("shared IS NULL").select("pair", "node", "pos")), "pair-links")
    links = shared.where("node <> anode").selectExpr("node", "anode", "apos * 64L AS apos", "pos * 64L AS pos").union(pairs)
    found = scratch.table(chain_table(links), "chains")
    rest = scratch.table(shared.where("node <> anode").select("seed", "node", "anode", "pos", "third"), "rest")  # all that other_links needs
    scratch.drop(pairs, shared)
    held = scratch.table(window_table(texts, packed.where("shared IS NOT NULL").select("node", "shared"), least_words), "windows")
    scratch.drop(packed)
    exact = scratch.table(exact_runs(held, least_words), "exact")
    scratch.drop(held)

    def lo(c: str) -> F.Column:
        return F.greatest(F.lit(0), F.col(c) - STEP)

    def hi(c: str) -> F.Column:
        return F.col(c) + STEP

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            batch = batch.filter(pa.array(~nothing_more(batch, least_words, least_share)))
            for node, anode, low, high, alow, ahigh, links, a, b in zip(*[c.to_pylist() for c in batch.columns]):
                a, b = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
                ends = beyond_ends(a, b, links, low, alow)
                again = wider(len(a), len(b), low, high, alow, ahigh, ends[1], ends[3])
                if again is None:
                    rows += [(node, anode, *p, *[None] * 5) for p in aligned(a, b, links, low, alow, least_words, least_share, ends)[0]]
                else:  # what lies between is aligned once all is cut out
                    rows.append((node, anode, *[None] * 6, *again, links))
            yield _flush(rows, _ALIGNED)

    def settled(chains: DataFrame) -> list[DataFrame]:
        """The passages along chains."""
        asked = chains.select("node", "anode", lo("s").alias("lo"), hi("e").alias("hi"), lo("a_s").alias("alo"), hi("a_e").alias("ahi"), "links")
        done = []
        while not done or not asked.isEmpty():  # ranges grow threefold, so there are few rounds, and each has only what the last one left open
            ranges = asked.select("node", "lo", "hi").union(asked.select("anode", "alo", "ahi")).distinct()
            cut = scratch.table(_slices(texts, ranges), "slices")  # distinct before the deal by node: a frequent anchor has equal ranges
            both = asked.join(cut.withColumnRenamed("words", "_a"), ["node", "lo", "hi"]).join(cut.toDF("anode", "alo", "ahi", "_b"), ["anode", "alo", "ahi"])
            part = scratch.table(both.select("node", "anode", "lo", "hi", "alo", "ahi", "links", "_a", "_b").mapInArrow(over, ALIGNED), "aligned")
            scratch.drop(cut)
            done.append(part.where("links IS NULL").select(*exact.columns))
            asked = part.where("links IS NOT NULL").select("node", "anode", "lo", "hi", "alo", "ahi", "links")
        return done

    whole = scratch.table(outermost(reduce(DataFrame.union, settled(found), exact)), "whole")
    scratch.drop(found, exact)
    left = scratch.table(open_pairs(rest, whole), "open")
    more = scratch.table(chain_table(other_links(rest, left)), "more-chains")
    scratch.drop(rest, left)
    if not more.isEmpty():
        whole = scratch.table(outermost(reduce(DataFrame.union, settled(more), whole)), "whole")
    scratch.drop(more, texts)
    named = nodes.groupBy("node").agg(F.min("_id").alias("_first"))
    shared = whole.join(named.withColumnRenamed("_first", "doc_id"), "node").join(named.toDF("anode", "other_id"), "anode")
    shared = shared.select(
        "doc_id", "start_word", "end_word", "other_id", "other_start", "other_end",
        (F.col("alike") / F.greatest(F.col("end_word") - F.col("start_word"), F.col("other_end") - F.col("other_start"))).alias("share"),
    )
    copies = nodes.where(F.col("n_words") >= least_words).join(named, "node").where(~F.col("_id").eqNullSafe(F.col("_first")))
    copies = copies.select(
        F.col("_id").alias("doc_id"), F.lit(0).alias("start_word"), F.col("n_words").alias("end_word"), F.col("_first").alias("other_id"),
        F.lit(0).alias("other_start"), F.col("n_words").alias("other_end"), F.lit(1.0).alias("share"),
    )
    return shared.union(copies)


def word_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges of a text as code points, end exclusive."""
    return decontaminate.spans(text, ranges)
