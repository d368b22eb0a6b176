"""Near-duplicates: SuperMinHash signatures, banding, verification on full shingle sets, union-find grouping.

1. Every text becomes a class key, a digest of its lower-cased words. Rows of one class have one set of shingles, so only a
   class goes on; copies, however many, are one row from here.
2. A class gets a SuperMinHash signature: each shingle spreads its ranks over the slots by its own permutation, step by
   step, and the steps end as soon as no later rank can win. Ranks of an element are correlated, which lowers the variance.
3. Slots in bands give buckets. A bucket's members are compared with its smallest member, its centre, never all with all.
   Pairs whose signatures agree too little for the threshold (five standard deviations below it) go no further.
4. Links are confirmed on the full sets. First each class with the centre it agrees with most. Then, in buckets that still
   hold several groups, for a few rounds each class with the class of another group that it agrees with most. Last, where
   groups are left, each member against the members outside the bucket's largest group, so that no link between two groups
   is missed. That goes in tiles of bounded size, each counting what its sets share by one product of matrices; a tile gives
   no pairs but the links that join groups, fewer than it has members.
5. Groups are the connected components of the confirmed links.

A pair at the threshold shares no bucket with probability (1 - t^4)^24, 3e-6 at t = 0.8, and less above it.

Defined cases: null and empty texts, and texts without words, have no shingles and are linked with nothing; a text of fewer
words than a shingle is one shingle; rows of one class are linked; rows that share an id keep their own class; a group's
component_id is its smallest id, null only if all its ids are; an empty table gives an empty result; other columns are
carried by ``survivors`` and not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm import remembered
from fathom.operators.components import connected_components
from fathom.plans.scratch import Scratch

BANDS, ROWS = 24, 4
SLOTS = BANDS * ROWS
CACHE_ENTRIES = 300_000
CHUNK = 1 << 16
BLOCK = 256
ROUNDS = 2
TILE = (512, 1024)
TILE_BYTES = 48 << 20
COLUMNS = 2048

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_MUL = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Word -> 64-bit hash; bounded."""

    def __missing__(self, word: bytes) -> int:
        out = xxhash.xxh3_64_intdigest(word)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        if len(word) <= 64:
            self[word] = out
        return out


_WORDS = _Words()


def _begin() -> None:
    remembered.only(_WORDS)


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(own: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a list of words."""
    h = np.fromiter(map(_WORDS.__getitem__, own), np.uint64, len(own))
    k = min(size, len(h))
    if not k:
        return h
    out = h[: len(h) - k + 1]
    for i in range(1, k):
        out = _mixed(out * _MUL) + h[i : len(h) - k + 1 + i]
    return np.unique(_mixed(out + np.uint64(k)))


def superminhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """A row of slots for each set: the step at which a slot's smallest rank came, above 24 bits of that rank."""
    h = np.full((len(sets), slots), 0xFFFFFFFF, np.uint32)
    flat = h.reshape(-1)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    items = np.concatenate([*sets, np.zeros(0, np.uint64)])
    for at in range(0, len(items), CHUNK):
        doc, item = owner[at : at + CHUNK], items[at : at + CHUNK]
        own = np.unique(doc)
        perm = np.tile(np.arange(slots, dtype=np.uint8), (len(item), 1))
        rows = np.arange(len(item))
        for j in range(slots):
            bits = _mixed(item + np.uint64((j + 1) * int(_MUL) & 0xFFFFFFFFFFFFFFFF))
            k = j + ((bits >> np.uint64(32)) % np.uint64(slots - j)).astype(np.int64)
            p = perm[rows, k]
            perm[rows, k] = perm[rows, j]
            np.minimum.at(flat, doc * slots + p, (np.uint32(j) << np.uint32(24)) | (bits & np.uint64(0xFFFFFF)).astype(np.uint32))
            open_docs = np.zeros(len(sets), bool)
            open_docs[own] = h[own].max(axis=1) >= np.uint32(j + 1) << np.uint32(24)
            keep = open_docs[doc]
            if not keep.any():
                break
            if not keep.all():
                doc, item, perm = doc[keep], item[keep], perm[keep]
                rows = np.arange(len(item))
    return h


def _short(h: np.ndarray) -> np.ndarray:
    """16 bits of each slot: a slot of two different values agrees once in 65,536."""
    x = h.astype(np.uint64) * _MUL
    return (x >> np.uint64(48)).astype(np.uint16)


def _pack(own: np.ndarray) -> bytes:
    """48 bits of each hash."""
    own = np.unique(own >> np.uint64(16))
    return own.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def _key(own: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(own), digest_size=16).digest()


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """docs: _id, _h, text. A row for each: _id, _h, key, n_shingles, sig (null without words)."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        for batch in remembered.pieces(batches):
            texts = batch.column(2).to_pylist()
            keys, sets = [], []
            for t in texts:
                own = words(t)
                keys.append(_key(own))
                sets.append(shingle_set(own, size))
            h = _short(superminhash(sets))
            sigs = [h[i].tobytes() if len(s) else None for i, s in enumerate(sets)]
            cols = [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["_id", "_h", "key", "n_shingles", "sig"])

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.select("_id", "_h", "text").mapInArrow(over, f"_id {kind}, _h long, key binary, n_shingles long, sig binary")


def _band(i: int) -> Column:
    return F.xxhash64(F.lit(i), F.substring("sig", 2 * ROWS * i + 1, 2 * ROWS))


def buckets(classes: DataFrame) -> DataFrame:
    """A row (bucket, node, centre) for each member of each bucket of two or more; centre is the smallest node."""
    banded = classes.select("node", F.explode(F.array(*[_band(i) for i in range(BANDS)])).alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("_last")).where("centre < _last").drop("_last")
    return banded.join(shared, "bucket").select("bucket", "node", "centre")


def _agreement(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs (u, v) with agree, the number of slots that agree."""
    sig = classes.select("node", "sig")
    held = pairs.join(sig.toDF("u", "_su"), "u").join(sig.toDF("v", "_sv"), "v").select("u", "v", "_su", "_sv")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = (np.array(b.column(i).to_pylist(), dtype=object) for i in (2, 3))
            x, y = (np.frombuffer(b"".join(z), np.uint16).reshape(-1, SLOTS) for z in (a, c))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((x == y).sum(axis=1).astype(np.int32))], names=["u", "v", "agree"])

    return held.mapInArrow(over, "u long, v long, agree int")


def _least_agreement(percent: int) -> int:
    t = percent / 100
    return int(SLOTS * (t - 5 * (t * (1 - t) / SLOTS) ** 0.5))


def shingle_table(docs: DataFrame, rows: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """(node, shingles, bytes) of the needed nodes; one document row gives a class its text. rows: _id, _h, node."""
    picked = rows.join(needed, "node", "left_semi").groupBy("node").agg(F.min(F.struct(F.col("_id"), F.col("_h"))).alias("_r"))
    picked = picked.select(F.col("_r._id").alias("_pid"), F.col("_r._h").alias("_ph"), "node")
    held = docs.join(picked, docs["_id"].eqNullSafe(F.col("_pid")) & (docs["_h"] == F.col("_ph"))).select("node", "text")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        for b in remembered.pieces(batches):
            sets = [_pack(shingle_set(words(t), size)) for t in b.column(1).to_pylist()]
            sizes = pa.array(list(map(len, sets)), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary()), sizes], names=["node", "shingles", "bytes"])

    return held.mapInArrow(over, "node long, shingles binary, bytes int")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets reach the threshold: 100 * shared >= percent * all."""
    own = sets.select("node", "shingles")
    held = pairs.select("u", "v").join(own.toDF("u", "_su"), "u").join(own.toDF("v", "_sv"), "v").select("u", "v", "_su", "_sv")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                x, y = _unpack(x), _unpack(y)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), b.column(1).take(pa.array(keep, pa.int64()))], names=["u", "v"])

    return held.mapInArrow(over, "u long, v long")


def _grouped(nodes: DataFrame, groups: DataFrame, name: str = "node", out: str = "comp") -> DataFrame:
    return nodes.join(groups.select(F.col("node").alias("_n"), F.col("component").alias("_c")), F.col(name) == F.col("_n"), "left").select(
        *nodes.columns, F.coalesce("_c", name).alias(out)
    )


def _mixed_buckets(members: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of the buckets that hold several groups, with their group; and of each such bucket its sizes."""
    known = _grouped(members.select("bucket", "node"), groups)
    sizes = known.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("_top"), F.sum("n").alias("_all")).where("_all > _top.n")
    return known, mixed


def _signatures_of(batches: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(batches.column("sig").to_pylist()), np.uint16).reshape(-1, SLOTS)


def _nearest(members: DataFrame, groups: DataFrame, classes: DataFrame, least: int, salt: int) -> DataFrame:
    """(u, v): for each class, the class of another group that its signature agrees with most, among those it meets.

    Members of a bucket meet in blocks of about BLOCK, dealt by salt, so the work grows with the members, not their square.
    """
    known, mixed = _mixed_buckets(members, groups)
    dealt = known.join(mixed.select("bucket", F.ceil(F.col("_all") / BLOCK).cast("int").alias("_blocks")), "bucket")
    dealt = dealt.select("bucket", F.pmod(F.xxhash64("node", F.lit(salt)), "_blocks").alias("block"), "node", "comp")
    held = dealt.join(classes.select("node", "sig"), "node").select("bucket", "block", "node", "comp", "sig")

    def best(t: pa.Table) -> pa.Table:
        node, comp, sig = t.column("node").to_numpy(), t.column("comp").to_numpy(), _signatures_of(t)
        u, v, n = [], [], []
        for i in range(len(node)):
            agree = np.where(comp != comp[i], (sig == sig[i]).sum(axis=1), -1)
            j = int(agree.argmax())
            if agree[j] >= least:
                u.append(node[i])
                v.append(node[j])
                n.append(agree[j])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "agree": pa.array(n, pa.int32())})

    met = held.groupBy("bucket", "block").applyInArrow(best, "u long, v long, agree int")
    one = met.groupBy("u").agg(F.max(F.struct("agree", "v")).alias("_b")).select("u", F.col("_b.v").alias("v"))
    return one.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of a shares with each of b. Elements that only one of all sets has count nowhere."""
    own = [*a, *b]
    sizes = np.array([len(s) for s in own])
    _, index, n = np.unique(np.concatenate([*own, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(own)), sizes)
    column = np.cumsum(n > 1) - 1
    owner, column = owner[n[index] > 1], column[index[n[index] > 1]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(a), len(b)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, (start, start + COLUMNS))
        has = np.zeros((len(own), COLUMNS), np.float32)
        has[owner[lo:hi], column[lo:hi] - start] = 1
        out += has[: len(a)] @ has[len(a) :].T
    return out.astype(np.int64)


def joining_links(linked: np.ndarray, comp_a: np.ndarray, comp_b: np.ndarray) -> list[tuple[int, int]]:
    """Of the links (row, column), those that join groups that the ones before them have not joined."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    out = []
    for i in np.flatnonzero(linked.any(axis=1)):
        columns = np.flatnonzero(linked[i])
        for j in columns[np.unique(comp_b[columns], return_index=True)[1]]:
            x, y = find(int(comp_a[i])), find(int(comp_b[j]))
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((int(i), int(j)))
    return out


def _apart(members: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (u, v) that join the groups of one bucket: each member meets the members outside its largest group.

    A tile is a block of those outside with a block of all members; blocks hold TILE members and TILE_BYTES of their sets at
    most on average, so a tile has a bounded size however many members the bucket has and however long they are.
    """
    known, mixed = _mixed_buckets(members, groups)
    known = known.join(sets.select("node", "bytes"), "node")
    heavy = F.sum("bytes"), F.sum(F.when(F.col("comp") != F.col("_top.comp"), F.col("bytes")))
    heavy = known.join(mixed, "bucket").groupBy("bucket").agg(heavy[0].alias("_all_bytes"), heavy[1].alias("_out_bytes"))
    both = [(F.col("_all") - F.col("_top.n"), "_out_bytes", TILE[0]), (F.col("_all"), "_all_bytes", TILE[1])]
    outside, everyone = (F.greatest(F.ceil(n / most), F.ceil(F.col(size) * sum(TILE) / (TILE_BYTES * most))).cast("int") for n, size, most in both)
    mixed = mixed.join(heavy, "bucket").select("bucket", F.col("_top.comp").alias("_main"), outside.alias("_outs"), everyone.alias("_alls"))
    held = known.join(mixed, "bucket").join(sets.select("node", "shingles"), "node")

    def block(n: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    given = ["node", "comp", "shingles"]
    rows = held.where(F.col("comp") != F.col("_main")).select("bucket", block("_outs").alias("out"), every("_alls").alias("all"), *given, F.lit(1).alias("side"))
    columns = held.select("bucket", every("_outs").alias("out"), block("_alls").alias("all"), *given, F.lit(0).alias("side"))

    def over(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        parts = [t.filter(pa.array(side == k)) for k in (1, 0)]
        (na, ca, sa), (nb, cb, sb) = ((p.column("node").to_numpy(), p.column("comp").to_numpy(), [_unpack(x) for x in p.column("shingles").to_pylist()]) for p in parts)
        shared = shared_counts(sa, sb)
        total = np.array([len(x) for x in sa], np.int64)[:, None] + np.array([len(x) for x in sb], np.int64)[None, :]
        own = joining_links((100 * shared >= percent * (total - shared)) & (ca[:, None] != cb[None, :]), ca, cb)
        u = [max(na[i], nb[j]) for i, j in own]
        v = [min(na[i], nb[j]) for i, j in own]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return rows.union(columns).groupBy("bucket", "out", "all").applyInArrow(over, "u long, v long").distinct()


def grouped_rows(docs: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """docs: _id, _h, text. A row for each: _id, _h, n_shingles, component_id, _stays."""
    rows = scratch.table(signatures(docs, size), "signed")
    classes = scratch.table(
        rows.where("n_shingles > 0").groupBy("key").agg(F.min("_id").alias("_least"), F.first("sig").alias("sig")).withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    least = _least_agreement(percent)
    members = scratch.table(buckets(classes), "buckets")
    star = members.where("node <> centre").select(F.col("node").alias("u"), F.col("centre").alias("v")).distinct()
    star = scratch.table(_agreement(star, classes).where(F.col("agree") >= least), "stars")
    needed = star.select(F.col("u").alias("node")).union(star.select(F.col("v").alias("node"))).union(members.select("node")).distinct()
    of_row = rows.select("_id", "_h", "key").join(classes.select("key", "node"), "key").select("_id", "_h", "node")
    sets = scratch.table(shingle_table(docs, of_row, needed, size), "sets")

    best = star.groupBy("u").agg(F.max(F.struct("agree", F.col("v").alias("v"))).alias("_b")).select("u", F.col("_b.v").alias("v"))
    tested = scratch.table(best, "tested")
    links = scratch.table(confirmed(tested, sets, percent), "links")
    groups = scratch.table(connected_components(links, scratch), "groups")
    for salt in range(ROUNDS):
        fresh = scratch.table(_nearest(members, groups, classes, least, salt).join(tested, ["u", "v"], "left_anti"), "fresh")
        tested = tested.union(fresh)
        found = scratch.table(confirmed(fresh, sets, percent), "found")
        if not found.limit(1).count():
            break
        links = links.union(found)
        groups = scratch.table(connected_components(links, scratch), "groups")
    last = scratch.table(_apart(members, groups, sets, percent), "last")
    if last.limit(1).count():
        groups = scratch.table(connected_components(links.union(last), scratch), "groups")

    named = scratch.table(_grouped(classes.select("key", "node", "_least"), groups), "named")
    first = named.groupBy("comp").agg(F.min(F.struct(F.col("_least").isNull(), "_least", "key")).alias("_f"))
    first = named.join(first, "comp").select("key", F.col("_f._least").alias("_cid"), F.col("_f.key").alias("_ckey"))
    out = rows.select("_id", "_h", "key", "n_shingles").join(first.withColumnRenamed("key", "_k"), (F.col("key") == F.col("_k")) & (F.col("n_shingles") > 0), "left")
    return out.select(
        "_id", "_h", "n_shingles", F.when(F.col("_k").isNull(), F.col("_id")).otherwise(F.col("_cid")).alias("component_id"),
        (F.col("_k").isNull() | (F.col("_id").eqNullSafe(F.col("_cid")) & (F.col("key") == F.col("_ckey")))).alias("_stays"),
    )


def _identified(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(docs["doc_id"].alias("_id"), F.xxhash64(text).alias("_h"), text.alias("text"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """A row for each document row: doc_id, n_shingles, component_id, kept."""
    out = grouped_rows(_identified(docs), size, percent, Scratch(docs.sparkSession, "near"))
    return out.select(
        F.col("_id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )


def survivors(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, without all but one text of each group; rows without words stay."""
    scratch = Scratch(docs.sparkSession, "survivors")
    out = grouped_rows(_identified(docs), size, percent, scratch)
    gone = scratch.table(out.where(~F.col("_stays")).select(F.col("_id").alias("_gid"), F.col("_h").alias("_gh")).distinct(), "gone")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    inner = docs.select(*[docs[c].alias(n) for c, n in zip(docs.columns, names)], docs["doc_id"].alias("_id"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("_h"))
    same = F.col("_id").eqNullSafe(F.col("_gid")) & (F.col("_h") == F.col("_gh"))
    return inner.join(gone, same, "left_anti").select(*names).toDF(*docs.columns)
