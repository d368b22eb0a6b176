"""Byte-level BPE by forced-boundary splitting, and decoding.

A pair of bytes that stands side by side inside no vocabulary token can never be joined by merges, so between such bytes
every encoding has a cut. The text's bytes are cut in two steps. First at those certain cuts that also end a piece of the
tokenizer's own pattern whatever stands around them, such as a letter before a space. Each fragment is then encoded alone:
cut by the pattern, then at every other certain cut, and what is left is merged, lowest rank first, leftmost on ties, in time
n log n even for a fragment without any cut. Merges never look across a cut, so the ids put together are those of the whole
text, and a fragment's ids can be remembered for the next time that it is met. What a task remembers is bounded (two times ``CACHE_ENTRIES`` fragments of at most ``CACHE_BYTES`` bytes).

Defined cases: null and empty texts give no ids and decode to the empty text; the string of a special token in a text gives
its id, as the tokenizer's own default does; repeated rows are encoded one by one; an empty table gives an empty result;
other columns are carried by ``encode_frame``, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import remembered

CACHE_ENTRIES = 220_000
CACHE_BYTES = 64
FEW_BYTES = 40

_NO_PAIR = (1 << 62, 0)

#: The pattern by which byte-level BPE splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file: itself, or the next unused from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _classes() -> np.ndarray:
    """Of each byte, as flags: 1 an ASCII letter, 2 a digit, 4 other printable ASCII, 8 the space, 16 what may follow the
    first byte C3 in a letter, 32 the apostrophe."""
    out = np.zeros(256, np.uint8)
    codes = np.arange(256)
    out[0x21:0x7F] = 4
    out[np.isin(codes | 0x20, np.arange(ord("a"), ord("z") + 1)) & (codes < 128)] = 1
    out[ord("0") : ord("9") + 1] = 2
    out[ord("'")] = 32
    out[0x20] = 8
    out[0x80:0xC0] = 16
    out[[0x97, 0xB7]] = 0
    return out


_CLASS = _classes()


def piece_ends(own: np.ndarray) -> np.ndarray:
    """True at i if PATTERN ends a piece between bytes i and i + 1 whatever stands around them.

    So it does between a letter, a digit and other signs, but for an apostrophe before a letter, and before a space that
    follows none. No look-ahead and no longer piece reaches over such a place.
    """
    c = _CLASS[own]
    c[1:][(c[1:] == 16) & (own[:-1] == 0xC3)] = 1
    c[c == 16] = 0
    left, right = c[:-1], c[1:]
    known = np.uint8(1 | 2 | 4 | 32)
    out = ((left & known) != 0) & ((right & np.uint8(1 | 2 | 4 | 8 | 32)) != 0) & (left != right)
    signs = np.uint8(4 | 32)
    return out & ~(((left & signs) != 0) & ((right & signs) != 0)) & ~((left == 32) & (right == 1))


class _Fragments(dict):
    """Fragment -> its ids as text, each after a comma. Two generations, each bounded: what is met again outlives what is not."""

    def __init__(self, bpe: "ByteBPE"):
        super().__init__()
        self.bpe = bpe
        self.old: dict[bytes, str] = {}

    def __missing__(self, raw: bytes) -> str:
        out = self.old.get(raw)
        if out is None:
            out = "".join([f",{i}" for i in self.bpe.encode_fragment(raw)])
        if len(raw) <= CACHE_BYTES:
            if len(self) >= CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[raw] = out
        return out


class ByteBPE:
    """A byte-level BPE vocabulary, read from a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_alphabet()

        def raw(token: str) -> bytes:
            return bytes(of[c] for c in token)

        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        self.ids = {raw(k): v for k, v in vocab.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.ranks = {(self.ids[raw(a)], self.ids[raw(b)]): (r, self.ids[raw(a) + raw(b)]) for r, (a, b) in enumerate(merges)}
        self.bytes_of = {str(v): k for k, v in self.ids.items()} | {str(v): k.encode() for k, v in self.special.items()}
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        inside = np.zeros((256, 256), bool)
        for token in self.ids:
            own = np.frombuffer(token, np.uint8)
            inside[own[:-1], own[1:]] = True
        self.joinable = inside
        self.pattern = regex.compile(PATTERN)
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.never = ~inside.reshape(-1)
        self._joined = inside.tobytes()
        self.fragments = _Fragments(self)

    def cuts(self, raw: bytes) -> list[int]:
        """Positions of the certain cuts in these bytes."""
        joined = self._joined
        return [i for i, (a, b) in enumerate(zip(raw, raw[1:]), 1) if not joined[a << 8 | b]]

    def split(self, raw: bytes) -> list[bytes]:
        """A text's bytes at those certain cuts at which the pattern ends a piece too."""
        own = np.frombuffer(raw, np.uint8)
        wide = own.astype(np.uint16)
        at = (np.flatnonzero(self.never[wide[:-1] << 8 | wide[1:]] & piece_ends(own)) + 1).tolist()
        return [raw[i:j] for i, j in zip([0, *at], [*at, len(raw)])]

    def encode_fragment(self, raw: bytes) -> list[int]:
        out: list[int] = []
        for piece in self.pattern.findall(raw.decode("utf-8", "surrogatepass")):
            own = piece.encode("utf-8", "surrogatepass")
            at = 0
            for cut in [*self.cuts(own), len(own)]:
                out += self._merge(own[at:cut])
                at = cut
        return out

    def _merge(self, raw: bytes) -> list[int]:
        """The ids of one fragment: the pair of lowest rank merges, the leftmost of equals, found by looking at all pairs of a
        few bytes and from a heap over a linked list for more, so that time is n log n."""
        ids = [self.byte_ids[b] for b in raw]
        if len(raw) > FEW_BYTES:
            return self._merge_many(ids)
        known, none = self.ranks.get, _NO_PAIR
        pairs = [known(p, none) for p in zip(ids, ids[1:])]
        while pairs and (best := min(pairs)) is not none:
            i = pairs.index(best)
            ids[i : i + 2] = [best[1]]
            del pairs[i]
            if i:
                pairs[i - 1] = known((ids[i - 1], best[1]), none)
            if i < len(pairs):
                pairs[i] = known((best[1], ids[i + 1]), none)
        return ids

    def _merge_many(self, ids: list[int]) -> list[int]:
        n = len(ids)
        ranks = self.ranks
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [r[0] << 32 | i for i, p in enumerate(zip(ids, ids[1:])) if (r := ranks.get(p))]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i = top & 0xFFFFFFFF
            j = after[i]
            if j >= n or not (r := ranks.get((ids[i], ids[j]))) or r[0] != top >> 32:
                continue  # one side has been merged with another since
            new = ids[i] = r[1]
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if r := ranks.get((new, ids[k])):
                    heapq.heappush(heap, r[0] << 32 | i)
            if (h := before[i]) >= 0 and (r := ranks.get((ids[h], new))):
                heapq.heappush(heap, r[0] << 32 | h)
        return [x for x in ids if x >= 0]

    def encode_text(self, text: str | None) -> str:
        """Decimal ids joined by commas."""
        if not text:
            return ""
        if self.special_pattern and any(s in text for s in self.special):
            parts = self.special_pattern.split(text)
            return "".join([f",{self.special[p]}" if p in self.special else self._plain(p) for p in parts if p])[1:]
        return self._plain(text)[1:]

    def _plain(self, text: str) -> str:
        return "".join(map(self.fragments.__getitem__, self.split(text.encode("utf-8", "surrogatepass"))))

    def decode_text(self, ids: str) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


_LOADED: dict[str, ByteBPE] = {}


def _bpe(path: str) -> ByteBPE:
    remembered.only(_LOADED)
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def vocabulary_path(path: str | None = None) -> str:
    """path, or the public 50k vocabulary. The file is on every machine; it is read there, not sent."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_frame(docs: DataFrame, path: str | None = None, text_col: str = "text", ids: bool = True) -> DataFrame:
    """docs with _n_tokens, _ids_sha256, _decoded_sha256 and, if asked for, _ids (array of int)."""
    file = vocabulary_path(path)
    plan = docs.withColumns({"_n_tokens": F.lit(0).cast("long"), "_ids_sha256": F.lit(""), "_decoded_sha256": F.lit("")})
    if ids:
        plan = plan.withColumn("_ids", F.array().cast("array<int>"))
    schema = plan.schema
    names = schema.names

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(file)
        for batch in remembered.pieces(batches):
            counts, shas, backs, arrays = [], [], [], []
            for text in batch.column(names.index(text_col)).to_pylist():
                own = bpe.encode_text(text)
                counts.append(own.count(",") + 1 if own else 0)
                shas.append(hashlib.sha256(own.encode()).hexdigest())
                backs.append(hashlib.sha256(bpe.decode_text(own).encode("utf-8", "surrogatepass")).hexdigest())
                if ids:
                    arrays.append(np.fromstring(own, np.int32, sep=",") if own else np.zeros(0, np.int32))
            new = {"_n_tokens": pa.array(counts, pa.int64()), "_ids_sha256": pa.array(shas, pa.string()), "_decoded_sha256": pa.array(backs, pa.string())}
            if ids:
                offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
                new["_ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.zeros(0, np.int32)])))
            cols = [new[c].cast(batch.schema.field(i).type) if c in new else batch.column(i) for i, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return plan.mapInArrow(over, schema)


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """A row for each document row: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    out = encode_frame(docs.select("doc_id", "text"), path, ids=False)
    return out.select("doc_id", *[F.col(f"_{c}").alias(c) for c in ("n_tokens", "ids_sha256", "decoded_sha256")])


def tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """A row for each document row: doc_id, ids, n_tokens, ids_sha256, decoded_sha256."""
    out = encode_frame(docs.select("doc_id", "text"), path)
    return out.select("doc_id", *[F.col(f"_{c}").alias(c) for c in ("ids", "n_tokens", "ids_sha256", "decoded_sha256")])


def decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """encoded with a column decoded: the text of each row's ids; null ids give the empty text."""
    file = vocabulary_path(path)
    schema = encoded.withColumn("decoded", F.lit("")).schema

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(file)
        for batch in batches:
            own = batch.column(batch.schema.names.index(ids_col)).to_pylist()
            texts = pa.array([bpe.decode_text(",".join(map(str, x or []))) for x in own], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=schema.names)

    return encoded.mapInArrow(over, schema)
