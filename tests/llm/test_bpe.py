import hashlib
import random

import pytest

from fathom.llm import bpe


@pytest.fixture(scope="module")
def own():
    return bpe.ByteBPE(bpe.vocabulary_path())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def test_equals_the_library(own, library, documents):
    rng = random.Random(2)
    pool = [32, 32, 32, 10, 33, 0x31, 0x3A, 0x5F, 115, 108, 83, 0x2003, 0xB2, 9, 39, 97, 116, 100, 0xE9, 0x4E00, 0x1F600, 0x300, 0xA0, 0x200B, 0x85, 0x1C]
    texts = ["".join(chr(rng.choice(pool)) for _ in range(150)) for _ in range(600)] + [r["text"] for r in documents.limit(100).collect()]
    texts += ["", "a" * 30000, " " * 5000 + "x", "<|endoftext|>x<|endoftext|>", "'ll don't 'VE", "é" * 4000]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode_text(t) == ",".join(map(str, ids))
        assert own.decode_text(own.encode_text(t)) == library.decode(ids, skip_special_tokens=False) == t


def naive(own, raw):
    """Merges one at a time: the pair of lowest rank, the leftmost of equals."""
    ids = [own.byte_ids[b] for b in raw]
    while True:
        best = min(((own.ranks[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in own.ranks), default=None)
        if best is None:
            return ids
        i = best[1]
        ids[i : i + 2] = [own.ranks[ids[i], ids[i + 1]][1]]


def test_cuts_are_certain(own):
    for text in ("naïve café…日本語", "a1b2_c3--d", "x\ty\n\nz", "we'll don't!'s"):
        raw = text.encode()
        cuts = [0, *own.cuts(raw), len(raw)]
        assert naive(own, raw) == [x for i, j in zip(cuts, cuts[1:]) for x in naive(own, raw[i:j])]
        assert b"".join(own.split(raw)) == raw


def test_fragments_merge_as_one_merge_at_a_time_does(own):
    rng = random.Random(3)
    for _ in range(300):
        raw = "".join(rng.choice("thesaionr é") for _ in range(rng.randrange(1, 90))).encode()
        assert own._merge(raw) == own._merge_many([own.byte_ids[b] for b in raw]) == naive(own, raw)


def test_frame(odd_docs, no_docs, library):
    for r in bpe.tokens(odd_docs).join(odd_docs.select("doc_id", "text").distinct(), "doc_id").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe.token_digests(odd_docs).count() == odd_docs.count() and bpe.token_digests(no_docs).count() == 0
    back = bpe.decode(bpe.tokens(odd_docs)).select("doc_id", "decoded").where("doc_id = 7").first()
    assert back["decoded"].startswith("The quick")
