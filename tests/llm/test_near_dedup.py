import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from fathom.llm import near_dedup

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    inverted = defaultdict(list)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in inverted[x]).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for x in s:
            inverted[x].append(i)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids and sets[i] else d))
    return out


def chain_corpus(seed):
    """Families in which neighbours are close and ends are not, and one large family around a centre."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(5000)
    rows = []
    for _ in range(6):
        text = [word() for _ in range(120)]
        for _ in range(8):
            rows.append(" ".join(text))
            text = list(text)
            for k in rng.sample(range(120), rng.randrange(1, 6)):
                text[k] = word()
    centre = [word() for _ in range(200)]
    for _ in range(60):
        text = list(centre)
        for k in rng.sample(range(200), rng.randrange(0, 12)):
            text[k] = word()
        rows.append(" ".join(text))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,size", [(1, 4), (2, 5)])
def test_equals_brute_force(spark, monkeypatch, seed, size):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    rows = chain_corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, size, 80).collect())
    assert got == sorted(brute(rows, size, 80))


def test_tiles_alone_find_every_link(spark, monkeypatch):
    for name, value in (("ROUNDS", 0), ("TILE", (3, 5)), ("COLUMNS", 16)):
        monkeypatch.setattr(near_dedup, name, value)
    rows = chain_corpus(3)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute(rows, 4, 80))


def test_shared_counts_and_joining_links(monkeypatch):
    monkeypatch.setattr(near_dedup, "COLUMNS", 8)
    rng = np.random.default_rng(1)
    a, b = ([np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64) for _ in range(n)] for n in (7, 11))
    assert near_dedup.shared_counts(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert near_dedup.shared_counts(a[:1], []).shape == (1, 0)
    linked = np.ones((2, 3), bool)
    assert len(near_dedup.joining_links(linked, np.array([1, 2]), np.array([3, 4, 4]))) == 3


def test_documents_and_odd_texts(documents, odd_docs, no_docs):
    for docs in (documents, odd_docs):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        got = near_dedup.near_duplicates(docs, 4, 80).collect()
        key = lambda r: tuple(-1 if x is None else x for x in r)
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(brute(rows, 4, 80), key=key)
        assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in got)
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_survivors_keep_columns_and_one_of_each_group(odd_docs, no_docs):
    left = near_dedup.survivors(odd_docs)
    assert left.columns == odd_docs.columns
    rows = left.collect()
    assert {r["doc_id"] for r in rows if r["text"] and r["text"].lower().startswith("the quick")} == {7}
    assert sum(1 for r in rows if not (r["text"] or "").strip()) == sum(1 for r in odd_docs.collect() if not (r["text"] or "").strip())
    assert near_dedup.survivors(no_docs).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 2000).astype(np.uint64)
    gaps = []
    for share in (0.5, 0.8, 0.95):
        k = int(len(a) * 2 * share / (1 + share))
        b = np.concatenate([a[:k], rng.integers(0, 2**63, len(a) - k).astype(np.uint64)])
        h = near_dedup.superminhash([np.sort(a), np.sort(b)])
        gaps.append(abs((h[0] == h[1]).mean() - share))
    assert max(gaps) < 0.15
    small = near_dedup.superminhash([a[:1], a[:1], a[:3]])
    assert (small[0] == small[1]).all() and (small < 0xFFFFFFFF).all()
