import random

import numpy as np
import pyarrow as pa
import pytest

from fathom.llm import substring_dedup as sd


def corpus(seed=3):
    rng = random.Random(seed)
    txt = lambda n: ["w%d" % rng.randrange(3000) for _ in range(n)]
    exact, fuzzy = txt(60), txt(120)

    def worn(p):
        p = list(p)
        for i in range(5, len(p), 17):
            p[i] = "zz%d" % rng.randrange(9999)
        del p[30]
        return p

    rows = [(i, " ".join(txt(200))) for i in range(30)]
    rows += [(i, " ".join(txt(rng.randrange(20, 300)) + exact + txt(90))) for i in range(30, 40)]
    rows += [(i, " ".join(txt(50) + worn(fuzzy) + txt(rng.randrange(10, 70)))) for i in range(40, 45)]
    rows += [(45, " ".join(txt(50) + fuzzy + txt(70))), (46, rows[0][1]), (47, rows[0][1].upper()), (48, None), (49, "")]
    return rows, exact


def test_planted_passages(spark):
    rows, exact = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sd.passages(df).collect()
    assert {i for r in got for i in (r["doc_id"], r["other_id"])} == {0, *range(30, 48)}
    text = {i: t.lower().split() for i, t in rows if t}
    for r in got:
        if 30 <= r["doc_id"] < 40 and r["share"] == 1.0 and r["end_word"] - r["start_word"] == 60:
            assert text[r["doc_id"]][r["start_word"] : r["end_word"]] == exact == text[r["other_id"]][r["other_start"] : r["other_end"]]
    found = {r["doc_id"] for r in got if abs((r["end_word"] - r["start_word"]) - 60) <= 1}
    assert set(range(31, 40)) - found == set() or set(range(30, 40)) - found <= {min(set(range(30, 40)) - found)}
    assert {(r["doc_id"], r["other_id"]) for r in got if r["doc_id"] in (46, 47)} == {(46, 0), (47, 0)}


def test_odd_texts(odd_docs, no_docs):
    got = sd.passages(odd_docs).collect()
    assert all(r["share"] == 1.0 for r in got) and not sd.passages(no_docs).count()


def best_chain(pos, apos):
    n, f = len(pos), []
    for i in range(n):
        before = [f[j] - sd.GAP_COST * (pos[i] - pos[j] + apos[i] - apos[j]) for j in range(i) if pos[j] < pos[i] and apos[j] < apos[i]]
        f.append(sd.K + max([0.0, *before]))
    return max(f)


@pytest.mark.parametrize("seed", range(5))
def test_chains_are_optimal(seed):
    rng = random.Random(seed)
    own = sorted({(rng.randrange(300), rng.randrange(300)) for _ in range(60)})
    apos, pos = [a for a, _ in own], [p for _, p in own]
    found = sd.chains(pos, apos)
    assert found[0][0] == pytest.approx(best_chain(pos, apos))
    assert sorted(i for _, c in found for i in c) == list(range(len(own)))
    for _, c in found:
        assert all(pos[a] < pos[b] and apos[a] < apos[b] for a, b in zip(c, c[1:]))


def test_a_shared_run_shares_a_seed():
    rng = np.random.default_rng(1)
    for _ in range(50):
        run = rng.integers(0, 2**63, sd.SPAN + sd.K - 1).astype(np.uint64)
        a, b = (np.concatenate([rng.integers(0, 2**63, n).astype(np.uint64), run, rng.integers(0, 2**63, n).astype(np.uint64)]) for n in (40, 77))
        assert set(sd.seeds(a)[0].tolist()) & set(sd.seeds(b)[0].tolist())


def test_groups_across_batches():
    import pyarrow as pa

    rows = [(g, i) for g in range(7) for i in range(g + 1)]
    for size in (1, 2, 3, 5, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[k : k + size]]), pa.array([r[1] for r in rows[k : k + size]])], names=["g", "i"]) for k in range(0, len(rows), size)]
        assert [(t.column(0)[0].as_py(), t.num_rows) for t in sd._by_group(iter(batches), 1)] == [(g, g + 1) for g in range(7)]


def rows_of(got, doc_id):
    return [r for r in got if r["doc_id"] == doc_id]


def covered(got, doc_id, lo, hi):
    """The share of a text's words lo..hi that rows cover."""
    return len({i for r in rows_of(got, doc_id) for i in range(max(lo, r["start_word"]), min(hi, r["end_word"]))}) / (hi - lo)


def test_a_passage_inserted_in_a_near_copy(spark):
    """The chain to the near copy runs over the inserted passage; the passage's own chain to a third text stays."""
    rng = random.Random(11)
    txt = lambda n: ["v%d" % rng.randrange(10**6) for _ in range(n)]
    rows = []
    for i in range(12):
        head, tail, p = txt(200), txt(200), txt(60)
        rows += [(3 * i, " ".join(head + tail)), (3 * i + 1, " ".join(head + p + tail)), (3 * i + 2, " ".join(txt(80) + p + txt(80)))]
    got = sd.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for i in range(12):
        pair = {3 * i + 1, 3 * i + 2}
        assert any({r["doc_id"], r["other_id"]} == pair and r["end_word"] - r["start_word"] >= 58 and r["share"] == 1.0 for r in got)


def test_exact_ends_of_a_chain_that_fails_as_a_whole(spark):
    """Little alike in the middle, or form-like text behind, does not take exact passages with it; nor does one gap part two short ends."""
    rng = random.Random(12)
    txt = lambda n: ["u%d" % rng.randrange(10**6) for _ in range(n)]
    one, two, middle = txt(50), txt(50), txt(100)
    worn = [w if rng.random() < 0.55 else "q%d" % rng.randrange(10**6) for w in middle]
    form = [txt(12) for _ in range(5)]
    filled = lambda: [w for f in form for w in txt(14) + f]
    head, ends = txt(50), (txt(32), txt(32))
    rows = [(0, one + middle + two), (1, one + worn + two), (2, head + filled()), (3, head + filled()), (4, ends[0] + txt(15) + ends[1]), (5, ends[0] + txt(15) + ends[1])]
    got = sd.passages(spark.createDataFrame([(i, " ".join(txt(60) + t + txt(60))) for i, t in rows], "doc_id long, text string")).collect()
    assert {frozenset((r["doc_id"], r["other_id"])) for r in got} == {frozenset((i, i + 1)) for i in (0, 2, 4)}
    assert all(r["share"] >= sd.LEAST_SHARE for r in got)
    for pair, parts in (((0, 1), ((60, 110), (210, 260))), ((2, 3), ((60, 110),)), ((4, 5), ((60, 139),))):
        for lo, hi in parts:
            assert max(covered(got, i, lo, hi) for i in pair) == 1.0


@pytest.mark.parametrize("seed", range(5))
def test_stretches_hold_every_run_that_can_be_held(seed):
    rng = random.Random(seed)
    runs, p, q = [], 0, 0
    for _ in range(40):
        p, q, n = p + rng.randrange(8), q + rng.randrange(8), rng.randrange(1, 20)
        runs.append((p, q, n))
        p, q = p + n, q + n

    def reaches(i, j):
        own, other = runs[j][0] + runs[j][2] - runs[i][0], runs[j][1] + runs[j][2] - runs[i][1]
        return min(own, other) >= 45 and sum(r[2] for r in runs[i : j + 1]) >= 0.8 * max(own, other)

    every = {k for i in range(40) for j in range(i, 40) if reaches(i, j) for k in range(i, j + 1)}
    got = sd.stretches(runs, 45, 0.8)
    assert all(reaches(i, j) for i, j in got) and {k for i, j in got for k in range(i, j + 1)} == every


def test_a_passage_of_lines_that_are_frequent_elsewhere(spark):
    """Each line's seeds have a third text as anchor; the passage of all lines is found nevertheless, to its full length."""
    rng = random.Random(13)
    txt = lambda n: ["t%d" % rng.randrange(10**6) for _ in range(n)]
    rows, size = [], {}
    for g in range(20):
        lines = [txt(20) for _ in range(3 if g < 18 else 30)]
        own = [txt(60) + [w for line in lines for w in line] + txt(60) for _ in range(2)]
        others = [txt(40) + line + txt(40) for line in lines for _ in range(3)]
        size[1000 * g] = 20 * len(lines)
        rows += [(1000 * g + i, " ".join(t)) for i, t in enumerate(own + others)]
    got = sd.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {frozenset((r["doc_id"], r["other_id"])) for r in got} == {frozenset((i, i + 1)) for i in size}
    assert all(max(covered(got, j, 60, 60 + n) for j in (i, i + 1)) == 1.0 for i, n in size.items())


@pytest.mark.parametrize("seed", range(3))
def test_windows_lose_no_shared_window(seed):
    rng = np.random.default_rng(seed)
    run = rng.integers(0, 2**63, 70).astype(np.uint64)
    a, b = (np.concatenate([rng.integers(0, 2**63, n).astype(np.uint64), run, rng.integers(0, 2**63, n).astype(np.uint64)]) for n in (40, 77))
    both = np.intersect1d(sd.seeds(a)[0], sd.seeds(b)[0])
    at = [set(sd.windows(h, both, 45)[1].tolist()) for h in (a, b)]
    assert set(range(40, 66)) <= at[0] and set(range(77, 103)) <= at[1] and len(at[0]) < 60


def worn_pair(rng, n, every, even):
    """Two texts that share n words of which one in every is changed, and whether a stretch reaches the leasts."""
    fresh = lambda m: rng.integers(0, 2**63, m).astype(np.uint64)
    p = fresh(n)
    worn, at = p.copy(), np.arange(every // 2, n, every) if even else rng.choice(n, n // every, replace=False)
    worn[at] = fresh(len(at))
    runs = sd._joined([(i, i, 1) for i in range(n) if p[i] == worn[i]])
    return np.concatenate([fresh(70), p, fresh(70)]), np.concatenate([fresh(90), worn, fresh(90)]), bool(sd.stretches(runs, sd.LEAST_WORDS, sd.LEAST_SHARE))


def is_found(a, b):
    own, i, j = np.intersect1d(*(sd.seeds(h)[0] for h in (a, b)), return_indices=True)
    links = sorted(zip(sd.seeds(b)[1][j].tolist(), sd.seeds(a)[1][i].tolist()))
    apos, pos = [x for x, _ in links], [y for _, y in links]
    return any(sd.align(a, b, [x for i in c for x in (pos[i], apos[i])], 0, 0) for _, c in sd.chains(pos, apos))


@pytest.mark.parametrize("n, every, even, least", [(55, 12, True, 1.0), (55, 8, True, 1.0), (55, 7, True, 1.0), (120, 8, True, 1.0), (120, 5, True, 0.98), (60, 7, False, 0.98), (60, 5, False, 0.9), (120, 5, False, 0.98)])
def test_recall_of_worn_passages(n, every, even, least):
    """Against brute force on the planted words: those that hold a stretch of 45 words and 0.8 alike."""
    rng = np.random.default_rng(n + every)
    pairs = [(a, b) for a, b, holds in (worn_pair(rng, n, every, even) for _ in range(100)) if holds]
    share = np.mean([is_found(a, b) for a, b in pairs])
    print(f"recall {n} words, 1 in {every}, {'even' if even else 'random'}: {share:.3f} of {len(pairs)}")
    assert len(pairs) > 50 and share >= least


@pytest.mark.parametrize("hot_rows", [None, 4])
def test_links_of_frequent_and_rare_keys(spark, hot_rows):
    """Every row of a key that several nodes have is linked to the smallest (node, pos), whichever way its key goes."""
    rng = np.random.default_rng(11)
    rows = [(int(k), int(n), int(p)) for k, n, p in zip(rng.zipf(1.6, 600) % 60, rng.integers(-9, 9, 600), rng.integers(0, 50, 600))]
    rows = list(dict.fromkeys(rows)) + [(99, 5, 1), (99, 5, 7)]
    df = spark.createDataFrame(rows, "seed long, node long, pos int")
    want = set()
    for key in {k for k, _, _ in rows}:
        own = sorted((n, p) for k, n, p in rows if k == key)
        if own[0][0] < own[-1][0]:
            want |= {(key, n, *own[0], p) for n, p in own if n != own[0][0] or (n, p) == own[0]}
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, 7)
    try:
        got = [tuple(r) for r in (sd.linked(df) if hot_rows is None else sd.linked(df, df, hot_rows)).collect()]
    finally:
        spark.conf.set(conf, before)
    assert len(got) == len(set(got)) and set(got) == want


def test_worn_passages_in_a_corpus_that_holds_their_phrases(spark):
    """Every seed of a worn passage has third texts; against brute force on the planted words."""
    rng = random.Random(21)
    txt = lambda n: ["c%d" % rng.randrange(10**6) for _ in range(n)]
    rows, pairs = [], []
    for g in range(20):
        p = txt(60)
        worn = [w if i % 9 != 4 else txt(1)[0] for i, w in enumerate(p)]
        runs = sd._joined([(i, i, 1) for i in range(60) if p[i] == worn[i]])
        assert sd.stretches(runs, sd.LEAST_WORDS, sd.LEAST_SHARE)
        pairs.append(frozenset((len(rows), len(rows) + 1)))
        rows += [(len(rows), txt(70) + p + txt(70)), (len(rows) + 1, txt(90) + worn + txt(50))]
        for at in range(0, 53, 3):
            for own in (p, worn) * 6:
                rows.append((len(rows), txt(30) + own[at : at + 8] + txt(30)))
    got = sd.passages(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string").repartition(4)).collect()
    found = {frozenset((r["doc_id"], r["other_id"])) for r in got}
    share = len(found & set(pairs)) / len(pairs)
    print(f"recall in a corpus: {share:.2f}")
    assert share >= 0.9 and found <= set(pairs)


def test_worn_passages_all_of_whose_pairs_other_texts_hold(spark):
    """third texts hold every two phrases of a passage as far apart as it does, so no seed or pair has a text with the passage as anchor."""
    rng = random.Random(31)
    txt = lambda n: ["d%d" % rng.randrange(10**6) for _ in range(n)]
    late = lambda p: next(t for t in (txt(70) + p + txt(60) for _ in range(10**4)) if sd.node_of([w.encode() for w in t]) > 0.98 * 2**63)
    rows, pairs = [], set()
    for g in range(3):
        p = txt(60)
        worn = [w if i % 9 != 4 else txt(1)[0] for i, w in enumerate(p)]
        pairs.add(frozenset((len(rows), len(rows) + 1)))
        rows += [(len(rows), late(p)), (len(rows) + 1, late(worn))]
        for a in range(0, 53, 4):
            for b in range(a + 12, min(a + 45, 53), 4):
                for own in (p, worn) * 2:
                    rows.append((len(rows), txt(20) + own[a : a + 8] + txt(b - a - 8) + own[b : b + 8] + txt(20)))
    got = sd.passages(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string").repartition(4)).collect()
    assert {frozenset((r["doc_id"], r["other_id"])) for r in got} == pairs


def test_likeness_beyond_the_range_that_was_cut_out(spark):
    """640 words that share no seed (every 4th differs) follow 60 equal ones, or come before them: the passage is followed to its end."""
    rng = random.Random(22)
    txt = lambda n: ["s%d" % rng.randrange(10**6) for _ in range(n)]
    p = txt(700)
    worn = [w if i < 60 or i % 4 else txt(1)[0] for i, w in enumerate(p)]
    least = 0.7
    for own in ((p, worn), (p[::-1], worn[::-1])):
        rows = [(i, " ".join(txt(50) + t + txt(50))) for i, t in enumerate(own)]
        got = sd.passages(spark.createDataFrame(rows, "doc_id long, text string"), least_share=least).collect()
        assert max(covered(got, i, 50, 750) for i in (0, 1)) > 0.98


def test_pairs_are_chosen_alike():
    """Nodes that share two seeds at a like distance share a key of them, unless one anchor has both."""
    rng = np.random.default_rng(5)
    seed = rng.integers(-(2**62), 2**62, 40)
    pos, anode, apos = np.arange(40) * 3, np.arange(40) % 2, np.arange(40) * 3
    keys, places = sd.seed_pairs(seed, pos, anode, apos)
    at = {(int(x) // 64, int(x) % 64) for x in places}
    assert all(sd.NEAR <= d <= sd.FAR and (p // 3 + d // 3 - p // 3) % 2 == 1 for p, d in at)
    other = sd.seed_pairs(seed[10:30], pos[10:30] + 500, anode[10:30], apos[10:30])[0]
    assert len(set(keys.tolist()) & set(other.tolist())) >= len(other) // 2
    assert not len(sd.seed_pairs(seed, pos, np.zeros(40, int), apos)[0])
    assert not len(sd.seed_pairs(seed[:0], pos[:0], anode[:0], apos[:0])[0])


@pytest.mark.parametrize("step", [8, 256])
def test_ranges_do_not_change_the_passages(spark, monkeypatch, step):
    """short first ranges find what long ones do, at ends of texts too, and ask for fewer words."""
    g = np.random.default_rng(3)
    word = [f"w{i}" for i in range(5000)]
    shared = [g.choice(word, n).tolist() for n in (50, 90, 300)]
    texts = []
    for i in range(24):
        own = [w if g.random() > 0.1 else "x" for w in shared[i % 3]]
        texts.append(" ".join([*g.choice(word, i * 3).tolist(), *own, *g.choice(word, i % 5 * 2).tolist()]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {}
    for s in (step, 64):
        monkeypatch.setattr(sd, "STEP", s)
        rows[s] = sorted(map(tuple, sd.passages(docs).collect()))
    assert rows[step] == rows[64] and len(rows[64]) >= 20


def test_a_range_that_ends_is_asked_for_again_while_either_text_goes_on():
    assert sd.wider(40, 48, 0, 48, 0, 48, (False, False), (True, True)) == (0, 144, 0, 144)
    assert sd.wider(40, 40, 0, 48, 0, 48, (False, False), (True, True)) is None


def test_windows_of_many_texts_are_those_of_each(spark):
    """The places of windows are hashed for many texts at once; no window reaches into the next text."""
    g = np.random.default_rng(4)
    held = [sd.hashes([b"w%d" % i for i in g.integers(0, 400, n)]).astype(np.uint32) for n in (60, 45, 44, 0, 200, 3)]
    texts = spark.createDataFrame([(i, h.tobytes()) for i, h in enumerate(held)], "node long, words binary").coalesce(1)
    shared = sd.seed_table(texts.where("octet_length(words) > 12")).select("node", "seed")
    got = sorted(map(tuple, sd.window_table(texts, shared, 45).collect()))
    want = []
    for i, h in enumerate(held):
        h = h.astype(np.uint64)
        want += [(x, i, at) for at, x in enumerate(sd.grams(h, 45).view(np.int64).tolist() if len(h) >= 45 else [])]
    assert got == sorted(want) and len(want) == 16 + 1 + 156


def test_the_first_ranges_are_short(spark, monkeypatch):
    """What is cut out for a phrase that ends at once: a few words on each side (64 by steps of 16 before)."""
    asked = []
    real = sd._slices
    monkeypatch.setattr(sd, "_slices", lambda texts, ranges: asked.append(ranges.selectExpr("max(hi - lo)").first()[0]) or real(texts, ranges))
    g = np.random.default_rng(5)
    texts = [" ".join([*[f"a{x}" for x in g.integers(0, 10**6, 50)], "one", "two", "three", "four", "five", "six", *[f"b{x}" for x in g.integers(0, 10**6, 50)]]) for _ in range(6)]
    assert sd.passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count() == 0
    assert len(asked) == 1 and asked[0] <= 6 + 16


def test_rows_told_to_give_nothing_are_those_that_alignment_gives_nothing_for():
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(4000):
        n, m = (int(x) for x in rng.integers(4, 40, 2))
        few = int(rng.choice([2, 5, 40]))
        a, b = (rng.integers(0, few, x).astype(np.uint32) for x in (n, m))
        p, q = int(rng.integers(0, n - 3)), int(rng.integers(0, m - 3))
        b[q : q + 4] = a[p : p + 4]
        step = int(rng.choice([4, sd.STEP, 12]))
        lo, hi, alo, ahi = max(0, p - step), p + 4 + step, max(0, q - step), q + 4 + step
        links = [p, q] if rng.random() < 0.9 else [p, q, p, q]
        rows.append((lo, hi, alo, ahi, links, a[lo:hi].tobytes(), b[alo:ahi].tobytes()))
    kinds = [pa.int32()] * 4 + [pa.list_(pa.int32()), pa.binary(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["lo", "hi", "alo", "ahi", "links", "_a", "_b"])
    for least in (8, 45):
        told = np.concatenate([sd.nothing_more(batch.slice(i, 1000), least, 0.8) for i in range(0, 4000, 1000)])
        assert least == 8 or told.sum() > 300
        for (lo, hi, alo, ahi, links, a, b), none in zip(rows, told):
            a, b = sd.unpacked(a), sd.unpacked(b)
            found, began, ended = sd.aligned(a, b, links, lo, alo, least, 0.8)
            if none:
                assert not found and sd.wider(len(a), len(b), lo, hi, alo, ahi, began, ended) is None
    assert not sd.nothing_more(batch.slice(0, 0), 45, 0.8).size


def test_seeds_and_pairs_of_many_texts_are_those_of_each():
    g = np.random.default_rng(6)
    held = [g.integers(0, few, n).astype(np.uint64) for n, few in ((60, 9), (3, 9), (0, 9), (4, 9), (5, 9), (6, 9), (7, 9), (300, 20), (900, 10**6), (2, 9))]
    own, text, at = sd.seeds_of(np.concatenate(held), np.array([len(h) for h in held]))
    pairs = []
    for i, h in enumerate(held):
        s, p = sd.seeds(h)
        assert sorted(zip(own[text == i].tolist(), at[text == i].tolist())) == sorted(zip(s.tolist(), p.tolist()))
        k = sd.grams(h, sd.K) if len(h) >= sd.K else h[:0]
        want = {int(k[j : j + sd.SPAN].argmin()) + j for j in range(max(min(len(k), 1), len(k) - sd.SPAN + 1))}
        assert dict(zip(s.tolist(), p.tolist())) == {int(x): min(y for y in want if k[y] == k[z]) for z in want for x in [k[z].view(np.int64)]}
    order = np.lexsort((at, text))
    own, text, at = own[order], text[order], at[order].astype(np.int64)
    anode, apos = g.integers(0, 3, len(own)), g.integers(0, 500, len(own))
    first, keys, places = sd.pairs_of(text, own, at, anode, apos)
    for i in range(len(held)):
        pairs = sd.seed_pairs(own[text == i], at[text == i], anode[text == i], apos[text == i])
        assert [x.tolist() for x in pairs] == [x[text[first] == i].tolist() for x in (keys, places)]
    assert len(set(text[first].tolist())) >= 3


def test_a_range_that_goes_on_is_not_aligned_before_all_is_cut_out(spark):
    """Whether a range goes on is told from its ends alone: what lies between was aligned in each round, for nothing."""
    g = np.random.default_rng(7)
    word = ["k%d" % i for i in g.permutation(4000)]
    p = word[:600]
    worn = [w if i % 12 else "x%d" % i for i, w in enumerate(p)]
    rows = [(0, word[600:700] + p + word[700:800]), (1, word[800:900] + worn + word[900:1000])]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    got = sd.passages(docs).collect()
    assert max(covered(got, i, 100, 700) for i in (0, 1)) > 0.98

    a, b = (sd.hashes([w.encode() for w in t]).astype(np.uint32) for _, t in rows)
    links = [150, 150, 160, 160]
    ends = sd.beyond_ends(a[142:172], b[142:172], links, 142, 142)
    assert ends[1] == (True, True) and ends[3] == (True, True)
    assert sd.wider(30, 30, 142, 172, 142, 172, ends[1], ends[3]) == (82, 232, 82, 232)


def test_links_that_rise_together_need_no_tree(monkeypatch):
    """Each link's best predecessor is then the one before it: the same chains as by prefix maxima."""
    rng = random.Random(8)
    cases = []
    for _ in range(200):
        n = rng.randrange(1, 60)
        cases.append(tuple(sorted(rng.sample(range(rng.choice([70, 400, 5000])), n)) for _ in range(2)))
    want = []
    for pos, apos in cases:
        score, back = [0.0] * len(pos), [-1] * len(pos)
        sd._predecessors(pos, apos, score, back)
        want.append((max(score), sum(x < 0 for x in back)))
    monkeypatch.setattr(sd, "Fenwick", None)
    for (pos, apos), (best, parts) in zip(cases, want):
        found = sd.chains(pos, apos)
        assert found[0][0] == best and len(found) >= parts and sorted(i for _, c in found for i in c) == list(range(len(pos)))


def test_chains_of_a_pair_of_nodes_are_those_of_its_links(spark):
    """Pairs of one and two links are chained for a batch at once."""
    rng = random.Random(9)
    rows = [(i, -1, rng.randrange(90), rng.randrange(90)) for i in range(400) for _ in range(rng.choice([1, 2, 2, 2, 3, 5]))]
    rows += [(500, -1, q, p) for q, p in ((0, 0), (40, 40))] + [(501, -1, q, p) for q, p in ((0, 0), (40, 39))] + [(502, -1, 5, 5)] * 2
    coded = [(n, a, q * 64, p * 64) for n, a, q, p in rows] + [(503, -1, 7 * 64 + 20, 9 * 64 + 18)]  # the last is a pair of seeds
    rows += [(503, -1, 7, 9), (503, -1, 27, 27)]
    df = spark.createDataFrame(coded, "node long, anode long, apos long, pos long")
    want = []
    for node in {r[0] for r in rows}:
        own = sorted({(q, p) for n, _, q, p in rows if n == node})
        want += [(node, score, [x for k in c for x in (own[k][1], own[k][0])]) for score, c in sd.chains([p for _, p in own], [q for q, _ in own])]
    got = [(r["node"], r["score"], list(r["links"])) for r in sd.chain_table(df).collect()]
    assert sorted(got) == sorted(want)
    for r in sd.chain_table(df).collect():
        assert (r["s"], r["a_s"], r["e"], r["a_e"]) == (r["links"][0], r["links"][1], r["links"][-2] + sd.K, r["links"][-1] + sd.K)


@pytest.mark.parametrize("seed", range(4))
def test_common_subsequences_are_longest(seed):
    rng = random.Random(seed)
    for _ in range(150):
        few = rng.choice([2, 4, 30])
        a, b = ([rng.randrange(few) for _ in range(rng.randrange(0, 70))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        runs = sd._common(a, b)
        assert sum(n for _, _, n in runs) == best[-1][-1] and all(a[i : i + n] == b[j : j + n] for i, j, n in runs)
        assert all(i + n <= x and j + n <= y for (i, j, n), (x, y, _) in zip(runs, runs[1:]))


def test_too_little_is_told_only_where_nothing_is_found():
    rng = np.random.default_rng(10)
    told = 0
    for _ in range(1500):
        n = int(rng.integers(20, 90))
        a = rng.integers(0, 10**6, n).astype(np.uint32)
        b = np.where(rng.random(n) < rng.choice([0.1, 0.4, 0.6]), rng.integers(0, 10**6, n), a).astype(np.uint32)
        at = [i for i in range(n - 3) if (a[i : i + 4] == b[i : i + 4]).all()]
        if not at:
            continue
        links = [x for i in (at[0], at[-1]) for x in (i, i)][: 2 + 2 * (at[0] < at[-1])]
        ends = sd.beyond_ends(a, b, links, 0, 0)
        little = sd.too_little(a, b, links, 0, 0, sum(m for _, _, m in ends[0] + ends[2]), 36.0)
        told += little
        if little:  # no run of words in order can hold so many
            best = sum(m for _, _, m in sd._common(a.tolist()[at[0] : at[-1] + 4], b.tolist()[at[0] : at[-1] + 4]))
            assert best + sum(m for _, _, m in ends[0] + ends[2]) < 36
    assert told > 200


def test_equal_passages_are_one_row(spark):
    """Rows that are equal in all columns are one, whether they are over holes or not."""
    rows = [(1, 2, 0, 50, 3, 53, 50, 1)] * 3 + [(1, 2, 0, 50, 3, 53, 50, 0)] * 2 + [(1, 3, 5, 40, 0, 35, 35, 1)] * 2 + [(4, 2, 0, 50, 3, 53, 50, 0)]
    got = sorted(map(tuple, sd.outermost(spark.createDataFrame(rows, sd.PASSAGE)).collect()))
    assert got == [(1, 2, 0, 50, 3, 53, 50, 0), (4, 2, 0, 50, 3, 53, 50, 0)]
