import hashlib
import re

from pyspark.sql import functions as F

from fathom.llm import decontaminate

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def brute(text, items, window):
    w, hit, names = words(text), set(), set()
    for name, t in items:
        own = words(t)
        k = min(window, len(own))
        wins = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if k else set()
        for i in range(len(w) - k + 1) if k else ():
            if tuple(w[i : i + k]) in wins:
                hit.update(range(i, i + k))
                names.add("" if name is None else str(name))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


ITEMS = [(1, "The quick-brown fox jumps over the lazy dog and runs"), (1, "fox jumps"), (10, "ñandú"), (2, None), (3, "..."), (None, "x x x x x x x x x x x x"), (9, "one TWO"), (11, "two three")]


def test_equals_brute_force(spark, odd_docs, no_docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for limit in (1 << 20, 100):  # one block, and blocks of at most ten words
        found = decontaminate.hits(odd_docs.select("doc_id", "text", F.col("text").alias("_text")), bench, 10, limit).collect()
        assert len(found) == odd_docs.count()
        for r in found:
            n, hit, items, _, _ = brute(r["text"], ITEMS, 10)
            assert (r["_n"], sum(b - a for a, b in r["_ranges"]), len(r["_items"])) == (n, hit, items), r["text"]
            assert all(a[1] < b[0] for a, b in zip(r["_ranges"], r["_ranges"][1:]))
    key = lambda r: tuple(map(str, r))
    got = [tuple(r)[:6] for r in decontaminate.decontaminate(odd_docs, bench).collect()]
    assert sorted(got, key=key) == sorted([(r["doc_id"], *brute(r["text"], ITEMS, 10)) for r in odd_docs.collect()], key=key)
    assert decontaminate.decontaminate(no_docs, bench).count() == 0
    assert not decontaminate.decontaminate(odd_docs, bench.limit(0)).where("contaminated").count()


def test_spans_and_clean(spark, odd_docs):
    bench = spark.createDataFrame([(1, "brown fox jumps")], "item_id long, text string")
    found = decontaminate.leaked_spans(odd_docs, bench).collect()
    assert len(found) == sum("brown fox jumps" in (r["text"] or "") for r in odd_docs.collect())
    for r in found:
        assert [r["text"][a:b] for a, b in r["spans"]] == ["brown fox jumps"]
    left = decontaminate.clean(odd_docs, bench)
    assert left.columns == odd_docs.columns and left.count() == sum("brown fox jumps" not in (r["text"] or "") for r in odd_docs.collect())


def test_windows_take_bounded_memory():
    """8 MB of items: blocks of at most MOST_NODES words in windows, each automaton well under 500 MB."""
    import random

    rng = random.Random(4)
    pool = [bytes(rng.choices(b"abcdefghij", k=rng.randrange(2, 9))) for _ in range(60_000)]
    own = [pool[min(len(pool) - 1, int(rng.paretovariate(0.7)))] for _ in range(decontaminate.MOST_NODES // decontaminate.WINDOW)]
    stats = decontaminate.Windows([("a", own)]).automaton.get_stats()
    assert stats["nodes_count"] <= decontaminate.MOST_NODES and stats["total_size"] < 250 << 20


def test_a_template_that_many_items_share(spark):
    """Windows of a template have very many items; windows with the tail of an item have one."""
    template = "answer the following question by choosing the best option of these below now please"
    items = [(i, f"{template} q{i} r{i} s{i}") for i in range(300)] + [(7, template), (7, f"{template} q7 r7 s7")]
    texts = [(0, f"so: {template} q5 r5 s5. {template}!"), (1, "the best option of these below now please q9 r9 s9"), (2, template[7:]), (3, "best option of these below"), (4, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (1 << 20, 400):
        got = [tuple(r)[:6] for r in decontaminate.decontaminate(spark.createDataFrame(texts, "doc_id long, text string"), bench, 10, limit).collect()]
        assert sorted(got) == sorted((i, *brute(t, items, 10)) for i, t in texts)


def test_a_block_of_items_with_one_template_has_one_group_for_it():
    template = b"answer the following question by choosing the best option of these below now please".split()
    windows = decontaminate.Windows([(str(i), [*template, b"q%d" % i, b"r%d" % i]) for i in range(20_000)])
    assert len(windows.group) == 5 + 20_000 * 2 and len(windows.items) == 20_000 + 1
    n, mask, names = decontaminate.scan(windows, (b" ".join(template) + b" and ").decode() * 50)
    assert n == 15 * 50 and mask.sum() == 14 * 50 and len(names) == 20_000
