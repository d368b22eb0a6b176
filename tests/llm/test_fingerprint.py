import hashlib
import re

import pytest
from pyspark.sql import functions as F

from fathom.llm import fingerprint as fp

LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def hashes(text, size=fp.SIZE):
    low = (text or "").encode().translate(LOWER).decode()
    w = [x for x in re.split("[ \t-\r]+", low) if x]
    return {hashlib.md5(" ".join(w[i : i + size]).encode()).hexdigest()[: fp.DIGITS] for i in range(max(len(w) - size + 1, 1))} if w else set()


def brute(rows):
    """(id, text) rows -> the rows of fingerprints()."""

    def near(a, b):
        u = sorted(set(a) | set(b))[: fp.K]
        return len(set(u) & set(a) & set(b)) / len(u) if u else 1.0

    rows = [(i, t or "") for i, t in rows]
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0])
    out = []
    for n, (i, t) in enumerate(known):
        after = known[(n + 1) % len(known)][1]
        m = len(t) // 3
        edited = t[: len(t) - m] + after[:m]
        a, b, c = (sorted(hashes(x))[: fp.K] for x in (t, edited, after))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), near(a, b), near(a, c)))
    return sorted(out)


def test_equals_brute_force(spark, odd_docs):
    rows = [(i, t) for i, t in {(r["doc_id"], r["text"]) for r in odd_docs.collect()} if i is not None and (i, t) != (7, None)]
    rows = sorted(dict(rows).items())
    rows += [(-(1 << 63), "the smallest id there is"), ((1 << 63) - 1, "word " * 400), (1000, "a long text " + " ".join(map(str, range(5000))))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, fp.fingerprints(df).collect())) == brute(rows)


def test_defined_cases(spark, odd_docs, no_docs):
    got = fp.fingerprints(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by_text = {}
    for i, t in {(r["doc_id"], r["text"]) for r in odd_docs.collect()}:
        by_text.setdefault(i, set()).add("".join(sorted(hashes(t))[: fp.K]))
    assert all(r["fingerprint"] in by_text[r["doc_id"]] and 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in got)
    twice = sorted(r["near_next"] for r in got if r["doc_id"] == 100)
    assert twice[-1] == 1.0  # of two equal rows the first is followed by the second
    assert fp.fingerprints(no_docs).count() == 0
    one = fp.fingerprints(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1.0


@pytest.mark.parametrize("ids", [[7] * 300, [None] * 200 + list(range(100)), [1] * 150 + list(range(150))])
def test_next_of_ids_that_repeat(spark, ids):
    """Each row is the next of exactly one row, however many share an id, and ids do not rise but at the end."""
    rows = [(i, f"text {n} " * 3) for n, i in enumerate(ids)]
    df, _ = fp.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = df.where("NOT _halo").select("_id", "_text", "_next").collect()
    assert sorted(r["_next"] for r in got) == sorted(t for _, t in rows)
    of = {t: i for i, t in rows}
    low = float("-inf")
    rises = sum((of[r["_next"]] if of[r["_next"]] is not None else low) > (r["_id"] if r["_id"] is not None else low) for r in got)
    assert rises == (1 if len(set(ids)) > 1 else 0)
    key, ranges = None, fp._ranges(spark.createDataFrame(rows, "_id long, _text string"), fp._order(F.col("_text")))
    assert max(r["_n"] for r in ranges) < 100


def test_merging_parts(spark):
    """Sketches of parts, merged by key in any order, are the sketch of the union; a key without words has none."""
    texts = [(i % 3, " ".join(str((i * 37 + j) % 4001) for j in range(300))) for i in range(60)] + [(9, "")]
    parts = spark.createDataFrame(texts, "part long, text string").repartition(5).withColumn("sketch", fp.sketch(F.col("text")))
    got = {r["part"]: r["sketch"] for r in fp.merged(parts, ["part"]).collect()}
    assert set(got) == {0, 1, 2}
    for p, s in got.items():
        assert s == sorted(set().union(*[hashes(t) for q, t in texts if q == p]))[: fp.K]


def test_estimates(spark):
    rows = []
    for n, shared in ((100, 50), (4000, 1000), (4000, 3600), (3000, 0)):
        words = [f"w{n}{shared}{i}" for i in range(2 * n)]
        rows.append((" ".join(words[:n]), " ".join(words[n - shared : 2 * n - shared])))
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", fp.sketch(F.col("a")).alias("x"), fp.sketch(F.col("b")).alias("y"))
    for r in df.select("a", "b", fp.resemblance(F.col("x"), F.col("y")).alias("j"), fp.containment(F.col("x"), F.col("y")).alias("c"), fp.distinct_shingles(F.col("x")).alias("n")).collect():
        a, b = hashes(r["a"]), hashes(r["b"])
        assert abs(r["j"] - len(a & b) / len(a | b)) < 0.15 and abs(r["c"] - len(a & b) / len(a)) < 0.18
        assert abs(r["n"] - len(a)) <= (0 if len(a) < fp.K else 0.3 * len(a))


def test_no_python_and_one_exchange_of_texts(documents):
    plan = fp.fingerprints(documents)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert not re.search("Python|Pandas|Arrow", plan) and plan.count("Exchange ") == 1 and plan.count("Sort [") == 1
