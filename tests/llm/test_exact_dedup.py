import hashlib
from collections import defaultdict

import pytest

from fathom.llm import exact_dedup


@pytest.mark.parametrize("fan_in,parts", [(2, 9), (8, 3), (3, 1)])
def test_groups(spark, odd_docs, fan_in, parts):
    docs = odd_docs.repartition(parts)
    rows = docs.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[hashlib.sha256((r["text"] or "").encode()).hexdigest()].append(r["doc_id"])
    got = exact_dedup.exact_dedup(docs, fan_in=fan_in).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = groups[r["text_sha256"]]
        known = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids) and r["keep_id"] == (max(known) if known else None)
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert sorted(kept) == sorted(groups)


def test_survivors(odd_docs, no_docs):
    left = exact_dedup.survivors(odd_docs)
    assert left.columns == odd_docs.columns
    texts = [r["text"] or "" for r in left.collect()]
    assert sorted(texts) == sorted({r["text"] or "" for r in odd_docs.collect()})
    assert {r["doc_id"] for r in left.where("text LIKE 'The quick%'").collect()} == {100}
    assert exact_dedup.survivors(no_docs).count() == 0 and exact_dedup.exact_dedup(no_docs).count() == 0


def test_rounds_merge_sorted_runs(spark, documents):
    """Each round is one exchange by slice and run, a sort by digest and a sort aggregate; no exchange deals single digests after level 0."""
    import re

    runs = exact_dedup.digest_runs(documents.repartition(20))
    merged = exact_dedup.merge_runs(runs, fan_in=3)
    merged.collect()
    plan = merged._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\), REPARTITION_BY_COL", plan)
    assert len(dealt) == 3 and all(re.fullmatch(r"_slice#\d+L?, _run#\d+L?, \d+", d) for d in dealt)
    assert len(re.findall(r"Exchange hashpartitioning\([^)]*\), ENSURE_REQUIREMENTS", plan)) == 1
    sorts = re.findall(r"Sort \[([^]]*)\], false", plan)
    assert len(sorts) >= 4 and all("_digest" in s for s in sorts) and plan.count("SortAggregate") >= 4 and "HashAggregate" not in plan


def test_survivors_of_any_column_type(spark):
    df = spark.sql("SELECT * FROM VALUES (1L, 'a', map('k', 1)), (1L, 'a', map('k', 2)), (1L, 'a', map('k', 1)), (0L, 'a', NULL), (2L, NULL, NULL), (NULL, '', map('z', 0)) AS t(doc_id, text, _id)")
    got = sorted((r["doc_id"], r["text"] or "", str(r["_id"])) for r in exact_dedup.survivors(df).collect())
    assert got == [(1, "a", "{'k': 1}"), (2, "", "None")]
