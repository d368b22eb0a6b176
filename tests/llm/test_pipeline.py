import corpus_pipeline
import pytest


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [("input", docs)]
    folder = tmp_path_factory.mktemp("stages")
    for i, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        out.append((name, docs))
    return out


def test_stages_keep_columns_and_shrink(stages):
    counts = [d.count() for _, d in stages]
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] > 0
    for name, d in stages[1:-1]:
        assert d.columns == stages[0][1].columns, name


def test_decisions_equal_brute_force(spark, sf_dir, stages):
    from test_decontaminate import brute as leak
    from test_near_dedup import brute as near

    from fathom.llm import quality

    docs, labels = stages[0][1], spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r["doc_id"] for r in quality.quality_scores(docs, labels).where("predicted = 1").collect()}
    own = lambda i: {r["doc_id"]: r["text"] for r in stages[i][1].collect()}
    assert set(own(1)) == good
    last = {}
    for i, t in sorted(own(1).items()):
        last[t] = i
    assert set(own(2)) == set(last.values())
    assert set(own(3)) == {d for d, n, c in near(sorted(own(2).items()), 5, 80) if n == 0 or d == c}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert set(own(4)) == {i for i, t in own(3).items() if not leak(t, items, 10)[4]}
    assert {r["doc_id"] for r in stages[5][1].collect()} == set(own(4))


def test_run(spark, sf_dir, stages):
    assert {tuple(r["ids"]) for r in corpus_pipeline.run(spark, sf_dir).collect()} == {tuple(r["ids"]) for r in stages[5][1].collect()}
