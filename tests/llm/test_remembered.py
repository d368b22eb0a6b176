"""What Python workers keep between the stages of the pipeline."""

import pyarrow as pa

import corpus_pipeline
from fathom.llm import bpe, decontaminate, learning, near_dedup, quality, remembered


def test_a_worker_remembers_for_one_operator_at_a_time():
    quality._begin()
    quality.grams("some words of a text")
    assert quality._TOKENS
    near_dedup._begin()
    assert not quality._TOKENS
    near_dedup.shingle_set(near_dedup.words("some words of a text"), 2)
    assert near_dedup._WORDS
    own = bpe._bpe(bpe.vocabulary_path())
    assert not near_dedup._WORDS
    assert bpe._bpe(bpe.vocabulary_path()) is own  # the same operator's next task finds what the last one left
    decontaminate._built(type("Held", (), {"value": [("a", [b"x"])]}), 10, "k")
    assert not bpe._LOADED and decontaminate._BUILT


def test_pieces_keep_every_row_in_order():
    batches = [pa.record_batch({"i": list(range(a, b))}) for a, b in ((0, 5), (5, 5), (5, 6), (6, 19))]
    got = list(remembered.pieces(iter(batches), 4))
    assert [i for b in got for i in b.column(0).to_pylist()] == list(range(19))
    assert max(b.num_rows for b in got) == 4


def batch_sizes(spark, make):
    """Rows of the batches that make's mapInArrow function gives for one batch of 3,000 rows."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(3)], "doc_id long, text string")
    held = []
    real = type(docs).mapInArrow

    def spied(self, f, schema):
        held.append((f, self.columns))
        return real(self, f, schema)

    type(docs).mapInArrow = spied
    try:
        make(docs)
    finally:
        type(docs).mapInArrow = real
    (f, names), n = held[0], 3000
    kinds = {"doc_id": pa.array(range(n), pa.int64()), "_n_tokens": pa.array([0] * n, pa.int64()), "_ids": pa.array([[]] * n, pa.list_(pa.int32()))}
    cols = [kinds.get(c, pa.array(["a text"] * n)) for c in names]
    return [b.num_rows for b in f(iter([pa.RecordBatch.from_arrays(cols, names=names)]))]


def test_large_batches_are_worked_through_in_pieces(spark):
    for make in (lambda d: bpe.encode_frame(d), lambda d: learning.scored(d, len)):
        sizes = batch_sizes(spark, make)
        assert sum(sizes) == 3000 and max(sizes) <= remembered.ROWS


def test_stages_send_wide_rows_in_batches_bounded_by_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.unset(key)
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('a text of words ', 250) AS text")

    def over(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    try:
        corpus_pipeline.token_stage(spark, docs, "")
        sizes = [r["n"] for r in docs.mapInArrow(over, "n long").collect()]
        spark.conf.set(key, "1000000")
        corpus_pipeline.token_stage(spark, docs, "")
        assert spark.conf.get(key) == "1000000"  # a bound of the session's own stays
    finally:
        spark.conf.unset(key)
        if before is not None:
            spark.conf.set(key, before)
    assert sum(sizes) > 12_000_000 and max(sizes) < 1.2 * corpus_pipeline.BATCH_BYTES


def test_quality_sends_a_text_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}", "en") for i in range(3)], "doc_id long, text string, _c0 string")
    sent = []
    monkeypatch.setattr(quality, "train", lambda *_: quality.ftrl([(1, None, None)]))
    real = learning.scored
    monkeypatch.setattr(learning, "scored", lambda d, score: sent.append([c for c, t in d.dtypes if t == "string"]) or real(d, score))
    out = quality.accepted(docs, docs, threshold=0.0)
    assert len(sent[0]) == 2 and out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.collect()))
