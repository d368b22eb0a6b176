import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.llm import quality, toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["ta", "re", "no", "li", "ku", "mes"]) for _ in range(rng.randrange(1, 4)))
    rows, labels = [], []
    for i in range(500):
        own = [word() for _ in range(rng.randrange(20, 200))]
        good, toxic = rng.random() < 0.7, rng.random() < 0.25
        if not good:
            own = [w.upper() + "!!" for w in own]
        if toxic:
            for _ in range(max(1, len(own) // 30)):
                own[rng.randrange(len(own))] = rng.choice(["zurkig", "zurkmes", "vrothta", "vrothli"])
        rows.append((i, " ".join(own)))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("f,label,threshold,folds,fold", [(quality.quality_scores, "quality", 0.7, 4, 2), (toxicity.toxicity_scores, "toxic", 0.5, 5, 0)])
def test_held_out_accuracy(labelled, f, label, threshold, folds, fold):
    docs, labels = labelled
    got = f(docs, labels).join(labels, "doc_id").collect()
    assert len(got) == 500
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == fold)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == r[label] for r in held) >= 0.95 * len(held)
    again = {r["doc_id"]: r["score"] for r in f(docs, labels).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in got)


@pytest.mark.parametrize("f,label,held", [(quality.quality_scores, "quality", lambda i: zlib.crc32(str(i).encode()) % 4 == 2), (toxicity.toxicity_scores, "toxic", lambda i: zlib.crc32(str(i).encode()) % 5 == 0)])
def test_held_out_labels_teach_nothing(spark, labelled, f, label, held):
    docs, labels = labelled
    turned = spark.createDataFrame([(r["doc_id"], 1 - r[label] if held(r["doc_id"]) else r[label]) for r in labels.collect()], f"doc_id long, {label} int")
    a = {r["doc_id"]: r["score"] for r in f(docs, labels).collect()}
    assert a == {r["doc_id"]: r["score"] for r in f(docs, turned).collect()}


@pytest.mark.parametrize("f,label", [(quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_odd_texts_and_poor_labels(spark, odd_docs, no_docs, labelled, f, label):
    _, labels = labelled
    none = labels.limit(0)
    got = f(odd_docs, none).collect()
    assert len(got) == odd_docs.count() and all(abs(r["score"] - 0.5) < 1e-9 for r in got)
    one = spark.createDataFrame([(1, 1), (1, 1), (None, 1), (2, None)], f"doc_id long, {label} int")
    assert all(0 <= r["score"] <= 1 for r in f(odd_docs, one).collect())
    assert f(no_docs, labels).count() == 0


def test_accepted(labelled):
    docs, labels = labelled
    extra = docs.withColumn("_score", F.lit("x")).withColumn("lang", F.lit("en"))
    left = quality.accepted(extra, labels)
    assert left.columns == extra.columns and 0.5 < left.count() / 500 < 0.9


def test_repeated_word_counts_once():
    assert (toxicity.distinct("no idiot idiot idiot no") == toxicity.distinct("no idiot no")).all()


def test_ftrl_equals_plain_steps():
    import math
    import random

    rng = random.Random(1)
    rows = [(rng.randrange(2), np.array(sorted(rng.sample(range(50), 5)), np.int32), np.array([rng.random() for _ in range(5)], np.float32)) for _ in range(40)]
    got = np.frombuffer(quality.ftrl(rows, alpha=0.5, beta=1.0, l1=0.01, l2=0.1, epochs=2), np.float32)
    z, n, last = {}, {}, 1 << quality.BITS

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= 0.01 else -(zi - math.copysign(0.01, zi)) / ((1.0 + math.sqrt(n.get(i, 0.0))) / 0.5 + 0.1)

    for _ in range(2):
        for y, idx, val in rows:
            x = [*zip(idx.tolist(), val.tolist()), (last, 1.0)]
            w = {i: weight(i) for i, _ in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x)))
            for i, v in x:
                g = (p - y) * v
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / 0.5
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    assert all(abs(got[i] - weight(i)) < 1e-6 for i in [*range(50), last]) and not got[50:last].any()


def test_windows_and_ratios_equal_plain_counts(spark):
    import math

    text = " ".join(f"w{i * i % 97} thing{i % 13}" for i in range(400))
    weights = np.random.default_rng(3).normal(size=1 << toxicity.BITS)
    codes = toxicity._codes(text)
    step = toxicity.WINDOW // 2
    own = toxicity.window_sums(text, weights)
    for k, got in enumerate(own):
        want = sum(weights[idx[k * step : k * step + toxicity.WINDOW]].sum() for idx in toxicity.gram_index(codes))
        assert abs(got - want) < 1e-6
    assert (len(own) - 1) * step < max(1, len(codes) - step) <= len(own) * step
    rows = [(1, "you vile toad"), (1, "vile vile toad here"), (0, "a calm day"), (0, "a day here"), (0, "calm sea"), (1, "vile toad"), (0, "toad day"), (1, "such a vile toad")]
    ratios = toxicity.count_ratios(spark.createDataFrame(rows, "_label int, text string"))
    for g in np.unique(np.concatenate([toxicity.distinct(t) for _, t in rows])):
        n = [sum(g in toxicity.distinct(t) for y, t in rows if y == k) for k in (0, 1)]
        r = math.log((n[1] + 0.5) / 5) - math.log((n[0] + 0.5) / 5)
        assert abs(ratios[g] - (r if sum(n) >= toxicity.LEAST_DOCS and abs(r) >= toxicity.LEAST_RATIO else 0)) < 1e-6


def test_best_cut():
    assert toxicity.best_cut(np.array([3.0, 2.0, -1.0, -2.0]), np.array([1, 1, 0, 0])) == 0.5
    assert toxicity.best_cut(np.array([1.0, 1.0, 0.0]), np.array([1, 1, 1])) < 0.0
