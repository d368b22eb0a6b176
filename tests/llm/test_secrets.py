import hashlib
import random
import re

from fathom.llm import secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def brute(text):
    t = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


def check(df):
    for r, t in [(r, r["text"]) for r in df.collect()]:
        assert r["spans"] == brute(t), t
        assert r["base_sha256"] == hashlib.sha256(brute(t).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [brute(t).count(k + ":") for k in ("assign", "access", "hex")]


def scan(docs):
    return secrets.secret_scan(docs).join(docs.select("doc_id", "text").where("doc_id IS NOT NULL").distinct(), "doc_id")


def test_random_texts(spark):
    rng = random.Random(1)
    bits = ["password", "PassWd", "secret", "Token", "api_key", "APIKEY", "=", ": ", '"', "'", " ", "abc", "abcdefgh", "AKIA", "AKIA" + "A1" * 9, "é", "0123456789abcdef" * 2, "token", "key", "_", "-x", "\n", "K"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(40)))) for i in range(400)]
    check(scan(spark.createDataFrame(rows, "doc_id long, text string")))


def test_odd_and_empty(odd_docs, no_docs):
    check(scan(odd_docs))
    assert secrets.secret_scan(odd_docs).count() == odd_docs.count() and secrets.secret_scan(no_docs).count() == 0


def test_null_id_is_scanned(spark):
    df = spark.createDataFrame([(None, "token=abcdefgh")], "doc_id long, text string")
    assert secrets.secret_scan(df).first()["n_assign"] == 1


def test_queries_follow_from_expressions():
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == [("or", (("aki", "kia"),))]
    assert secrets.trigram_query("[0-9a-f]+") == []
    assert secrets.trigram_query("(abc|defg)x*hij") == [("or", (("abc",), ("def", "efg"))), ("or", (("hij",),))]
    assert secrets.trigram_query("a?b?c?") == []
