import hashlib
import io

import pytest

from fathom.llm import warc
from fathom.plans.scratch import Scratch


def expected(rows):
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        again = len(raw) >= warc.LEAST_REVISIT and same and i != max(same)
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", max(same) if again else None))
    return sorted(out, key=str)


@pytest.fixture(params=[(1 << 14, 1 << 12), (500, 64)])
def small(request, monkeypatch):
    monkeypatch.setattr(warc, "SEGMENT_CHARS", request.param[0])
    monkeypatch.setattr(warc, "CHUNK_CHARS", request.param[1])


def test_round_trip(spark, small):
    big = "<p>é日\r\n\r\nWARC/1.1\r\n" * 300
    rows = [(1, "http://a/\r\nb", big), (2, None, big), (3, "u", big), (4, "u", None), (5, "u", ""), (6, "u", "x" * 999), (7, "u", "x" * 999), (8, "u", "y" * 1000), (9, "u", "y" * 1000), (9, "u", "y" * 1000), (None, "u", "y" * 1000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = sorted((tuple(r) for r in warc.round_trip(df).collect()), key=str)
    assert got == expected(rows)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_segments_in_several_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "SEGMENT_CHARS", 200)
    monkeypatch.setattr(warc, "RECORDS_PER_ARCHIVE", 3)
    df = spark.createDataFrame([(i, "u", f"{i} " * 700) for i in range(6)], "page_id long, url string, html string")
    assert sorted(r["payload_bytes"] for r in warc.round_trip(df).collect()) == [1400] * 6


def test_faults_are_found(spark):
    with pytest.raises(ValueError):
        warc.reassembled([(1, None, b"a"), (2, 3, b"b")])
    assert warc.reassembled([(2, None, b"b"), (3, 3, b"c")]) is None
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")))
    assert warc.dechunked(warc.chunked("é" * 9000).encode()).decode() == "é" * 9000
    assert Scratch(spark, "t").folder


def test_a_page_larger_than_an_archive_among_others(spark, monkeypatch):
    """One payload has many times the records that an archive takes; extra columns of clashing names are not looked at."""
    monkeypatch.setattr(warc, "SEGMENT_CHARS", 1000)
    monkeypatch.setattr(warc, "RECORDS_PER_ARCHIVE", 20)
    rows = [(1, "u", "long é " * 40_000), (2, "u", "short"), (3, None, "long é " * 40_000), (4, "u", "z\r\n\r\n" * 9000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "'x' AS refers_to", "0 AS place")
    assert sorted((tuple(r) for r in warc.round_trip(df).collect()), key=str) == expected(rows)
