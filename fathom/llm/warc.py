"""WARC archives of pages: writing segmented records, and reading them back by segment reassembly.

Writing: every page becomes a response record whose block is an HTTP message with a chunked body, or, where an equal payload
has a response already, a revisit that names it. A block longer than ``SEGMENT_CHARS`` is cut into a first record and
continuation records, which carry the origin's id and a segment number; the last carries the total length. Archives are
gzipped text files of Spark's own writer, with the end of a record as the line end, in the folder that the cluster shares. A file
has at most ``RECORDS_PER_ARCHIVE`` records of at most ``SEGMENT_CHARS`` characters, however large the pages are.

Reading: an archive is one row of the binary source, as compressed, and is unpacked as a stream, record by record by
Content-Length, so a task holds the segments of one page at a time unpacked. Records whose segments are all in one archive are put together there; the segments of
others are grouped by origin id, ordered by number and checked against the total length. Then the chunked framing is decoded.

Defined cases: null html counts as empty; payloads under ``LEAST_REVISIT`` bytes are always responses; rows that share the
largest page_id of a group of equal payloads are all responses; a null page_id reads back as null and such rows refer to, or
are referred to by, other rows by id only; null urls leave the target out; line breaks in urls are escaped; repeated rows
are repeated records; an empty table gives an empty archive and an empty result; other columns are not looked at.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.plans.scratch import Scratch

LEAST_REVISIT = 1000
SEGMENT_CHARS = 1 << 14
CHUNK_CHARS = 1 << 12
RECORDS_PER_ARCHIVE = 4000
END = "\r\n\r\n"

HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, origin string, segment int, total long, block binary"
_SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
     ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())]
)


def chunked(text: str) -> str:
    """The body in chunked transfer framing; chunk sizes count bytes."""
    out = []
    for i in range(0, len(text), CHUNK_CHARS):
        part = text[i : i + CHUNK_CHARS]
        out.append(f"{len(part.encode('utf-8', 'surrogatepass')):x}\r\n{part}\r\n")
    return "".join(out) + "0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        if len(out[-1]) != n or body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk is shorter than it says")
        at = end + 4 + n


def _record(fields: list[tuple[str, object]], block: str) -> str:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block.encode('utf-8', 'surrogatepass'))}\r\n\r\n{block}"


def records(page_id: int | None, url: str | None, html: str | None, digest: str, refers_to: int | None, place: int) -> Iterator[str]:
    """The records of a page, without their ends."""
    name = f"<urn:page:{'' if page_id is None else page_id}:{place}>"
    uri = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    common = [("WARC-Record-ID", name), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield _record([("WARC-Type", "revisit"), *common, ("WARC-Profile", profile), ("WARC-Refers-To", f"<urn:page:{refers_to}>")], HTTP)
        return
    block = HTTP + chunked(html or "")
    parts = [block[i : i + SEGMENT_CHARS] for i in range(0, len(block), SEGMENT_CHARS)]
    if len(parts) == 1:
        yield _record([("WARC-Type", "response"), *common], block)
        return
    yield _record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", 1)], parts[0])
    for n, part in enumerate(parts[1:], 2):
        total = len(block.encode("utf-8", "surrogatepass")) if n == len(parts) else None
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{n}>"), ("WARC-Segment-Origin-ID", name)]
        yield _record([*own, ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total)], part)


def revisits(digests: DataFrame) -> DataFrame:
    """(_p, _d, refers_to): the pages that an equal payload's response stands for. digests: page_id, digest, large."""
    large = digests.where("large")
    groups = large.groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 AND first_id IS NOT NULL")
    again = large.join(groups.select("digest", "first_id"), "digest").where(~F.col("page_id").eqNullSafe(F.col("first_id")))
    return again.select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), F.col("first_id").alias("refers_to")).distinct()


def write_archives(pages: DataFrame, folder: str, scratch: Scratch) -> None:
    """pages: page_id, url, html. Writes gzipped archives to a shared folder.

    Which pages are revisits is found from digests alone. The written list of these has a known size: Spark sends it to the
    pages where it is small, and else joins by page, so that no digest, however many pages have it, brings bodies together.
    """
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumns({"digest": F.sha1("html"), "large": F.octet_length("html") >= LEAST_REVISIT})
    again = scratch.table(revisits(scratch.table(own.select("page_id", "digest", "large"), "digests")), "revisits")
    joined = own.join(again, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("digest") == F.col("_d")), "left")
    rows = joined.select("page_id", "url", F.when(F.col("_d").isNull(), F.col("html")).alias("html"), "digest", "refers_to", F.monotonically_increasing_id().alias("place"))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [r for row in zip(*[c.to_pylist() for c in b.columns]) for r in records(*row)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    rows.mapInArrow(over, "value string").write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_ARCHIVE).text(folder)


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an unpacked archive."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no record where one must begin")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            k, _, v = line.decode("utf-8", "surrogatepass").partition(":")
            fields[k.strip().lower()] = v.strip()
        n = int(fields["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError("a record is shorter than it says")
        yield fields, block


def _page(name: str) -> int | None:
    own = name.strip("<>").split(":")[2]
    return int(own) if own else None


def payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def reassembled(segments: list[tuple[int, int | None, bytes]]) -> bytes | None:
    """The block of the segments of one record, or None while some are missing; a wrong total length is an error."""
    segments = sorted(segments, key=lambda s: s[0])
    total = segments[-1][1]
    if total is None or [s[0] for s in segments] != list(range(1, len(segments) + 1)):
        return None
    block = b"".join(s[2] for s in segments)
    if len(block) != total:
        raise ValueError("segments do not add up to the total length")
    return block


def _response(name: str, block: bytes, said: str | None) -> tuple:
    own = payload(block)
    digest = hashlib.sha1(own).hexdigest()
    if said and digest != said:
        raise ValueError(f"the payload of {name} has another digest than its record says")
    return (_page(name), len(own), digest, "response", None, None, None, None, None)


def _archive(stream) -> Iterator[tuple]:
    """Finished rows of an archive, and the segments of records that other archives continue."""
    open_records: dict[str, list] = {}
    said: dict[str, str] = {}
    for fields, block in parse(stream):
        kind = fields["warc-type"]
        digest = fields.get("warc-payload-digest", "").partition(":")[2]
        if kind == "revisit":
            yield (_page(fields["warc-record-id"]), None, digest, kind, _page(fields["warc-refers-to"]), None, None, None, None)
        elif kind in ("response", "continuation"):
            number = int(fields.get("warc-segment-number", 0))
            if not number:
                yield _response(fields["warc-record-id"], block, digest)
                continue
            name = fields.get("warc-segment-origin-id", fields["warc-record-id"])
            total = fields.get("warc-segment-total-length")
            open_records.setdefault(name, []).append((number, int(total) if total else None, block))
            if number == 1:
                said[name] = digest
            if total and (whole := reassembled(open_records[name])) is not None:
                del open_records[name]
                yield _response(name, whole, said.get(name))
    for name, segments in open_records.items():
        for number, total, block in segments:
            yield (None, None, said.get(name) if number == 1 else None, None, None, name, number, total, block)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SCHEMA)], schema=_SCHEMA)


def read_archives(spark: SparkSession, folder: str, scratch: Scratch) -> DataFrame:
    """A row for each page record: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows: list[tuple] = []
                for row in _archive(io.BufferedReader(gzip.GzipFile(fileobj=pa.BufferReader(content.as_buffer())))):
                    rows.append(row)
                    if len(rows) >= 2000:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    def together(segments: pa.Table) -> pa.Table:
        own = segments.to_pylist()
        block = reassembled([(s["segment"], s["total"], s["block"]) for s in own])
        if block is None:
            raise ValueError(f"segments of {own[0]['origin']} are missing")
        return pa.Table.from_batches([_rows([_response(own[0]["origin"], block, max(s["payload_digest"] or "" for s in own))])])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    parsed = scratch.table(files.mapInArrow(over, FIELDS), "parsed")
    whole = parsed.where("origin IS NULL")
    whole = whole.union(parsed.where("origin IS NOT NULL").groupBy("origin").applyInArrow(together, FIELDS)).select(*FIELDS.replace(",", "").split()[:10:2])
    response = whole.where("record_type = 'response'")
    first = response.groupBy(F.col("page_id").alias("_p"), F.col("payload_digest").alias("_d")).agg(F.max("payload_bytes").alias("_n"))
    revisit = whole.where("record_type = 'revisit'").join(first, (F.col("refers_to") == F.col("_p")) & (F.col("payload_digest") == F.col("_d")), "left")
    return response.union(revisit.select("page_id", F.col("_n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archives of pages and reads them back."""
    scratch = Scratch(pages.sparkSession, "warc")
    folder = scratch.path("archives")
    write_archives(pages, folder, scratch)
    return read_archives(pages.sparkSession, folder, scratch)


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS first_id FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= {LEAST_REVISIT} AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {LEAST_REVISIT} AND page_id <> first_id THEN first_id END AS refers_to
FROM w
"""
