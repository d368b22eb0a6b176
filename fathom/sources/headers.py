"""Formats, dimensions, EXIF records and text chunks of images, read from their first bytes; pixels are not decoded."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fathom.functions import media as m
from fathom.functions import metadata as md

HEAD_BYTES = 512 * 1024
TEXT_BYTES = 1024 * 1024
FIELDS = StructType().add("format", "string").add("width", "integer").add("height", "integer").add("exif", "string").add("texts", "string")

#: Numbers of EXIF fields in the main, the camera's and the position's directory, and those of the two others.
MAIN = {256: "ImageWidth", 257: "ImageLength", 271: "Make", 272: "Model", 274: "Orientation", 305: "Software", 306: "DateTime"}
CAMERA = {
    33434: "ExposureTime", 33437: "FNumber", 34855: "ISOSpeedRatings", 36867: "DateTimeOriginal", 36868: "DateTimeDigitized", 37385: "Flash",
    37386: "FocalLength", 40962: "ExifImageWidth", 40963: "ExifImageHeight", 41987: "WhiteBalance",
}
POSITION = {1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 6: "GPSAltitude", 7: "GPSTimeStamp"}
CAMERA_AT, POSITION_AT = 34665, 34853
#: The struct letter of a field's kind, by its number; kind 2 is text.
KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}
#: JPEG markers that stand alone, and those of a frame.
ALONE = {0x01, *range(0xD0, 0xD9)}
FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}


def _directory(tiff: bytes, at: int, order: str) -> dict[int, list | str]:
    """The fields of one directory; those whose values lie beyond the bytes at hand are left out."""
    out: dict[int, list | str] = {}
    for i in range(struct.unpack_from(order + "H", tiff, at)[0]):
        entry = at + 2 + 12 * i
        if entry + 12 > len(tiff):
            break
        tag, kind, count = struct.unpack_from(order + "HHI", tiff, entry)
        one = KINDS.get(kind)
        if one is None:
            continue
        size = struct.calcsize("=" + one) * count
        start = entry + 8 if size <= 4 else struct.unpack_from(order + "I", tiff, entry + 8)[0]
        raw = tiff[start : start + size]
        if len(raw) < size:
            continue
        if kind == 2:
            out[tag] = raw.split(b"\0")[0].decode("utf-8", "replace").strip()
        else:
            flat = struct.unpack(order + one * count, raw)
            out[tag] = [a / b if b else None for a, b in zip(flat[::2], flat[1::2])] if len(one) == 2 else list(flat)
    return out


def _degrees(parts: list | str | None, ref: list | str | None) -> float | None:
    if not ref or not isinstance(parts, list) or len(parts) != 3 or None in parts:
        return None
    value = parts[0] + parts[1] / 60 + parts[2] / 3600
    return -value if ref in ("S", "W") else value


def _exif(tiff: bytes) -> tuple[dict, tuple[int, int] | None]:
    """The record of a TIFF structure, fractions as doubles and positions in degrees, and its own dimensions."""
    order = {b"II*\0": "<", b"MM\0*": ">"}[tiff[:4]]
    main = _directory(tiff, struct.unpack_from(order + "I", tiff, 4)[0], order)
    record: dict = {}

    def add(names: dict[int, str], fields: dict[int, list | str]) -> None:
        for tag, name in names.items():
            v = fields.get(tag)
            if isinstance(v, list):
                v = v[0] if len(v) == 1 else None
            if v is not None and v == v and v not in (float("inf"), float("-inf")):
                record[name] = v

    add(MAIN, main)
    for at, names in ((CAMERA_AT, CAMERA), (POSITION_AT, POSITION)):
        try:
            if at in main:
                fields = _directory(tiff, main[at][0], order)
                add(names, fields)
                if at == POSITION_AT:
                    for name, parts, ref in (("GPSLatitudeDecimal", 2, 1), ("GPSLongitudeDecimal", 4, 3)):
                        value = _degrees(fields.get(parts), fields.get(ref))
                        if value is not None:
                            record[name] = value
        except (struct.error, IndexError, TypeError):
            pass
    width, height = record.get("ImageWidth"), record.get("ImageLength")
    return record, (width, height) if width and height else None


def _inflated(packed: bytes) -> bytes:
    """At most TEXT_BYTES; a longer text is an error, as one that is cut off is."""
    stream = zlib.decompressobj()
    text = stream.decompress(packed, TEXT_BYTES)
    if not stream.eof:
        raise ValueError("text too long or cut off")
    return text


def _png(b: bytes) -> tuple:
    size, tiff, texts, at = None, None, {}, 8
    while at + 8 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, at)
        body, at = b[at + 8 : at + 8 + n], at + 12 + n
        if kind == b"IHDR":
            size = struct.unpack_from(">II", body)
        elif len(body) < n:
            break
        elif kind == b"eXIf":
            tiff = body
        elif kind in (b"tEXt", b"zTXt", b"iTXt"):
            key, _, rest = body.partition(b"\0")
            try:
                if kind == b"zTXt":
                    rest = _inflated(rest[1:])
                elif kind == b"iTXt":
                    packed, rest = rest[0], rest[2:].split(b"\0", 2)[2]
                    rest = _inflated(rest) if packed else rest
                texts[key.decode("latin-1")] = rest.decode("utf-8", "replace")
            except (ValueError, IndexError, zlib.error):
                continue
    return "png", size, tiff, texts


def _jpeg(b: bytes) -> tuple:
    size, tiff, at = None, None, 2
    while at + 4 <= len(b) and b[at] == 0xFF:
        marker = b[at + 1]
        if marker == 0xFF or marker in ALONE:
            at += 1 if marker == 0xFF else 2
            continue
        if marker in (0xD9, 0xDA):
            break
        n = struct.unpack_from(">H", b, at + 2)[0]
        body = b[at + 4 : at + 2 + n]
        if marker in FRAMES and size is None:
            size = struct.unpack_from(">HH", body, 1)[::-1]
        elif marker == 0xE1 and tiff is None and body.startswith(b"Exif\0\0"):
            tiff = body[6:]
        at += 2 + n
    return "jpeg", size, tiff, {}


def _gif(b: bytes) -> tuple:
    return "gif", struct.unpack_from("<HH", b, 6), None, {}


def _bmp(b: bytes) -> tuple:
    old = struct.unpack_from("<I", b, 14)[0] == 12
    width, height = struct.unpack_from("<HH" if old else "<ii", b, 18)
    return "bmp", (width, abs(height)), None, {}


def _webp(b: bytes) -> tuple:
    size, tiff, at = None, None, 12
    while at + 8 <= len(b):
        kind, n = struct.unpack_from("<4sI", b, at)
        body, at = b[at + 8 : at + 8 + n], at + 8 + n + n % 2
        if kind == b"VP8X":
            size = tuple(1 + int.from_bytes(body[i : i + 3], "little") for i in (4, 7)) if len(body) >= 10 else None
        elif kind == b"VP8 " and size is None and body[3:6] == b"\x9d\x01\x2a":
            size = tuple(x & 0x3FFF for x in struct.unpack_from("<HH", body, 6))
        elif kind == b"VP8L" and size is None and body[:1] == b"\x2f":
            bits = struct.unpack_from("<I", body, 1)[0]
            size = (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        elif kind == b"EXIF":
            tiff = body.removeprefix(b"Exif\0\0")
    return "webp", size, tiff, {}


def _tiff(b: bytes) -> tuple:
    return "tiff", _exif(b)[1], b, {}


def _heif(b: bytes) -> tuple:
    """The largest stated extent: tiles and thumbnails have their own."""
    found = [struct.unpack_from(">II", b, at + 8) for at in _places(b, b"ispe") if at + 16 <= len(b)]
    return "heif", max(found, key=lambda s: s[0] * s[1], default=None), None, {}


def _places(b: bytes, mark: bytes) -> Iterator[int]:
    at = b.find(mark)
    while at >= 0:
        yield at
        at = b.find(mark, at + 1)


READERS: tuple[tuple[int, bytes, Callable[[bytes], tuple]], ...] = (
    (0, b"\x89PNG\r\n\x1a\n", _png), (0, b"\xff\xd8\xff", _jpeg), (0, b"GIF87a", _gif), (0, b"GIF89a", _gif), (0, b"BM", _bmp),
    (8, b"WEBP", _webp), (0, b"II*\0", _tiff), (0, b"MM\0*", _tiff), (4, b"ftyphei", _heif), (4, b"ftypmif1", _heif),
)


def described(b: bytes | None) -> tuple:
    """(format, width, height, EXIF as JSON, texts as JSON) of one head; all null where no dimensions can be read."""
    for at, mark, read in READERS:
        if b and b.startswith(mark, at):
            try:
                kind, size, tiff, texts = read(b)
            except (struct.error, ValueError, IndexError, KeyError, TypeError):
                break
            if not size or not 0 < size[0] < 2**31 or not 0 < size[1] < 2**31:
                break
            try:
                exif = json.dumps(_exif(tiff)[0]) if tiff else None
            except (struct.error, ValueError, IndexError, KeyError, TypeError):
                exif = None
            return kind, size[0], size[1], exif, json.dumps(texts) if texts else None
    return (None,) * 5


@F.pandas_udf(FIELDS)
def _described(heads: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame([described(bytes(b) if b is not None else None) for b in heads], columns=FIELDS.names)
    return out.astype({"width": "Int32", "height": "Int32"})


def header(content: Column) -> Column:
    """struct(format, width, height, exif, texts) of a file's content, of which only the first HEAD_BYTES go to Python.

    Width and height are as stored. A file that is empty, cut off before its dimensions or of an unknown format, and a null, give
    nulls; an EXIF block or a text that cannot be read gives none of its own only.
    """
    return _described(F.substring(content, 1, HEAD_BYTES))


def upright(width: Column, height: Column, exif: Column) -> tuple[Column, Column]:
    """Width and height after the turn that the EXIF record asks for."""
    turned = F.coalesce(F.get_json_object(exif, "$.Orientation").try_cast("int").between(5, 8), F.lit(False))
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def record(exif: Column, texts: Column, *keys: str) -> Column:
    """A file's metadata as a variant: the first of the named texts that is JSON, else the EXIF record, else an empty object."""
    named = [F.try_element_at(F.from_json(texts, "map<string,string>"), F.lit(k)) for k in keys]
    return md.first_json(*named, exif)


def taken_at(exif: Column, fallback: Column) -> Column:
    """Epoch seconds of the first EXIF date that can be read, else the file's own time."""
    dates = [F.get_json_object(exif, f"$.{k}") for k in ("DateTimeOriginal", "DateTimeDigitized", "DateTime")]
    return md.modification_time(*dates, fallback)


def image_headers(spark: SparkSession, roots: str | Sequence[str], least: int = 0, most: int | None = None) -> DataFrame:
    """(path, size, mtime, format, width, height, exif, texts) of the images under directories, opened only within the byte limits.

    The limits are filters of the scan, so files outside are listed and not read; contents are never shuffled.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([roots] if isinstance(roots, str) else list(roots))
    files = files.where((F.col("length") >= least) & (F.lit(True) if most is None else F.col("length") <= most))
    files = files.where(m.media_type(F.col("path")) == "image")
    own = files.select("path", F.col("length").alias("size"), (F.unix_micros("modificationTime") / F.lit(1e6)).alias("mtime"), header(F.col("content")).alias("h"))
    return own.select("path", "size", "mtime", "h.*")


def sizes(headers: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """For scan.gated: adds the width and height that were read; null, and so rejected, where none were."""
    return lambda files: files.join(headers.select("path", "width", "height"), "path", "left")
