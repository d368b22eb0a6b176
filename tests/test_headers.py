"""Images made byte by byte: dimensions, dates, positions and texts; broken files give nulls."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from fathom.functions import metadata as md
from fathom.sources import headers, scan


def tiff(order, main, camera=(), position=()):
    """A TIFF structure of directories; fields are (tag, kind, values or text)."""
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    main = [*main, *([(34665, 4, [0])] if camera else []), *([(34853, 4, [0])] if position else [])]
    starts, at = [], 8
    for d in (main, camera, position):
        starts.append(at)
        at += 6 + 12 * len(d) + sum(len(packed(order, k, v)) for _, k, v in d)
    out = head
    for d, start in zip((main, camera, position), starts):
        entries, beyond = b"", b""
        for tag, kind, v in d:
            v = [starts[1]] if tag == 34665 else [starts[2]] if tag == 34853 else v
            raw = packed(order, kind, v)
            count = len(v) if kind not in (5, 10) else len(v) // 2
            if len(raw) <= 4:
                entries += struct.pack(order + "HHI", tag, kind, count) + raw.ljust(4, b"\0")
            else:
                entries += struct.pack(order + "HHII", tag, kind, count, start + 6 + 12 * len(d) + len(beyond))
                beyond += raw
        own = struct.pack(order + "H", len(d)) + entries + bytes(4) + beyond
        out = out[:start].ljust(start, b"\0") + own
    return out


def packed(order, kind, v):
    if kind == 2:
        return v.encode()
    return b"".join(struct.pack(order + {1: "B", 3: "H", 4: "I", 5: "I", 10: "i"}[kind], x) for x in v)


def jpeg(w, h, exif=None, frame=0xC0):
    app = b"\xff\xe1" + struct.pack(">H", len(exif) + 8) + b"Exif\0\0" + exif if exif else b""
    table = b"\xff\xc4" + struct.pack(">H", 6) + b"\0\1\0\2"
    return b"\xff\xd8\xff\xe0\0\4ab" + app + b"\xff" + table + b"\xff" + bytes([frame]) + struct.pack(">HBHH", 9, 8, h, w) + b"\1\1" + b"\xff\xda\0\2"


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(w, h, *more):
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + b"".join(more) + chunk(b"IDAT", b"x") + chunk(b"IEND", b"")


def webp(kind, body, *more):
    inner = b"WEBP" + kind + struct.pack("<I", len(body)) + body + bytes(len(body) % 2) + b"".join(more)
    return b"RIFF" + struct.pack("<I", len(inner)) + inner


DATES = [(36867, 2, "2021:05:06 07:08:09\0"), (33434, 5, [1, 250]), (33437, 5, [28, 10]), (34855, 3, [200]), (37386, 5, [50, 0])]
PLACE = [(1, 2, "S\0"), (2, 5, [10, 1, 30, 1, 36, 1]), (3, 2, "E\0"), (4, 5, [20, 1, 15, 1, 0, 1]), (6, 5, [7, 2])]


@pytest.mark.parametrize("order", "<>")
def test_jpeg_with_exif(order):
    block = tiff(order, [(271, 2, "Maker\0"), (274, 3, [6]), (306, 2, "2020:01:01 00:00:00\0")], DATES, PLACE)
    kind, w, h, exif, texts = headers.described(jpeg(640, 480, block, 0xC2))
    assert (kind, w, h, texts) == ("jpeg", 640, 480, None)
    assert json.loads(exif) == {
        "Make": "Maker", "Orientation": 6, "DateTime": "2020:01:01 00:00:00", "DateTimeOriginal": "2021:05:06 07:08:09", "ExposureTime": 0.004, "FNumber": 2.8,
        "ISOSpeedRatings": 200, "GPSLatitudeRef": "S", "GPSLongitudeRef": "E", "GPSAltitude": 3.5, "GPSLatitudeDecimal": -10.51, "GPSLongitudeDecimal": 20.25,
    }


def test_other_formats():
    size = lambda b: headers.described(b)[:3]
    assert size(png(70000, 3)) == ("png", 70000, 3)
    assert size(b"GIF89a" + struct.pack("<HH", 300, 200) + b"\0\0\0") == ("gif", 300, 200)
    assert size(b"BM" + bytes(12) + struct.pack("<Iii", 40, 31, -17)) == ("bmp", 31, 17)
    assert size(b"BM" + bytes(12) + struct.pack("<IHH", 12, 31, 17)) == ("bmp", 31, 17)
    assert size(webp(b"VP8X", bytes(4) + (499).to_bytes(3, "little") + (299).to_bytes(3, "little"))) == ("webp", 500, 300)
    assert size(webp(b"VP8 ", b"abc\x9d\x01\x2a" + struct.pack("<HH", 320 | 1 << 14, 240))) == ("webp", 320, 240)
    assert size(webp(b"VP8L", b"\x2f" + struct.pack("<I", 99 | 49 << 14))) == ("webp", 100, 50)
    assert size(tiff(">", [(256, 3, [12]), (257, 4, [34])])) == ("tiff", 12, 34)
    ispe = lambda w, h: b"\0\0\0\x14ispe" + struct.pack(">III", 0, w, h)
    assert size(b"\0\0\0\x18ftypheic" + bytes(12) + ispe(512, 512) + ispe(4032, 3024)) == ("heif", 4032, 3024)
    block = webp(b"VP8X", bytes(4) + bytes(6), b"EXIF", struct.pack("<I", len(tiff("<", [(271, 2, "Maker\0")]))), tiff("<", [(271, 2, "Maker\0")]))
    assert headers.described(block)[3] == '{"Make": "Maker"}'


def test_png_texts():
    long = zlib.compress(b"z" * (headers.TEXT_BYTES + 1))
    b = png(
        1, 1, chunk(b"tEXt", b"plain\0{not json"), chunk(b"zTXt", b"packed\0\0" + zlib.compress(b'{"seed": 42}')), chunk(b"zTXt", b"bad\0\0xx"),
        chunk(b"iTXt", b"said\0\0\0en\0key\0caf\xc3\xa9"), chunk(b"iTXt", b"short\0"), chunk(b"iTXt", b"both\0\1\0\0\0" + zlib.compress(b"deep")), chunk(b"zTXt", b"long\0\0" + long),
    )
    assert json.loads(headers.described(b)[4]) == {"plain": "{not json", "packed": '{"seed": 42}', "said": "café", "both": "deep"}


def test_broken_files_give_nulls():
    whole = [jpeg(640, 480, tiff("<", [(271, 2, "Maker\0")], DATES, PLACE)), png(5, 6), b"GIF89a" + struct.pack("<HH", 3, 2), webp(b"VP8L", b"\x2f" + bytes(4)), tiff("<", [(256, 3, [1]), (257, 3, [2])])]
    assert headers.described(None) == headers.described(b"") == headers.described(b"text") == headers.described(png(0, 5)) == (None,) * 5
    for b in whole:
        assert headers.described(b)[0]
        for n in range(len(b)):
            kind, w, h, exif, texts = headers.described(b[:n])
            assert (kind is None) == (w is None) == (h is None)
    lost = jpeg(9, 8, b"II*\0" + struct.pack("<I", 9999))
    assert headers.described(lost) == ("jpeg", 9, 8, None, None)
    cyclic = tiff("<", [(34665, 4, [8]), (271, 2, "Maker\0")])
    assert headers.described(jpeg(9, 8, cyclic))[:3] == ("jpeg", 9, 8)


def test_files_by_gate_and_date(spark, tmp_path):
    turned = jpeg(400, 300, tiff("<", [(274, 3, [8])], [(36867, 2, "nonsense\0"), (36868, 2, "2021:05:06 07:08:09\0")]))
    own = {"a.jpg": turned, "small.png": png(200, 900), "ok.png": png(300, 900, chunk(b"tEXt", b"meta\0{\"seed\": 7}")), "bad.gif": b"GIF", "note.txt": png(9, 9)}
    (tmp_path / "in").mkdir()
    for name, b in own.items():
        (tmp_path / "in" / name).write_bytes(b + bytes(9000))
    (tmp_path / "tiny.jpg").write_bytes(turned)
    (tmp_path / "huge.jpg").write_bytes(b"x" * 600_000)
    name = F.element_at(F.split("path", "/"), -1)
    read = headers.image_headers(spark, str(tmp_path), 8192, 500 * 1024)
    assert "GreaterThanOrEqual(length,8192)" in read._jdf.queryExecution().toString()
    got = {r["n"]: r for r in read.select("*", name.alias("n"), *[c.alias(k) for c, k in zip(headers.upright(F.col("width"), F.col("height"), F.col("exif")), "wh")], headers.taken_at(F.col("exif"), F.lit(1.0)).alias("t"), md.seed(headers.record(F.col("exif"), F.col("texts"), "other", "meta")).alias("seed")).collect()}
    assert set(got) == {"a.jpg", "small.png", "ok.png", "bad.gif"}
    assert (got["a.jpg"]["w"], got["a.jpg"]["h"], got["a.jpg"]["t"]) == (300, 400, 1620284889.0)
    assert (got["ok.png"]["w"], got["ok.png"]["h"], got["ok.png"]["t"], got["ok.png"]["seed"]) == (300, 900, 1.0, 7)
    assert got["bad.gif"]["format"] is None
    ok, bad = scan.gated(scan.media_files(spark, str(tmp_path)), headers.sizes(read))
    assert {r["n"] for r in ok.select(name.alias("n")).collect()} == {"a.jpg", "ok.png", "huge.jpg"}
    assert {r["n"] for r in bad.select(name.alias("n")).collect()} == {"small.png", "bad.gif", "tiny.jpg"}
