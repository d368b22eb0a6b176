"""Archives written by many tasks, opened by the standard reader."""

import os
import zipfile

import pytest

from fathom.operators import archive


def selection(spark, tmp_path):
    """Files of all kinds, and rows that are not to be in an archive."""
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    bodies = {"a.jpg": b"x" * 5000, "b.mp4": os.urandom(3000), "empty.png": b"", "été ☂.jpg": b"words " * 900, "sub/a.jpg": b"another", "large.webp": bytes(range(256)) * 9000}
    bodies |= {f"n{i}.gif": b"%d" % i * i for i in range(60)}
    for n, body in bodies.items():
        (root / n).write_bytes(body)
    (tmp_path / "out.jpg").write_bytes(b"outside")
    os.symlink(root / "a.jpg", root / "link.jpg")
    os.utime(root / "a.jpg", (86400, 86400))
    names = [*bodies, "a.jpg"]
    rows = [(i, str(root / n)) for i, n in enumerate(names)]
    odd = [(900, str(tmp_path / "out.jpg")), (901, str(root / "link.jpg")), (902, str(root / "lost.jpg")), (903, None)]
    return spark.createDataFrame(rows + odd, "id long, path string"), str(root), [(os.path.basename(n), bodies[n]) for n in names]


@pytest.mark.parametrize("plain", [archive.PLAIN, 1000])
def test_members_in_order_with_their_bytes(spark, tmp_path, plain):
    rows, root, want = selection(spark, tmp_path)
    dest = str(tmp_path / "own.zip")
    got = {r["id"]: r["state"] for r in archive.write_archive(rows, dest, [root], tasks=7, plain=plain).collect()}
    assert {got[i] for i in range(len(want))} == {"done"} and [got[i] for i in range(900, 904)] == ["denied", "denied", "missing", "missing"]
    with zipfile.ZipFile(dest) as z:
        assert z.testzip() is None
        assert [(i.filename, z.open(i).read()) for i in z.infolist()] == want
        assert {i.filename for i in z.infolist() if i.compress_type == zipfile.ZIP_STORED} == {"b.mp4"}
        assert z.getinfo("b.mp4").date_time[0] >= 2020 and z.infolist()[0].date_time == (1980, 1, 1, 0, 0, 0)
        sizes = sorted((i.header_offset, 30 + len(i.filename.encode()) + 20 * (plain == 1000) + i.compress_size) for i in z.infolist())
        assert all(a + n == b for (a, n), (b, _) in zip(sizes, sizes[1:]))
    assert sorted(os.listdir(tmp_path)) == ["in", "out.jpg", "own.zip"]


def test_too_large_empty_and_unreadable(spark, tmp_path, monkeypatch):
    rows, root, want = selection(spark, tmp_path)
    dest = str(tmp_path / "own.zip")
    total = sum(len(b) for _, b in want)
    with pytest.raises(archive.TooLarge):
        archive.write_archive(rows, dest, [root], most_bytes=total - 1)
    assert not os.path.exists(dest)
    assert archive.write_archive(rows.limit(0), dest, [root]).count() == 0
    assert zipfile.ZipFile(dest).namelist() == []
    archive.write_archive(rows, dest, [root], most_bytes=total)
    assert len(zipfile.ZipFile(dest).namelist()) == len(want)


def test_a_second_attempt_changes_nothing(tmp_path):
    """Packing and placing once more, as after a lost task, gives the same bytes."""
    import pandas as pd

    source = tmp_path / "a.jpg"
    source.write_bytes(b"body " * 500)
    frame = pd.DataFrame([(1, str(source), "a.jpg", "ready", False)], columns=["id", "source", "name", "state", "video"])
    packed = next(archive._packing(str(tmp_path))(iter([frame]))).assign(entry_at=0, record_at=0)
    packed["record_at"] = 30 + 5 + packed["packed"]
    draft = str(tmp_path / "d.zip")
    seen = set()
    for _ in range(2):
        list(archive._placing(draft, False)(iter([packed])))
        archive._close(draft, 1, int(packed["record_at"][0]), 46 + 5, False)
        seen.add(open(draft, "rb").read())
    assert len(seen) == 1 and zipfile.ZipFile(draft).read("a.jpg") == source.read_bytes()
