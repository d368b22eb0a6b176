"""Journals of file operations: what is planned, what is done, and a run that is killed half-way."""

import os

import pytest
from pyspark.sql import functions as F

from fathom.operators import transfers
from fathom.operators.transfers import Transfers


def made(folder, names):
    os.makedirs(folder, exist_ok=True)
    for n in names:
        with open(f"{folder}/{n}", "w") as f:
            f.write(f"body of {n}")


def asked(spark, rows):
    return spark.createDataFrame(rows, "id long, source string, dest string")


def tree(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f)).read() for d, _, files in os.walk(root) for f in files}


def states(df):
    return {r["id"]: r["state"] for r in df.collect()}


def by_hand(rows, op):
    """A walk through the rows, one after the other."""
    gone, used, out = set(), set(), {}
    for i, s, d, found, allowed, taken in sorted(rows):
        if not allowed:
            out[i] = "denied"
        elif not found or s in gone:
            out[i] = "missing"
        elif op == "move" and os.path.dirname(s) == os.path.dirname(d):
            out[i] = "same"
        elif taken or d in used:
            out[i] = "exists"
        else:
            out[i] = "ready"
            used |= {d} - {None}
            gone |= {s} if op in transfers.LEAVING else set()
    return out


@pytest.mark.parametrize("op", transfers.OPS)
def test_states_are_those_of_a_walk(spark, op):
    rows = []
    for i in range(300):
        k = i * 7919 % 90
        dest = None if op == "unlink" else f"/out/{k % 40}" if k % 11 else f"/in/x{k}"
        rows.append((i, f"/in/{k}", dest, k % 7 != 0, k % 9 != 0, op != "unlink" and k % 40 % 5 == 0))
    df = spark.createDataFrame(rows, "id long, source string, dest string, found boolean, allowed boolean, taken boolean")
    assert states(transfers.resolved(df, op)) == by_hand(rows, op)
    assert transfers.resolved(df.limit(0), op).count() == 0


def test_export_with_side_files_and_errors(spark, tmp_path):
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    made(root, ["a.jpg", "a.txt", "a.json", "b.jpg", "c.jpg"])
    made(out, ["c.jpg"])
    made(str(tmp_path / "else"), ["x.jpg"])
    os.symlink(f"{root}/b.jpg", f"{root}/link.jpg")
    rows = [(0, f"{root}/a.jpg", f"{out}/a.jpg"), (1, f"{root}/lost.jpg", f"{out}/lost.jpg"), (2, f"{root}/c.jpg", f"{out}/c.jpg"), (3, f"{tmp_path}/else/x.jpg", f"{out}/x.jpg"), (4, f"{root}/link.jpg", f"{out}/l.jpg"), (5, f"{root}/b.jpg", f"{tmp_path}/plain/b.jpg"), (6, None, f"{out}/n.jpg")]
    made(str(tmp_path), ["plain"])
    journal = Transfers(spark, str(tmp_path / "journal"))
    journal.plan(asked(spark, rows), "export", [root])
    got = journal.run(3)
    assert states(got) == {0: "done", 1: "missing", 2: "exists", 3: "denied", 4: "denied", 5: "failed", 6: "missing"}
    assert got.where("state = 'failed'").first()["error"].startswith(("NotADirectoryError", "FileExistsError"))
    assert tree(out) == {"a.jpg": "body of a.jpg", "a.txt": "body of a.txt", "a.json": "body of a.json", "c.jpg": "body of c.jpg"}
    assert sorted(os.listdir(out)) == ["a.jpg", "a.json", "a.txt", "c.jpg"]


@pytest.mark.parametrize("op", ["copy", "move", "trash", "unlink"])
def test_killed_run_ends_like_an_undisturbed_one(spark, tmp_path, op):
    def world(name):
        root = str(tmp_path / name)
        made(f"{root}/in", [f"{i}.jpg" for i in range(24)])
        made(f"{root}/out", ["3.jpg"])
        rows = [(i, f"{root}/in/{i}.jpg", None if op == "unlink" else f"{root}/out/{i}.jpg") for i in range(24)]
        journal = Transfers(spark, f"{root}/journal")
        journal.plan(asked(spark, rows), op, [f"{root}/in"])
        return root, rows, journal

    calm, _, one = world("calm")
    done = states(one.run(3))
    root, rows, two = world("killed")
    # what a killed run leaves: some rows done, a move copied but not yet taken away, a half-written part
    for i, s, d in rows[:12]:
        if i != 3:
            transfers._done(op, s, d, os.path.getsize(s), f"{two.mark}/{i}-0")
    if op in ("move", "trash"):
        made(f"{root}/in", ["5.jpg"])
    if op != "unlink":
        made(f"{root}/out/{two.mark}", ["13-0"])
    two.plan(asked(spark, rows[:2]), op, [f"{root}/in"])
    assert states(two.run(3)) == done
    assert {d: tree(f"{root}/{d}") for d in ("in", "out")} == {d: tree(f"{calm}/{d}") for d in ("in", "out")}
    assert states(two.run(3)) == done
    assert done[3] == ("done" if op == "unlink" else "exists") and sum(s == "done" for s in done.values()) == (24 if op == "unlink" else 23)


def test_index_after_a_journal(spark):
    index = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "filename string, n int")
    out = lambda op: spark.createDataFrame([(0, "a", "z/a", op, "done"), (1, "b", "z/b", op, "exists")], "id long, source string, dest string, op string, state string")
    names = lambda op: sorted(r["filename"] for r in transfers.after(index, out(op)).collect())
    assert names("move") == ["b", "c", "z/a"] and names("trash") == names("unlink") == ["b", "c"] and names("copy") == ["a", "b", "c"]
    assert transfers.after(index, out("move")).where(F.col("filename") == "z/a").first()["n"] == 1
