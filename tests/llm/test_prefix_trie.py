import hashlib
import zlib
from collections import defaultdict

import pytest

from fathom.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, node long, depth long, pos string, digest string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    base = {c: c - (c % 100 if c >= 0 else -(-c % 100)) for c in own}
    made = {c: own.get(base[c], [])[: h[c]] + own[c][h[c] :] for c in own}
    nodes = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for k in nodes:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = (len(nodes[k]) - 1) * (len(k[-1][1].decode()) if k else 0) + sum(saved[x] for x in children[k])
    out = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(made[c]) == len(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(children[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], SCHEMA).repartition(parts)


def dense():
    """Conversations that share prefixes of many lengths, copies among them, with nulls, ties and odd texts."""
    rows = []
    for c in range(0, 1300, 3):
        kind = c % 7
        for t in range(1 + (c * 5) % 9):
            rows.append((c, t, "user" if t % 2 == 0 else None, f"t{t}" if t < kind else f"t{t} of {c % 11}"))
    for c in range(2000, 2090):
        rows += [(c, t, "user", "same") for t in range(12)]
    rows += [(-205, None, None, None), (-205, 1, "a", ""), (-205, 1, "a", ""), (-200, 3, "b", "é😀"), (-200, 3, "a", "z"), (None, 0, "user", "lost"), (5001, 0, "u", "x")]
    rows += [(9_000_000_000, t, "user", "x" * t) for t in range(4)] + [(9_000_000_017, t, "user", "x" * t) for t in range(4)]
    return rows


@pytest.mark.parametrize("hot,parts", [(4, 5), (10_000, 1)])
def test_equals_brute_force(spark, hot, parts):
    rows = dense()
    assert rows_of(pt.prefix_trie(frame(spark, rows, parts), hot=hot)) == brute(rows)


def test_defined_cases(spark):
    assert pt.prefix_trie(frame(spark, [(1, 1, "a", "b")]).limit(0)).count() == 0
    assert pt.prefix_trie(frame(spark, [(None, 1, "a", "b")])).count() == 0
    one = [(7, t, "a", "b" * t) for t in range(9)]
    assert rows_of(pt.prefix_trie(frame(spark, one))) == brute(one)
    turnless = [c for c in range(1, 90) if zlib.crc32(str(c).encode()) % 6 >= 2][:3]  # heads of a base that is not there
    rows = [(c, 0, "a", "b") for c in turnless]
    got = rows_of(pt.prefix_trie(frame(spark, rows)))
    assert got == brute(rows) and len(got) == 1 and got[0][3] == 3


def test_one_conversation_with_most_rows(spark):
    """A conversation of many turns is numbered over several ranges, and its tail takes no rounds."""
    rows = [(c, t, "user", f"{c} {t}") for c in range(20) for t in range(3)] + [(42, t, "user", f"turn {t}") for t in range(3000)]
    from fathom.plans.scratch import Scratch

    scratch = Scratch(spark, "test")
    df = frame(spark, rows, 6)
    ranges = pt.numbered_turns(df, scratch)
    assert sorted(r["pos"] for r in ranges.where("conv = 42").collect()) == list(range(1, 3001))
    lengths, turns = pt.rebuilt(ranges, scratch)
    assert pt.refine(lengths, turns, scratch)[2] <= 7
    assert rows_of(pt.prefix_trie(df)) == brute(rows)


def test_digest_of_many_ends(spark):
    """The ids of a node meet as strings of bounded length; their digest is that of all ids in numeric order."""
    ids = [*range(-1500, 1500, 7), 1 << 40, -(1 << 62)]
    df = spark.createDataFrame([(d, d * 10, c) for d in (0, 3) for c in ids], "depth long, node long, conv long").repartition(7)
    want = hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    assert sorted(map(tuple, pt.end_digests(df, chunk=64).collect())) == [(0, 0, want), (3, 30, want)]
