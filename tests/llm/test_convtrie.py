"""The trie of conversations against brute force."""

import hashlib
import random
import zlib

import pytest

from helixframe.llm import convtrie
from helixframe.llm.common import Scratch
from helixframe.llm.convtrie import Stitch, Sweep, prefix_trie, shared_openings, turn_arrays, turn_texts

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(convs):
    """convs: id to a list of (turn, size)."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {node: [x for x in members if len(x) == len(node) + 1 and x[: len(node)] == node] for node in members}
    out = []
    for node, m in members.items():
        below = [x for x in members if x[: len(node)] == node]
        ends = sorted(c for c in m if len(convs[c]) == len(node))
        saved = sum((len(members[x]) - 1) * (x[-1][1] if x else 0) for x in below)
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids[node]), sum(not kids[x] for x in below), saved, digest))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(6))
def test_ranges_joined_equal_brute_force(monkeypatch, seed):
    rnd = random.Random(seed)
    for _ in range(150):
        monkeypatch.setattr(convtrie, "IDS_A_ROW", rnd.choice([1, 2, 3, 100]))
        convs = {c: [(k, ord(k) % 7) for k in (rnd.choice("abc" if rnd.random() < 0.3 else "a") for _ in range(rnd.randint(0, 4)))] for c in rnd.sample(range(200), rnd.randint(1, 14))}
        order = sorted(convs, key=lambda c: (convs[c], c))
        cuts = sorted(rnd.randint(0, len(order)) for _ in range(rnd.randint(0, 5)))
        nodes, edges, whole = [], [], Stitch()
        for i, part in enumerate(order[a:b] for a, b in zip([0, *cuts], [*cuts, len(order)])):
            sweep = Sweep(i)
            for c in part:
                sweep.take(c, [k.encode() for k, _ in convs[c]], [n for _, n in convs[c]])
            sweep.finish()
            nodes += sweep.out
            edges += sweep.edges
        for e in sorted(edges, key=lambda e: (e["part"], e["place"])):
            whole.take({"ids": None, **e})
        whole.finish()
        nodes += whole.out
        known = {r[:2]: r[4] for r in nodes}
        got = [(r[4], r[5], known[r[2:4]] if r[2] is not None else None, *r[6:11]) for r in nodes if r[5] is not None]
        assert sorted(got, key=repr) == brute(convs)


def table(spark, rows):
    return spark.createDataFrame([(*r, b"k", 1) for r in rows], "conv_id long, turn long, role string, text string, key binary, size long")


def found(spark, arrays):
    with Scratch(spark) as scratch:
        nodes = prefix_trie(arrays, scratch)
    return sorted((tuple(r) for r in nodes.select(COLUMNS).collect()), key=repr)


def test_defined_cases(spark):
    rows = [(1, None, "u", "a"), (1, 0, None, None), (2, 0, "", ""), (2, None, "u", "a"), (3, 5, "u", "ab"), (3, 5, "u", "ab"), (4, 1, "u", "a"), (None, 1, "u", "lost"), (5, 1, "ua", "")]
    convs = {1: [("u:a", 1), (":", 0)], 2: [("u:a", 1), (":", 0)], 3: [("u:ab", 2)] * 2, 4: [("u:a", 1)], 5: [("ua:", 0)]}
    assert found(spark, turn_arrays(table(spark, rows))) == brute(convs)
    assert found(spark, turn_arrays(table(spark, rows).limit(0))) == []
    assert turn_texts(table(spark, rows)).count() == 5


def test_long_and_common_conversations(spark):
    rnd, rows, convs = random.Random(2), [], {}
    for c in range(120):
        n = 300 if c == 7 else rnd.choice([0, 1, 2, 40])
        convs[c] = [("u:hello", 5)] * min(n, 30) + [(f"u:{rnd.randint(0, 1)}", 1) for _ in range(n - 30)]
        rows += [(c, i, "u", t[2:]) for i, (t, _) in enumerate(convs[c])]
    convs = {c: t for c, t in convs.items() if t}
    assert found(spark, turn_arrays(table(spark, rows))) == brute(convs)


def test_openings_taken_over(spark):
    rows = [(c, i, "u", f"{c}:{i}") for c in [0, 3, 7, 99, 100, 101, 205, 301] for i in range(c % 4 + 1)]
    own = {}
    for c, i, _, text in rows:
        own.setdefault(c, []).append((f"u:{text}", len(text)))
    want = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        want[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    assert any(not t for t in want.values())
    assert found(spark, shared_openings(turn_arrays(table(spark, rows)))) == brute(want)
