"""Suffix order, common prefixes and repeats against sorting and brute force, over several ranges."""

import random

import pytest

from helixframe.operators import suffixes


@pytest.fixture
def ranges(spark):
    """Many ranges, so that groups and intervals run over their borders."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(old, ("5", "false")):
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def texts():
    rnd = random.Random(16)
    block = "".join(rnd.choice("ACGT") for _ in range(90))
    out = ["", None, "A", "AAAA", "A" * 150, "ACGT" * 40, block + "C" + block + "GG" + block[:60] + block, ("ACGTTGCA" * 9 + "A" * 37) * 2]
    return out + ["".join(rnd.choice("ACGT"[: rnd.randint(1, 4)]) for _ in range(rnd.randrange(60))) for _ in range(12)]


def common(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def brute_repeats(text, shortest, least):
    """Substrings that occur often enough, but for those always followed by one base."""
    places, out = {}, set()
    for i in range(len(text)):
        for j in range(i + shortest, len(text) + 1):
            places.setdefault(text[i:j], []).append(i)
    for rep, at in places.items():
        after = {text[i + len(rep) : i + len(rep) + 1] for i in at}
        if len(at) >= least and (len(after) > 1 or after == {""}):
            out.add((len(rep), len(at), min(at)))
    return out


def test_neighbours_in_order(ranges):
    rows = list(enumerate(texts()))
    found = {}
    for r in suffixes.neighbours(ranges.createDataFrame(rows, "seq_id long, dna string"), size=23).collect():
        found.setdefault(r.seq_id, {})[r.rank] = (r.pos, r.lcp)
    for k, text in rows:
        text = text or ""
        order = sorted(range(len(text)), key=lambda i: text[i:])
        assert found.get(k, {}) == {r: (i, common(text[order[r - 1] :], text[i:]) if r else 0) for r, i in enumerate(order)}


@pytest.mark.parametrize("shortest,least", [(1, 2), (2, 3), (30, 2)])
def test_repeats_of_any_length(ranges, shortest, least):
    rows = list(enumerate(texts()))
    found = {}
    for r in suffixes.repeats_from(ranges.createDataFrame(rows, "seq_id long, dna string"), shortest, least, size=23).collect():
        found.setdefault(r.seq_id, []).append((r.length, r.n, r.pos))
    for k, text in rows:
        assert sorted(found.get(k, [])) == sorted(brute_repeats(text or "", shortest, least))


def test_nothing_to_order(spark):
    none = spark.createDataFrame([(1, ""), (2, None)], "seq_id long, dna string")
    assert suffixes.suffix_arrays(none).count() == 0 and suffixes.repeats_from(none, 2).count() == 0
