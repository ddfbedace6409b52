"""Parsing over pieces against parsing in one task, whatever the pieces."""

import random

import pytest

from helixframe.operators import lcg, parsing

SCHEMA = "seq_id long, dna string"


def texts(seed):
    rnd = random.Random(seed)
    block = "".join(rnd.choice("ACGT") for _ in range(90))
    out = ["", None, "A", "A" * 150, ("ACGTTGCA" * 9 + "A" * 37) * 3, block + "C" + block + "GG" + block[:60] + block]
    return out + ["".join(rnd.choice("ACGT" if k % 3 else "AC") for _ in range(rnd.choice([1, 2, 5, 50, 220]))) for k in range(9)]


def codes(dna):
    return ["ACGT".index(c) for c in dna or ""]


@pytest.mark.parametrize("window,shortest,longest,size", [(4, 2, 8, 16), (8, 2, 256, 300), (3, 2, 5, 9), (1, 3, 7, 8)])
def test_phrases_equal_those_of_one_task(spark, window, shortest, longest, size):
    rows = list(enumerate(texts(size)))
    found = sorted(map(tuple, parsing.phrases(spark.createDataFrame(rows, SCHEMA), window, shortest, longest, size).select("seq_id", "start", "len", "content").collect()))
    want = []
    for k, dna in rows:
        begins = lcg.cuts(codes(dna), window, shortest, longest)
        want += [(k, a, b - a, dna[a:b]) for a, b in zip(begins, [*begins[1:], len(dna or "")])]
    assert found == sorted(want)


@pytest.mark.parametrize("window,shortest,longest,size", [(4, 2, 8, 16)])
def test_grammars_equal_those_of_one_task(spark, window, shortest, longest, size):
    rows = list(enumerate(texts(3)))
    held, made = parsing.build_spread(spark.createDataFrame(rows, SCHEMA), window, shortest, longest, 2, size)
    symbols, rules = {}, {}
    for r in sorted(held.collect(), key=lambda r: (r.seq_id, r.piece)):
        symbols.setdefault(r.seq_id, []).extend(r.symbols)
    for r in sorted(made.collect(), key=lambda r: (r.seq_id, r.rule_id)):
        rules.setdefault(r.seq_id, []).append((r.rule_id, r.symbols, r.used))
    assert any(s >= 4 for body in rules.values() for _, b, _ in body for s in b)  # rules of rules
    for k, dna in rows:
        final, want = lcg.lcg(codes(dna), window, shortest, longest, 2)
        assert symbols.get(k, []) == final
        assert rules.get(k, []) == [(r, body, used) for r, (body, used, _) in enumerate(want)]


def test_distances_settle():
    begins = parsing.Begins([0, 3, 4, 30], 40, 2, 8)
    for distance, left in enumerate(begins.left_with()):
        last = -distance
        for _, last in begins.walk(-distance):
            assert 0 <= last < 40
        assert left == 40 - last
    with pytest.raises(ValueError):
        parsing.check(8, 1, 256, 65_536)
