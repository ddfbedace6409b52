"""Rounds over pieces against the builder in one task and a plain form of the rounds."""

import random

import pytest

from helixframe.operators import repair, rounds

SCHEMA = "seq_id long, dna string"


def texts(seed):
    rnd = random.Random(seed)
    out = ["", None, "A", "AA", "AAA", "A" * 33, "ACGTTGCA" * 5 + "A" * 17 + "ACGTTGCA" * 3]
    return out + ["".join(rnd.choice("ACGT" if k % 2 else "AC") for _ in range(rnd.choice([2, 5, 50, 300]))) for k in range(12)]


def plain(dna, share, most, least=2):
    """The rounds on one list of symbols: (symbols, rules as (a, b, n, used))."""
    x, rules = ["ACGT".index(c) for c in dna or ""], []
    while True:
        n = {}
        for p in zip(x, x[1:]):
            n[p] = n.get(p, 0) + 1
        frequent = sorted((-c, p) for p, c in n.items() if c >= least and c * share >= max(n.values()))
        begins, ends, chosen = set(), set(), {}
        for c, (a, b) in frequent:
            if a not in ends and b not in begins and len(chosen) < most:
                begins.add(a)
                ends.add(b)
                chosen[a, b] = len(rules)
                rules.append([a, b, -c, 0])
        if not chosen:
            return x, [tuple(r) for r in rules]
        out, i = [], 0
        while i < len(x):
            rule = chosen.get(tuple(x[i : i + 2]))
            if rule is None:
                out.append(x[i])
                i += 1
            else:
                out.append(4 + rule)
                rules[rule][3] += 1
                i += 2
        x = out


def collected(held, rules):
    symbols, made = {}, {}
    for r in sorted(held.collect(), key=lambda r: (r.seq_id, r.piece)):
        symbols.setdefault(r.seq_id, []).extend(r.symbols)
    for r in sorted(rules.collect(), key=lambda r: (r.seq_id, r.rule_id)):
        assert r.rule_id == len(made.setdefault(r.seq_id, []))
        made[r.seq_id].append((r.a, r.b, r.n, r.used))
    return symbols, made


@pytest.mark.parametrize("size,share,most", [(3, 4, 20_000), (64, 4, 2), (65_536, 1_000_000, 20_000)])
def test_sets_equal_the_plain_form_whatever_the_pieces(spark, monkeypatch, size, share, most):
    monkeypatch.setattr(rounds, "MOST_A_ROUND", most)
    rows = list(enumerate(texts(size)))
    symbols, made = collected(*rounds.build_spread(spark.createDataFrame(rows, SCHEMA), share=share, size=size))
    for i, dna in rows:
        want = plain(dna, share, most)
        assert (symbols.get(i, []), made.get(i, [])) == want
        pairs = list(zip(want[0], want[0][1:]))
        assert len(pairs) == len(set(pairs))


def test_one_rule_a_round_equals_the_builder(spark):
    rows = list(enumerate(texts(1)))
    symbols, made = collected(*rounds.build_spread(spark.createDataFrame(rows, SCHEMA), share=None, rounds=5, size=16))
    for i, dna in rows:
        final, rules = repair.repair(["ACGT".index(c) for c in dna or ""], 2, 5)
        assert symbols.get(i, []) == final
        assert made.get(i, []) == [(a, b, n, used) for a, b, used, n in rules]


def test_nothing_to_do(spark):
    held, rules = rounds.build_spread(spark.createDataFrame([(1, ""), (2, None)], SCHEMA))
    assert held.count() == 0 and rules.count() == 0
    held, rules = rounds.build_spread(spark.createDataFrame([(1, "ACG")], SCHEMA))
    assert [r.symbols for r in held.collect()] == [[0, 1, 2]] and rules.count() == 0
    with pytest.raises(ValueError):
        rounds.build_spread(held, least=1)


def test_many_symbols_are_counted_by_sorting():
    import numpy as np

    x = np.array([3, 1 << 40, 3, 0])
    assert [c.tolist() for c in rounds.counted(x, x + 1, x)] == [[0, 3, 1 << 40], [1, 4, (1 << 40) + 1], [0, 3, 1 << 40], [1, 2, 1]]


def test_tables_of_rounds_go(spark, monkeypatch):
    import os

    from helixframe import shared

    places = []
    real = rounds.new_path
    monkeypatch.setattr(rounds, "new_path", lambda s: places.append(real(s)) or places[-1])
    rounds.build_spread(spark.createDataFrame(list(enumerate(texts(3))), SCHEMA))
    base = places[0].removeprefix("file://").removeprefix("file:")
    kept = sorted(os.listdir(base), key=lambda name: int(name.partition("=")[2]) if "=" in name else -1)
    assert all("kind=0" not in os.listdir(os.path.join(base, name)) for name in kept[:-1])
    shared.drop(spark, *places)
    assert not os.path.exists(base)
