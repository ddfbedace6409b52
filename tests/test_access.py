"""Ranges and depths of grammars against their expansions; hashes of rules against texts."""

import random

import pytest

from helixframe.operators import access, grammar, repair

SCHEMA = "seq_id long, dna string"


def built(spark, texts, **options):
    return repair.build(spark.createDataFrame(list(enumerate(texts)), SCHEMA), **options)


def random_texts(seed, n=12):
    rnd = random.Random(seed)
    block = "".join(rnd.choice("ACGT") for _ in range(50))
    return ["", "A", block * 5] + ["".join(rnd.choice([block[:9], "A", "CG", block[9:30]]) for _ in range(rnd.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("either", [False, True])
def test_ranges(spark, either):
    rnd, texts = random.Random(1), random_texts(2)
    ranges = [(k, a, a + rnd.randrange(60)) for k, t in enumerate(texts) for a in (rnd.randrange(-5, len(t) + 5) for _ in range(6))] + [(99, 0, 5), (2, 3, 9), (2, 3, 9)]
    grammars = built(spark, texts, either_strand=either)
    found = sorted((r.seq_id, r.start, r.stop, r.dna) for r in access.expand_ranges(grammars, spark.createDataFrame(ranges, "seq_id long, start long, stop long")).collect())
    assert found == sorted((k, a, b, texts[k][max(a, 0) : max(b, 0)]) for k, a, b in ranges if k < 99)


def test_a_range_opens_few_rules_and_knows_its_strand():
    text = "ACGTTGCA" * 512
    symbols, rules = repair.repair(["ACGT".index(c) for c in text])
    reader = access.Reader(symbols, {r: [a, b] for r, (a, b, _, _) in enumerate(rules)})
    assert reader.range(2000, 2010)[0] == text[2000:2010] and reader.opened < 40
    forth_and_back = access.Reader([4, -5], {0: [0, 1, 1]})
    assert forth_and_back.range(0, 6) == ("ACCGGT", "+++---") and forth_and_back.range(2, 4) == ("CG", "+-")
    assert forth_and_back.range(6, 9) == ("", "") and access.Reader([], {}).range(0, 5) == ("", "")


def test_depths(spark):
    bodies = {0: [0, 1], 1: [4, 2], 2: [5, -5]}
    assert access.opened_symbols([6, 3, -6], bodies, 0) == [6, 3, -6]
    assert access.opened_symbols([6, 3, -6], bodies, 1) == [5, -5, 3, 1, -5]
    texts = random_texts(3)
    whole = {r.seq_id: r.symbols for r in access.expand_to_depth(built(spark, texts, either_strand=True), 100).collect()}
    assert {k: "".join("ACGT"[s] for s in x) for k, x in whole.items()} == dict(enumerate(texts))
    with pytest.raises(ValueError):
        access.expand_to_depth(built(spark, texts), -1)


def test_hashes_are_equal_where_texts_are(spark):
    back = str.maketrans("ACGT", "TGCA")
    by_text, by_hash = {}, {}
    for k, text in enumerate(random_texts(5, 40)):
        symbols, rules = repair.repair(["ACGT".index(c) for c in text], either_strand=True)
        bodies = {r: [a, b] for r, (a, b, _, _) in enumerate(rules)}
        texts = grammar.expand_all(bodies)
        for r, (n, *prints) in grammar.content_of(bodies).items():
            assert n == len(texts[r])
            by_text.setdefault(texts[r], set()).add((*prints[:2],))
            by_text.setdefault(texts[r][::-1].translate(back), set()).add((*prints[2:],))
            by_hash.setdefault((n, *prints[:2]), set()).add(texts[r])
            assert grammar.expansion(4 + r, bodies) == texts[r] and grammar.expansion(-5 - r, bodies) == texts[r][::-1].translate(back)
    assert len(by_text) > 50 and all(len(x) == 1 for x in [*by_text.values(), *by_hash.values()])


def test_merging_expands_nothing_but_one_rule_of_each_content(spark):
    texts = random_texts(7)
    plan = grammar.rule_contents(built(spark, texts), True, "seq_id")
    assert "dna" not in plan.columns
    rules, origins = grammar.merge_grammars(built(spark, texts, either_strand=True), True)
    rows = rules.collect()
    back = str.maketrans("ACGT", "TGCA")
    assert [r.dna for r in sorted(rows, key=lambda r: r.rule_id)] == sorted((r.dna for r in rows), key=lambda t: (len(t), t))
    assert all(r.dna <= r.dna[::-1].translate(back) and r.expanded_length == len(r.dna) for r in rows)
    names = {r.rule_id: r.dna for r in rows}
    known = {(r.seq_id, r.rule_id): r.dna for r in grammar.expand_rules(built(spark, texts, either_strand=True)).collect()}
    for o in origins.collect():
        dna = names[o.rule_id]
        assert known[o.seq_id, o.old_rule_id] == (dna[::-1].translate(back) if o.flipped else dna)
    assert origins.count() == len(known)


def test_merged_chunks_as_rows(spark):
    texts = random_texts(9)
    chunks = repair.build_chunked(spark.createDataFrame([(k, t * 3) for k, t in enumerate(texts)], SCHEMA), 40, either_strand=True)
    symbols, rules = grammar.merge_chunk_tables(chunks, True)
    bodies = {}
    for r in rules.collect():
        bodies.setdefault(r.seq_id, {})[r.rule_id] = r.symbols
    parts = {}
    for r in symbols.collect():
        parts.setdefault(r.seq_id, []).append((r.idx, "".join(grammar.expansion(s, bodies.get(r.seq_id, {})) for s in r.symbols)))
    assert {k: "".join(t for _, t in sorted(p)) for k, p in parts.items()} == {k: t * 3 for k, t in enumerate(texts)}
    assert all(sorted(b) == list(range(len(b))) and all(abs(s) < 5 + r for r, body in b.items() for s in body) for b in bodies.values())
    row = {r.seq_id: r.dna for r in grammar.expand(grammar.merge_chunks(chunks, True)).collect()}
    assert row == {k: t * 3 for k, t in enumerate(texts)}
