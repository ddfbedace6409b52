"""Work in tasks by bytes and not by rows: slices of batches, and the same results however pieces and slices are cut."""

import random

import numpy as np
import pyarrow as pa
import pytest

from helixframe.functions import batches
from helixframe.functions import dna as D
from helixframe.operators import sketch


def sequences(spark, seed=3, most=400):
    rnd = random.Random(seed)
    texts = ["", None, "A", "AC" * 60, "A" * 130] + ["".join(rnd.choice("ACGT"[: rnd.randint(1, 4)]) for _ in range(rnd.randrange(most))) for _ in range(20)]
    return spark.createDataFrame(list(enumerate(texts)), "seq_id long, dna string").repartition(2), texts


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_batches_are_cut_by_bytes():
    rules = pa.array([[{"rule_id": 1, "symbols": [1, 2]}] * k for k in range(9)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(["x" * 1000 * k for k in range(9)]), rules], ["a", "b", "c"])
    parts = list(batches.bounded([batch, batch.slice(2, 3), batch.slice(0, 0)], 9000))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist() + batch.slice(2, 3).to_pylist()
    assert len(parts) > 7 and all(sum(map(len, p.column("b").to_pylist())) <= 9000 for p in parts)


@pytest.mark.parametrize("k", [1, 3, 8, 13, 31, 40, 64])
def test_window_hashes(k):
    raw = np.random.RandomState(k).choice(np.frombuffer(b"ACGT", np.uint8), 150).astype(np.int64)
    want = []
    for i in range(len(raw) - k + 1):
        h = 0
        for x in raw[i : i + k].tolist():
            h = (h * 101 + x) % 1_000_000_007
        want.append(h)
    assert sketch.window_hashes(raw, k).tolist() == want
    assert sketch.window_hashes(raw[: k - 1], k).tolist() == []


@pytest.mark.parametrize("k", [4, 40])
def test_rolling_hashes_need_no_kmers(spark, k):
    seqs, texts = sequences(spark)
    want = {}
    for t in texts:
        for h in sketch.window_hashes(np.frombuffer((t or "").encode(), np.uint8).astype(np.int64), k).tolist():
            want[h] = want.get(h, 0) + 1
    found = sketch.rolling_hash_counts(seqs, k, size=50)
    assert rows(found) == sorted((h, n) for h, n in want.items() if n >= 2)
    assert "Generate" in (plan := found._jdf.queryExecution().toString()) and "kmer" not in plan


def test_bases_of_texts_as_normalized(spark):
    from helixframe.sources import fasta

    odd = [None, "", "xyz", "acgtACGT", "aāc\U0001F600g\ntÁÇ", "\x00A\x00", "é" * 5 + "T"] * 3
    table = spark.createDataFrame(list(enumerate(odd)), "doc_id int, text string").repartition(1)
    want = rows(table.selectExpr("doc_id", "coalesce(text, '') t").select("doc_id", D.normalize("t")))
    assert rows(fasta.from_table(table)) == want
    assert fasta.from_table(table).schema["seq_id"].dataType == table.schema["doc_id"].dataType
    assert rows(fasta.from_table(table.limit(0))) == []
    assert fasta.bases_of(pa.array(odd).slice(3, 2)).to_pylist() == ["ACGTACGT", "ACGT"]


@pytest.mark.parametrize("w", [1, 8, 33])
def test_window_fingerprints_over_pieces(spark, w):
    seqs, texts = sequences(spark)
    want = [(s, i, int(D.fx_hashes([D._codes(t[i : i + w])])[0])) for s, t in enumerate(texts) for i in range(len(t or "") - w + 1)]
    found = sketch.window_fingerprints(seqs, w, size=50)
    assert rows(found) == sorted(want)
    assert "ArrowEvalPython" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("k", [2, 3, 4, 5])
@pytest.mark.parametrize("either", [False, True])
def test_kmers_side_by_side_make_the_same_rules(k, either):
    from helixframe.operators import repair as R

    rnd = random.Random(k)
    found = [np.array([rnd.randrange(rnd.randint(1, 4)) for _ in range(n)], np.int64) for n in [0, 1, 3, *range(4, 90), 300, 500, 700]]
    found += [np.zeros(200, np.int64), np.array([0, 3] * 100), np.array([0, 1, 2, 3, 0, 1, 2] * 30)]
    for most in (None, 3):
        many = R.replace_many([x.copy() for x in found], k, np.full(len(found), 2), most, either, k > 2)
        for x, (symbols, rules) in zip(found, many):
            if k == 2:
                final, want = R.repair(x.tolist(), 2, most, either)
                want = [([a, b], used, n) for a, b, used, n in want]
            else:
                final, want = R.replace_kmers(x.tolist(), k, 2, most, either)
            assert symbols.tolist() == final
            assert [(r[:-2], r[-2], r[-1]) for r in rules.tolist()] == want


def test_wide_windows_are_built_one_by_one(spark):
    from helixframe.operators import grammar, repair as R

    assert R.fits_many(1000, 4096, 4) and not R.fits_many(1000, 4096, 9)
    seqs, texts = sequences(spark)
    assert rows(grammar.expand(R.build(seqs, kmer=9))) == [(k, t or "") for k, t in enumerate(texts)]


def test_suffixes_of_short_sequences_need_no_exchange(spark):
    from helixframe.operators import suffixes

    rnd = random.Random(5)
    block = "".join(rnd.choice("ACGT") for _ in range(90))
    texts = ["", None, "A", "A" * 700, "ACGT" * 40, block + "C" + block + "GG" + block[:60] + block] + ["".join(rnd.choice("ACGT"[: rnd.randint(1, 4)]) for _ in range(rnd.randrange(200))) for _ in range(40)]
    seqs = spark.createDataFrame(list(enumerate(texts)), "seq_id long, dna string").repartition(2)
    found = suffixes.suffix_arrays(seqs)
    want = [(k, r, i) for k, t in enumerate(texts) for r, i in enumerate(sorted(range(len(t or "")), key=lambda i: t[i:]))]
    assert rows(found) == want
    assert rows(suffixes.suffix_arrays(seqs, size=60)) == want
    whole = suffixes.repeats_from(seqs, 3)
    assert rows(whole) == rows(suffixes.repeats_over_ranges(seqs, 3, size=60)) == rows(suffixes.repeats_from(seqs, 3, size=60))
    for df in (found, whole):
        assert "rangepartitioning" not in df._jdf.queryExecution().toString()


def test_most_bytes_do_not_change_results(spark, monkeypatch):
    from helixframe.operators import grammar, lcg, parsing, repair as R

    seqs, texts = sequences(spark)
    built = [R.build(seqs), R.build(seqs, kmer=4, either_strand=True), lcg.build(seqs), parsing.grammar_rows(*parsing.build_spread(seqs))]
    want = [rows(grammar.explode_rules(b)) for b in built]
    texts_of = [(k, t or "") for k, t in enumerate(texts)]
    assert all(rows(grammar.expand(grammar.simplify(b))) == (texts_of if n < 3 else [x for x in texts_of if x[1]]) for n, b in enumerate(built))
    single = [grammar.explode_rules(R.build(seqs.where(f"seq_id = {k}"))).collect() for k in (7, 12)]
    assert [sorted(map(tuple, s)) for s in single] == [[r for r in want[0] if r[0] == k] for k in (7, 12)]


def test_large_grammars_go_by_rounds_of_joins(spark):
    from helixframe.operators import grammar, repair as R

    seqs, _ = sequences(spark)
    built = R.build(seqs)
    rules = grammar.explode_rules(built)
    want = rows(grammar.analyze(built).select("seq_id", "rule_id", "depth", "expanded_length", "assembly_index"))
    in_tasks = grammar.rule_levels(rules)
    assert rows(in_tasks) == rows(grammar.rule_levels(rules, 3)) == want
    missing = spark.createDataFrame([(1, 0, [0, 9])], "seq_id long, rule_id long, symbols array<long>")
    with pytest.raises(grammar.GrammarError):
        grammar.rule_levels(missing)


def test_edges_need_no_join(spark):
    from helixframe.operators import repair as R
    from helixframe.sources import export

    built = R.build(sequences(spark)[0])
    edges, shallow = export.graph_edges(built), export.graph_edges(built, 1, False)
    assert "Join" not in edges._jdf.queryExecution().toString()
    for found, nodes in ((edges, export.graph_nodes(built)), (shallow, export.graph_nodes(built, 1, False))):
        known = {(r.seq_id, r.id) for r in nodes.collect()}
        assert all((r.seq_id, r.source) in known and (r.seq_id, r.target) in known for r in found.collect())
