"""Small cases of grammars, encodings and chunks."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixframe.functions import dna as D
from helixframe.operators import chunks, grammar, kmers, lcg, repair, sketch, stats
from helixframe.plans import catalogue
from helixframe.sources import export, fasta
from helixframe.streaming import counts

CODE = {c: k for k, c in enumerate("ACGT")}


def codes(text):
    return [CODE[c] for c in text]


def naive(symbols, least=2):
    rules = []
    while True:
        n = {}
        for pair in zip(symbols, symbols[1:]):
            n[pair] = n.get(pair, 0) + 1
        best = min(n, key=lambda p: (-n[p], p), default=None)
        if best is None or n[best] < least:
            return symbols, rules
        out, i, used = [], 0, 0
        while i < len(symbols):
            if tuple(symbols[i : i + 2]) == best:
                out.append(4 + len(rules))
                i, used = i + 2, used + 1
            else:
                out.append(symbols[i])
                i += 1
        rules.append((*best, used, n[best]))
        symbols = out


@pytest.mark.parametrize(
    "text, rules, final",
    [
        ("ACACAC", [(0, 1), (4, 4)], [5, 4]),
        ("AAAA", [(0, 0)], [4, 4]),
        ("ACGT", [], [0, 1, 2, 3]),
        ("GTGTGTACACAC", [(0, 1), (2, 3), (4, 4), (5, 5)], [7, 5, 6, 4]),
        ("ACGTACGTACGT", [(0, 1), (2, 3), (4, 5), (6, 6)], [7, 6]),
        ("AAAACCCC", [(0, 0), (1, 1)], [4, 4, 5, 5]),
        ("", [], []),
        ("A", [], [0]),
    ],
)
def test_repair_goldens(text, rules, final):
    got, made = repair.repair(codes(text))
    assert got == final and [r[:2] for r in made] == rules


def test_repair_equals_the_plain_form():
    rng = random.Random(3)
    for _ in range(200):
        text = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(60))]
        assert repair.repair(text) == naive(text)


def test_many_at_once_equal_one_by_one():
    import numpy as np

    rng = random.Random(24)
    for _ in range(30):
        texts = [[rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.choice([0, 1, 2, 5, 30, 120]))] for _ in range(rng.randrange(20))]
        least = [rng.choice([2, 2, 3]) for _ in texts]
        most = rng.choice([None, None, 0, 1, 4])
        got = repair.repair_many([np.array(t, np.int64) for t in texts], np.array(least, np.int64), most)
        for text, n, (final, rules) in zip(texts, least, got):
            assert (final.tolist(), [tuple(r) for r in rules.tolist()]) == repair.repair(text, n, most)


def test_expansion_of_any_order_of_rules():
    for bodies, symbols in (({0: [0, 1], 1: [4, -5]}, [5, -6, 3]), ({7: [0, 2], 3: [11, -12]}, [7, -8, 1]), ({1: [4, 4], 0: [1, 2]}, [5, -6])):
        texts = grammar.expand_all(bodies)
        assert grammar.Expander(bodies).text(symbols) == "".join(grammar.text_of(s, texts) for s in symbols)
    with pytest.raises(grammar.GrammarError):
        grammar.Expander({0: [5], 1: [4]})


def test_either_strand_expands_back():
    rng = random.Random(4)
    for _ in range(100):
        text = "".join(rng.choice("ACGT") for _ in range(rng.randrange(80)))
        final, rules = repair.repair(codes(text), either_strand=True)
        texts = grammar.expand_all({k: [a, b] for k, (a, b, *_) in enumerate(rules)})
        assert "".join(grammar.text_of(s, texts) for s in final) == text


@pytest.mark.parametrize("text, longest, window, final, rules", [
    ("ACACACACACACACAC", 8, 4, [5, 5, 5, 5], [([0, 1], 8), ([4, 4], 4)]),
    ("ACGTACGTACACACACACGTACGT", 8, 4, [4, 4, 5, 5, 5, 5, 4, 0, 1, 2, 3], [([0, 1, 2, 3], 3), ([0, 1], 4)]),
    ("ACGTACGT", 256, 8, [4, 4], [([0, 1, 2, 3], 2)]),
    ("ACGTACGTACGTACGT", 16, 4, [4, 4, 4, 0, 1, 2, 3], [([0, 1, 2, 3], 3)]),
    ("GTGTGTGTGTGTGTGT", 8, 4, [2, 3, 2, 4, 4, 4, 4, 4, 3, 2, 3], [([3, 2], 5)]),
])
def test_lcg_goldens(text, longest, window, final, rules):
    got, made = lcg.lcg(codes(text), window, 2, longest, 2)
    assert got == final and [(b, n) for b, n, _ in made] == rules


def test_cuts_equal_the_plain_form():
    rng = random.Random(25)
    for _ in range(200):
        symbols = [rng.randrange(rng.choice([1, 2, 4, 9])) for _ in range(rng.randrange(60))]
        window, shortest, longest = rng.choice([2, 4, 8]), rng.choice([1, 2, 3]), rng.choice([2, 5, 16, 256])
        prints = [lcg.pair_print(a, b) for a, b in zip(symbols, [*symbols[1:], None])]
        want = [0] if symbols else []
        for i in range(1, len(symbols)):
            least = prints[i] == min(prints[max(0, i - window // 2) : i + window // 2 + 1])
            if (least and i - want[-1] >= shortest) or i - want[-1] >= longest:
                want.append(i)
        assert lcg.cuts(symbols, window, shortest, longest) == want


def test_fingerprints():
    assert D.fx_hash(D.symbol_words(0) + D.symbol_words(1)) == 0x0D4569EE47D3C0F2
    assert D.fx_hash([0, 1]) == 0x517CC1B727220A95


def test_analysis():
    assert grammar.analyze_rules({0: [0, 3], 1: [1, 4], 2: [5, 2]}) == {0: (1, 2, 1), 1: (2, 3, 2), 2: (3, 4, 3)}
    with pytest.raises(grammar.GrammarError):
        grammar.analyze_rules({0: [5], 1: [4]})
    assert grammar.analyze_rules({0: [5], 1: [4]}, "fallback") == {0: (0, 0, 0), 1: (0, 0, 0)}
    with pytest.raises(grammar.GrammarError):
        grammar.analyze_rules({0: [9, 0]})


def test_inlining_reaches_bodies():
    symbols, rules = grammar.inline_rules([5, -6], {0: [0, 1], 1: [4, 2]}, {0})
    assert symbols == [5, -6] and rules == {1: [0, 1, 2]}
    assert grammar.inline_rules([-5], {0: [0, 1]}, {0}) == ([2, 3], {})


def test_columns(spark):
    row = spark.sql("SELECT 'ACGTNacgtX' AS x, 'GATTACA' AS y, 'AACGNT' AS z").select(
        D.encode_codes(D.normalize("x")).alias("codes"), D.reverse_complement("y").alias("rc"), D.reverse_complement("z").alias("rcz"),
        D.is_strict("x").alias("strict"), D.normalize("x", "replace_a").alias("a"), D.base_code(F.lit("G")).alias("g"), D.base_code(F.lit("N")).alias("n"),
        D.format_symbol(F.lit(-8)).alias("r3"), D.format_symbol(F.lit(0)).alias("base"), D.symbol_complement(F.lit(1)).alias("comp"),
    ).first()
    assert row.codes == "01230123" and row.rc == "TGTAATC" and row.rcz == "ACGTT" and not row.strict and row.a == "ACGTAacgtA"
    assert row.g == 2 and row.n is None and row.r3 == "R3-" and row.base == "A+" and row.comp == 2
    assert D.pack_text("ACGTACGTA") == bytes([0b00011011, 0b00011011, 0])
    assert D.unpack_text(D.pack_text("ACGTACGTA"), 2, 5) == "GTACG"


def seqs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "seq_id long, dna string")


def test_kmers_do_not_depend_on_pieces(spark):
    rng = random.Random(5)
    df = seqs(spark, "", "A", "ACGTACG", "".join(rng.choice("ACGT") for _ in range(3000)))
    want = sorted(map(tuple, kmers.extract_kmers(df, 5).collect()))
    for size in (5, 64, 1000):
        assert sorted(map(tuple, kmers.extract_kmers(df, 5, size=size).repartition(3).collect())) == want
    mins = sorted(map(tuple, sketch.minimizers(df, 4, 3).collect()))
    for size in (3, 64, 1000):
        assert sorted(map(tuple, sketch.minimizers(df, 4, 3, size=size).collect())) == mins


def test_sketches(spark):
    assert len(sketch.bottom_sketch(seqs(spark, "AAAAAAAAAA"), 3, 5).first().sketch) == 1


def test_kmer_rules_go_on_past_overlaps():
    final, rules = repair.replace_kmers(codes("AAAAACGTCCGTC"), 4)
    assert ([1, 2, 3, 1], 2) in [(body, used) for body, used, _ in rules]
    assert final == [0, 0, 0, 0, 0, 4, 4]


def naive_kmers(symbols, k, either):
    """The most frequent window that can be replaced twice, again and again."""
    rules, back = [], repair.back
    while True:
        n = {}
        key = lambda w: min(w, tuple(back(x) for x in reversed(w))) if either else w
        for i in range(len(symbols) - k + 1):
            w = key(tuple(symbols[i : i + k]))
            n[w] = n.get(w, 0) + 1
        done = False
        for body in sorted((w for w, c in n.items() if c >= 2), key=lambda w: (-n[w], w)):
            out, i, used = [], 0, 0
            while i < len(symbols):
                w = tuple(symbols[i : i + k])
                if len(w) == k and key(w) == body:
                    out.append(4 + len(rules) if w == body else -5 - len(rules))
                    i, used = i + k, used + 1
                else:
                    out.append(symbols[i])
                    i += 1
            if used >= 2:
                rules.append((list(body), used, n[body]))
                symbols, done = out, True
                break
        if not done:
            return symbols, rules


@pytest.mark.parametrize("either", [False, True])
def test_kmer_rules_equal_the_plain_form(either):
    rng = random.Random(17)
    for _ in range(150):
        k, text = rng.choice([3, 4, 5]), [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(60))]
        assert repair.replace_kmers(text, k, either_strand=either) == naive_kmers(text, k, either)


@pytest.mark.parametrize("size", [1, 3, 7, 64])
def test_rounds_over_pieces_equal_the_plain_form(spark, size):
    rng = random.Random(size)
    texts = ["", "A", "AAAAAAAAAAAAAAAAA", "CAAAAAAAG", "ACACACACACAC"] + ["".join(rng.choice("ACGT"[: rng.randrange(1, 4)]) for _ in range(rng.randrange(40))) for _ in range(25)]
    rounds = 3 if size > 1 else 2
    symbols, rules = repair.pair_rounds(seqs(spark, *texts), rounds, size=size)
    found, made = {}, {}
    for r in symbols.orderBy("seq_id", "pos").collect():
        found.setdefault(r.seq_id, []).append((r.pos, r.sym))
    for r in rules.orderBy("seq_id", "rule_id").collect():
        made.setdefault(r.seq_id, []).append((r.a, r.b, r.n))
    for k, text in enumerate(texts):
        final, want = repair.repair(codes(text), most_rules=rounds)
        assert found.get(k, []) == list(enumerate(final)), text
        assert made.get(k, []) == [(a, b, n) for a, b, _, n in want]


def test_rounds_to_the_end(spark):
    symbols, rules = repair.pair_rounds(seqs(spark, "ACACACAC", "GATTACA"), size=3)
    assert [r.sym for r in symbols.where("seq_id = 0").orderBy("pos").collect()] == repair.repair(codes("ACACACAC"))[0]
    assert rules.count() == len(repair.repair(codes("ACACACAC"))[1])


def test_word_hashes():
    rng = random.Random(18)
    words = [[rng.randrange(5) for _ in range(rng.randrange(9))] for _ in range(50)]
    import numpy as np

    got = D.fx_hashes([np.array(w, np.int64) for w in words])
    assert [int(h) % 2**64 for h in got] == [D.fx_hash(w) for w in words]
    assert D.words_of_symbols([0, 5, -6]).tolist() == [w for s in (0, 5, -6) for w in D.symbol_words(s)]
    assert len(D.fx_hashes([])) == 0


def test_containers_of_many_parts(spark):
    rng = random.Random(20)
    rows = [(k, rng.choice(["a", "b", None]), "".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 3, 50, 400])))) for k in range(60)]
    df = spark.createDataFrame(rows, "seq_id long, source string, raw string").repartition(5)
    parts = fasta.to_orb(df, part_bytes=100).collect()
    for name in ("a", "b", None):
        mine = sorted((r for r in parts if r.source == name), key=lambda r: r.part)
        assert [r.part for r in mine] == list(range(len(mine))) and len(mine) > 3
        starts = [sum(len(x.content) for x in mine[:k]) for k in range(len(mine))]
        assert [r.start for r in mine] == starts and max(len(r.content) for r in mine) <= 100
        n, dna = fasta.total_orb(b"".join(bytes(r.content) for r in mine))
        own = [raw.replace("N", "A") for _, source, raw in rows if source == name]
        assert (n, dna.decode()) == (len(own), "".join(own))


def test_lines_of_long_rules_stay_inside(spark):
    rules = [{"rule_id": 0, "symbols": [k % 4 for k in range(1500)], "usage_count": 2, "pair_count": 2}, {"rule_id": 1, "symbols": [4, 0], "usage_count": 1, "pair_count": 1}]
    g = spark.createDataFrame([(0, [5, 4], rules)], repair.GRAMMAR)
    lines = [r.line for r in export.dot_lines(g).orderBy(*export.ORDER).collect()]
    at = [k for k, x in enumerate(lines) if x.startswith("  subgraph cluster_rule_")] + [max(k for k, x in enumerate(lines) if x == "  }\n")]
    inside = lines[at[0] : at[1]]
    assert sum(x.startswith("    rule_0_") for x in inside) == 1500 + 1499 and not any("rule_1_" in x for x in inside)
    assert inside[-1] == "  }\n"


def test_chunks_that_come_late_wait(spark, tmp_path):
    texts = ["AAAA", "CCCC", "GGGG", "TTTT"]
    for place, idx in enumerate([2, 1, 0, 3]):
        spark.createDataFrame([(7, idx, 4 * idx, 4, texts[idx])], counts.CHUNK).coalesce(1).write.parquet(str(tmp_path / "in" / f"batch={place}"))
    stream = spark.readStream.schema(counts.CHUNK).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    counts.run_to_table(counts.stream_grammars(stream), str(tmp_path / "out"), str(tmp_path / "marks"), "update")
    row = grammar.expand(counts.finalize(spark.read.parquet(str(tmp_path / "out")))).first()
    assert row.dna == "".join(texts)


def test_stats(spark):
    row = stats.sequence_stats(seqs(spark, "ACGTACGT"), k=2).first()
    assert (row.length, row.a, row.gc, row.longest_run, row.top_kmer, row.top_n) == (8, 2, 50.0, 1, "AC", 4)
    empty = stats.sequence_stats(seqs(spark, "")).first()
    assert empty.length == 0 and empty.gc == 0.0 and empty.longest_run == 0


def test_chunks(spark):
    def borders(n):
        return [(r.start, r.end) for r in chunks.split_chunks(seqs(spark, "A" * n), 300, 50).orderBy("idx").collect()]

    assert borders(1000) == [(0, 300), (250, 550), (500, 800), (750, 1000)]
    assert borders(1010)[-1] == (750, 1010)
    row = spark.sql("SELECT 'ACGT' AS l, 'GTAC' AS r").select(chunks.best_overlap(F.col("l"), F.col("r"), 4).alias("n"), chunks.join_two(F.lit("ACG"), F.lit("GTA"), 1).alias("j")).first()
    assert row.n == 2 and row.j == "ACGTA"


def test_fasta(spark, tmp_path):
    path = tmp_path / "x.fa"
    path.write_text(">r1 desc\nACGT\nNNac\n>r2\tx\nGG\n>r3\n")
    rows = {r.record_id: r.dna for r in fasta.read_fasta(spark, str(path)).collect()}
    assert rows == {"r1": "ACGTAC", "r2": "GG"}
    assert {r.record_id for r in fasta.read_fasta(spark, str(path), prefix_file=True).collect()} == {"x:r1", "x:r2"}
    with pytest.raises(ValueError):
        fasta.select_sequences(seqs(spark, "A"), [])


def test_exports(spark, tmp_path):
    rules = [{"rule_id": 0, "symbols": [0, 1], "usage_count": 4, "pair_count": 4}, {"rule_id": 1, "symbols": [4, 2], "usage_count": 2, "pair_count": 2}]
    g = spark.createDataFrame([(0, [4, 5], rules)], repair.GRAMMAR)
    lines = [r.line for r in export.gfa_lines(g).orderBy("section", "item").collect()]
    assert lines == ["H\tVN:Z:1.0", "S\t0\tAC\tLN:i:2", "S\t1\tACG\tLN:i:3", "L\t0\t+\t1\t+\t0M"]
    assert grammar.expand(g).first().dna == "ACACG"
    row = grammar.compression_stats(g).first()
    assert (row.original_size, row.compressed_size, row.n_rules, row.max_depth) == (5, 6, 2, 2)
    for name in ("g.json", "g.txt", "g.gfa", "g.dot", "g.fa", "g.graphml", "g.tsv"):
        export.export_grammar(g, str(tmp_path / name))
        assert (tmp_path / name).stat().st_size > 0
    back = fasta.read_grammar_json(spark, str(tmp_path / "g.json")).select(F.lit(0).cast("long").alias("seq_id"), "symbols", "rules")
    assert grammar.expand(back).first().dna == "ACACG"
    import json

    from helixframe.plans import run

    run.top_gfa(spark, str(tmp_path / "g.json"), str(tmp_path / "top.gfa"), 1)
    assert (tmp_path / "top.gfa").read_text().splitlines() == ["H\tVN:Z:1.0", "S\t0\tAC\tLN:i:2", "S\t1\tACG\tLN:i:3", "S\tT_G\tG\tLN:i:1", "L\t1\t+\t0\t+\t0M", "L\t1\t+\tT_G\t+\t0M"]
    run.convert(spark, str(tmp_path / "g.json"), str(tmp_path / "g2.gfa"))
    assert (tmp_path / "g2.gfa").read_text() == (tmp_path / "g.gfa").read_text()
    assert export.write_json_streaming(g, str(tmp_path / "s.json"), 1) == 2
    assert json.loads((tmp_path / "s.json").read_text()) == json.loads(export.grammar_json(g, "object").first()["json"])
    with pytest.raises(ValueError):
        export.format_of("g.xyz")


def test_run(spark, tmp_path):
    from helixframe.plans import run

    path = tmp_path / "x.fa"
    path.write_text(">test\nACGTACGTACGT\n")
    options = run.Options([str(path)], str(tmp_path / "out"), outputs=["json", "text", "gfa", "stats"])
    first = run.run(spark, options).collect()
    assert run.load_metadata(options.output)["built"] and run.run(spark, options).collect() == first
    assert run.load_metadata(options.output)["status"] == "completed" and not run.load_metadata(options.output)["built"]
    assert "final_sequence" in (tmp_path / "out" / "grammar.json").read_text()
    with pytest.raises(ValueError):
        run.Options(kmer_size=300)
    with pytest.raises(FileNotFoundError):
        run.run(spark, run.Options([str(tmp_path / "none.fa")], str(tmp_path / "out")))


def test_runs_take_up_only_what_is_the_same(spark, tmp_path):
    from helixframe.plans import run

    rng = random.Random(21)
    texts = {f"f{k}": "".join(rng.choice("ACGT") for _ in range(2500)) for k in range(2)}
    for name, dna in texts.items():
        (tmp_path / f"{name}.fa").write_text(f">{name}\n{dna}\n")
    plain = dict(inputs=[str(tmp_path / "f*.fa")], output=str(tmp_path / "out"), outputs=["json"])

    def dnas(**changed):
        return sorted(r.dna for r in grammar.expand(run.run(spark, run.Options(**plain | changed))).collect())

    built = lambda: len(run.load_metadata(plain["output"])["built"])
    want = sorted(texts.values())
    assert dnas() == want and built() == 2
    assert dnas(chunk_size=1000) == want and built() == 2
    assert dnas(chunk_size=1000) == want and built() == 0
    assert dnas(chunk_size=1000, reverse_aware=True, kmer_size=3) == want and built() == 2
    assert dnas(streaming=True, chunk_size=1000) == want and built() == 2
    assert dnas(adaptive_chunking=True) == want
    texts["f1"] = texts["f1"][:2000]
    (tmp_path / "f1.fa").write_text(f">f1\n{texts['f1']}\n")
    assert dnas() == sorted(texts.values()) and built() == 1
    assert dnas(sequence_indices=[1, 0]) == sorted(texts.values())
    (tmp_path / "f0a.fa").write_text(f">again\n{texts['f0']}\n>more\nACGTACGTTTACGT\n")  # sorts before f1; one sequence is known
    assert dnas() == sorted([*texts.values(), texts["f0"], "ACGTACGTTTACGT"]) and built() == 1
    assert dnas(force_rerun=True) == dnas() and built() == 0


def test_merged_chunks(spark):
    rng = random.Random(22)
    unit = "".join(rng.choice("ACGT") for _ in range(300))
    back = unit[::-1].translate(str.maketrans("ACGT", "TGCA"))
    texts = [unit * 4 + back * 3, "", "ACG", "".join(rng.choice("ACGT") for _ in range(900))]
    for either in (False, True):
        merged = grammar.merge_chunks(repair.build_chunked(seqs(spark, *texts), 301, either_strand=either), either).collect()
        assert len(merged) == len(texts)
        for row in merged:
            bodies = {r.rule_id: list(r.symbols) for r in row.rules}
            expanded = grammar.expand_all(bodies)
            assert "".join(grammar.text_of(s, expanded) for s in row.symbols) == texts[row.seq_id]
            named = [min(t, t[::-1].translate(str.maketrans("ACGT", "TGCA"))) if either else t for t in expanded.values()]
            assert len(set(named)) == len(named)


def test_merging_both_strands(spark):
    rules = lambda body: [{"rule_id": 0, "symbols": body, "usage_count": 2, "pair_count": 2}]
    g = spark.createDataFrame([(0, [4, 4], rules([0, 1])), (1, [4, 2, 4], rules([2, 3]))], repair.GRAMMAR)
    assert grammar.merge_grammars(g)[0].count() == 2
    found, origins = grammar.merge_grammars(g, either_strand=True)
    assert [(r.dna, r.usage_count, r.n_origins) for r in found.collect()] == [("AC", 4, 2)]
    rows = {s: [r.sym for r in grammar.merged_sequences(g, origins).where(F.col("seq_id") == s).orderBy("pos").collect()] for s in (0, 1)}
    assert rows == {0: [4, 4], 1: [-5, 2, -5]}
    assert [list(r.symbols) for r in grammar.merged_rules(g, origins).collect()] == [[0, 1]]


def test_eviction_equals_the_plain_form():
    rng = random.Random(23)
    for _ in range(60):
        final, made = repair.repair([rng.randrange(2) for _ in range(rng.randrange(20, 120))])
        rules = {k: [a, b] for k, (a, b, *_) in enumerate(made)}
        most = rng.randrange(len(rules) + 1)
        symbols, left = final, dict(rules)
        while len(left) > most:
            n = grammar.references(symbols, left)
            symbols, left = grammar.inline_rules(symbols, left, {min(left, key=lambda r: (n[r], -r))})
        assert grammar.evict(final, rules, most) == (symbols, left)


def test_growing_grammar():
    rng = random.Random(6)
    text = "".join(rng.choice("ACGT") for _ in range(400))
    state = (0, [], [], [], [], [])
    for k in range(0, 400, 50):
        state = counts.grow(state, text[k : k + 50], 2, None)
    texts = grammar.expand_all({k: [a, b] for k, (a, b) in enumerate(zip(state[2], state[3]))})
    assert "".join(grammar.text_of(s, texts) for s in state[1]) == text
    assert len(set(zip(state[2], state[3]))) == len(state[2])


def test_catalogue_grammars_leave_no_repeated_pair(spark, sf_dir):
    built = catalogue.grammars(spark, sf_dir).orderBy(F.size("symbols").desc()).limit(20).collect()
    assert max(len(r.symbols) for r in built) > 100
    for row in built:
        assert max(Counter(zip(row.symbols, row.symbols[1:])).values(), default=0) < 2


def test_finalize_leaves_no_repeated_pair(spark):
    rng = random.Random(6)
    dna = "".join(rng.choice("ACGT") for _ in range(3000))
    state = (0, [], [], [], [], [])
    for k in range(0, 3000, 500):
        state = counts.grow(state, dna[k : k + 500], 2, 3)
    _, symbols, left, right, used, counted = state
    assert max(Counter(zip(symbols, symbols[1:])).values()) > 2
    rules = [(r, [a, b], u, c) for r, (a, b, u, c) in enumerate(zip(left, right, used, counted))]
    grown = spark.createDataFrame([(1, 6, symbols, rules)], counts.GROWN)
    row = counts.finalize(grown).first()
    assert max(Counter(zip(row.symbols, row.symbols[1:])).values()) < 2
    assert grammar.expand(counts.finalize(grown)).first().dna == dna
    small = counts.finalize(grown, most_rules=5)
    assert len(small.first().rules) == 5 and grammar.expand(small).first().dna == dna


def test_positions_in_blocks(spark):
    texts = ["", "A" * 1000, "ACGTACG", "CA" * 130]
    df = seqs(spark, *texts)
    blocks = kmers.kmer_position_blocks(df, 2, size=64).withColumn("at", kmers.positions_in(F.col("first"), F.col("gaps"))).collect()
    assert max(len(r.at) for r in blocks) == 64 and all(r.n == len(r.at) and r.at[0] // 64 == r.at[-1] // 64 == r.block for r in blocks)
    found = {}
    for r in sorted(blocks, key=lambda r: r.block):
        found.setdefault((r.seq_id, r.kmer), []).extend(r.at)
    assert found == {(r.seq_id, r.kmer): r.positions for r in kmers.kmer_positions(df, 2).collect()}


def test_strands_are_folded_after_the_count(spark):
    df = seqs(spark, "ACGTACGTTT", "AAACG", "")
    direct = kmers.extract_kmers(df, 3, True).groupBy("seq_id", "kmer").count()
    assert sorted(map(tuple, kmers.count_kmers(df, 3, True, by=("seq_id",)).collect())) == sorted(map(tuple, direct.collect()))


def test_long_sequences_are_cut_in_linear_time(spark):
    import time

    from helixframe.operators import chunks

    text = "ACGT" * 2_000_000
    began = time.time()
    cut = chunks.split_chunks(seqs(spark, text), 1000)
    assert cut.agg(F.count("*"), F.sum(F.length("dna"))).first()[:] == (8000, len(text))
    assert time.time() - began < 60
