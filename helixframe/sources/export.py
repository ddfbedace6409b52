"""Grammar exporters: every format is rows of lines with an order, made by DataFrame operations.

Lines are (seq_id, section, item, place, line), in that order; a rule's lines have its id as
``item``.  ``write_lines`` sorts them by range and writes a file for each range in
parallel, whose names are in order, or streams them to one local file.  Rules
come in order of their ids in every format.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import bounded
from ..functions.dna import code_base, format_symbol, is_rule, rule_of, strand_of
from ..operators.grammar import analyze, analyze_rules, expand, expand_rules, explode_rules, explode_symbols, grammars_in, rule_edges

#: Colours of bases, and of depth fifths.
BASE_COLORS = {"A": "lightgreen", "C": "lightblue", "G": "orange", "T": "pink"}
DEPTH_COLORS = ((0.2, "lightgreen"), (0.4, "palegreen"), (0.6, "khaki"), (0.8, "lightsalmon"), (None, "lightcoral"))
FORMATS = {"json": "json", "txt": "text", "text": "text", "gfa": "gfa", "dot": "dot", "fasta": "fasta", "fa": "fasta", "fna": "fasta", "graphml": "graphml", "tsv": "repeats"}


ORDER = ("seq_id", "section", "item", "place", "line")


def _lines(df: DataFrame, section: int, item, line, place=0) -> DataFrame:
    number = lambda x, name: (F.lit(x) if isinstance(x, int) else x).cast("long").alias(name)
    return df.select("seq_id", F.lit(section).alias("section"), number(item, "item"), number(place, "place"), line.alias("line"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def wrap(text: Column, width: int = 80) -> Column:
    return F.rtrim(F.regexp_replace(text, f"(.{{{width}}})", "$1\n"), F.lit("\n"))


def _formatted(column: str, sep: str) -> Column:
    return F.array_join(F.transform(column, format_symbol), sep)


def text_lines(grammars: DataFrame, dialect: str = "plain") -> DataFrame:
    """Dialect plain: symbols without spaces, usage at the end of a rule. full: spaced symbols with counts in the titles. wrapped: as full, lines of 80."""
    rules = explode_rules(grammars)
    n_symbols, n_rules = F.size("symbols"), F.size("rules")
    if dialect == "plain":
        return _union([
            _lines(grammars, 0, 0, F.lit("== Sequence ==")), _lines(grammars, 1, 0, _formatted("symbols", "")), _lines(grammars, 2, 0, F.lit("")), _lines(grammars, 3, 0, F.lit("== Rules ==")),
            _lines(rules, 4, F.col("rule_id"), F.format_string("Rule %d: %s (usage: %d)", "rule_id", _formatted("symbols", ""), "usage_count")),
        ])
    sequence = _formatted("symbols", " ")
    return _union([
        _lines(grammars, 0, 0, F.format_string("== Final Sequence (%d symbols) ==", n_symbols)), _lines(grammars, 1, 0, wrap(sequence) if dialect == "wrapped" else sequence), _lines(grammars, 2, 0, F.lit("")),
        _lines(grammars, 3, 0, F.format_string("== Rules (%d total) ==", n_rules)),
        _lines(rules, 4, F.col("rule_id"), F.format_string("R%d [Usage=%d] -> %s", "rule_id", "usage_count", _formatted("symbols", " "))),
    ])


def fasta_lines(grammars: DataFrame, dialect: str = "plain") -> DataFrame:
    """Dialect plain: ``>Rule_0 usage=.. depth=..``. full: counts in brackets, and the final sequence as a last record."""
    rules = expand_rules(grammars)
    if dialect == "plain":
        depth = analyze(grammars).select("seq_id", "rule_id", "depth")
        rows = rules.join(depth, ["seq_id", "rule_id"])
        return _lines(rows, 0, F.col("rule_id"), F.concat(F.format_string(">Rule_%d usage=%d depth=%d\n", "rule_id", "usage_count", "depth"), wrap(F.col("dna"))))
    head = F.format_string(">Rule_%d [Usage=%d] [Symbols=%d]\n", "rule_id", "usage_count", F.size("symbols"))
    whole = expand(grammars).join(grammars.select("seq_id", F.size("symbols").alias("n")), "seq_id")
    return _union([_lines(rules, 0, F.col("rule_id"), F.concat(head, wrap(F.col("dna")))), _lines(whole, 1, 0, F.concat(F.format_string(">Final_Sequence [Length=%d]\n", "n"), wrap(F.col("dna"))))])


def dna_fasta_lines(seqs: DataFrame, header: str) -> DataFrame:
    """Whole sequences under ``>header``."""
    return _lines(seqs, 0, 0, F.concat(F.lit(f">{header}\n"), wrap(F.col("dna"))))


def _followed(grammars: DataFrame) -> DataFrame:
    """seq_id, pos, sym, next of neighbours in final sequences, from the arrays themselves."""
    pairs = F.arrays_zip(F.slice("symbols", F.lit(1), F.size("symbols") - 1).alias("sym"), F.slice("symbols", F.lit(2), F.size("symbols") - 1).alias("next"))
    rows = grammars.where(F.size("symbols") > 1).select("seq_id", F.posexplode(pairs).alias("pos", "p"))
    return rows.select("seq_id", "pos", F.col("p.sym").alias("sym"), F.col("p.next").alias("next"))


def _link(a, b) -> Column:
    segment = lambda s: F.when(s.between(0, 3), F.concat(F.lit("T_"), code_base(s))).otherwise(rule_of(s).cast("string"))
    return F.concat_ws("\t", F.lit("L"), segment(a), strand_of(a), segment(b), strand_of(b), F.lit("0M"))


def gfa_lines(grammars: DataFrame, dialect: str = "sequence") -> DataFrame:
    """S line for each rule. Dialect sequence: L lines between neighbouring rules of the final sequence. rules: between the symbols of a two-symbol rule."""
    segments = expand_rules(grammars)
    s = _lines(segments, 1, F.col("rule_id"), F.concat_ws("\t", F.lit("S"), F.col("rule_id").cast("string"), "dna", F.concat(F.lit("LN:i:"), F.length("dna"))))
    head = _lines(grammars, 0, 0, F.lit("H\tVN:Z:1.0"))
    if dialect == "sequence":
        near = _followed(grammars).where(is_rule("sym") & is_rule("next"))
        return _union([head, s, _lines(near, 2, F.col("pos"), _link(F.col("sym"), F.col("next")))])
    pairs = explode_rules(grammars).where(F.size("symbols") == 2)
    return _union([head, s, _lines(pairs, 2, F.col("rule_id"), _link(F.get("symbols", F.lit(0)), F.get("symbols", F.lit(1))))])


def top_rules(grammars: DataFrame, n: int, per_grammar: bool = False) -> DataFrame:
    """The n rules of greatest expanded length, ties to the lesser grammar and rule id."""
    rules = expand_rules(grammars).withColumn("expanded_length", F.length("dna").cast("long"))
    if not per_grammar:
        return rules.orderBy(F.col("expanded_length").desc(), "seq_id", "rule_id").limit(n)
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("expanded_length")).alias("less"), "rule_id"))), 1, n)
    chosen = rules.groupBy("seq_id").agg(F.explode(best).alias("x")).select("seq_id", "x.rule_id")
    return rules.join(chosen, ["seq_id", "rule_id"], "left_semi")


def gfa_top_lines(grammars: DataFrame, n: int) -> DataFrame:
    """GFA of the n longest rules of each grammar, their children, and the bases they use."""
    top = top_rules(grammars, n, per_grammar=True)
    rows = top.select("seq_id", "rule_id", F.posexplode("symbols").alias("ordinal", "sym"))
    wanted = top.select("seq_id", "rule_id").union(rows.where(is_rule("sym")).select("seq_id", rule_of("sym").alias("rule_id"))).distinct()
    segments = expand_rules(grammars).join(wanted, ["seq_id", "rule_id"], "left_semi")
    bases = rows.where(~is_rule("sym")).select("seq_id", "sym").distinct()
    name = F.when(F.col("sym").between(0, 3), F.concat(F.lit("T_"), code_base("sym"))).otherwise(rule_of("sym").cast("string"))
    return _union([
        _lines(grammars, 0, 0, F.lit("H\tVN:Z:1.0")),
        _lines(segments, 1, F.col("rule_id"), F.concat_ws("\t", F.lit("S"), F.col("rule_id").cast("string"), "dna", F.concat(F.lit("LN:i:"), F.length("dna")))),
        _lines(bases, 2, F.col("sym"), F.concat(F.lit("S\tT_"), code_base("sym"), F.lit("\t"), code_base("sym"), F.lit("\tLN:i:1"))),
        _lines(rows, 3, F.col("rule_id"), F.concat_ws("\t", F.lit("L"), F.col("rule_id").cast("string"), F.lit("+"), name, strand_of("sym"), F.lit("0M")), F.col("ordinal")),
    ])


def depth_color(depth: Column, deepest: Column) -> Column:
    share = depth / deepest
    out = F.when(deepest == 0, "lightyellow")
    for limit, color in DEPTH_COLORS[:-1]:
        out = out.when(share < limit, color)
    return out.otherwise(DEPTH_COLORS[-1][1])


def base_color(sym: Column) -> Column:
    out = F
    for k, color in enumerate(BASE_COLORS.values()):
        out = out.when(sym == k, color)
    return out.otherwise("gray")


def dot_lines(grammars: DataFrame, dialect: str = "clusters", terminals: bool = True, usage: bool = True, by_depth: bool = True) -> DataFrame:
    """Dialect clusters: a cluster for the sequence and each rule. graph: rules and bases as nodes, uses as edges."""
    known = analyze(grammars).select("seq_id", "rule_id", "usage_count", "depth")
    if dialect == "graph":
        rules = explode_rules(grammars).select("seq_id", "rule_id", F.posexplode("symbols").alias("ordinal", "sym"))
        node = lambda s: F.when(s.between(0, 3), F.concat(F.lit("T_"), code_base(s))).otherwise(F.concat(F.lit("R"), rule_of(s).cast("string")))
        return _union([
            _lines(grammars, 0, 0, F.lit("digraph Grammar {\n  rankdir=LR;\n  node [shape=box, style=filled, fillcolor=lightgrey];")),
            _lines(known, 1, F.col("rule_id"), F.format_string('  R%d [label="R%d (Usage=%d)", shape=box, fillcolor=lightblue];', "rule_id", "rule_id", "usage_count")),
            _lines(rules.where(~is_rule("sym")).select("seq_id", "sym").distinct(), 2, F.col("sym"), F.concat(F.lit("  "), node(F.col("sym")), F.lit(' [label="'), code_base("sym"), F.lit('", shape=ellipse, fillcolor=white];'))),
            _lines(rules, 3, F.col("rule_id"), F.concat(F.lit("  R"), F.col("rule_id"), F.lit(" -> "), node(F.col("sym")), F.lit(";")), F.col("ordinal")),
            _lines(grammars, 9, 0, F.lit("}")),
        ])
    deepest = known.groupBy("seq_id").agg(F.max("depth").alias("deepest"))
    child = known.select("seq_id", F.col("rule_id").alias("child"), F.col("usage_count").alias("uses"), F.col("depth").alias("child_depth"))

    def described(rows: DataFrame) -> DataFrame:
        found = rows.withColumn("child", rule_of("sym")).join(child, ["seq_id", "child"], "left").join(deepest, "seq_id", "left")
        rule = F.concat(F.lit("R"), F.col("child"), F.concat(F.lit("("), F.col("uses"), F.lit(")")) if usage else F.lit(""))
        shade = depth_color(F.coalesce("child_depth", F.lit(0)), F.coalesce("deepest", F.lit(0))) if by_depth else F.lit("lightyellow")
        return found.withColumn("label", F.when(is_rule("sym"), rule).otherwise(code_base("sym"))).withColumn("color", F.when(is_rule("sym"), shade).otherwise(base_color(F.col("sym"))))

    shown = F.lit(True) if terminals else is_rule("sym")
    places = described(explode_symbols(grammars))
    inner = described(explode_rules(grammars).select("seq_id", "rule_id", F.size("symbols").alias("n"), F.posexplode("symbols").alias("ordinal", "sym")))
    rules = explode_rules(grammars)
    place = F.col("ordinal") * 2
    return _union([
        _lines(grammars, 0, 0, F.lit('digraph Grammar {\n  graph [rankdir=LR];\n  node [shape=box, style=filled, fontname="Arial"];\n  subgraph cluster_sequence {\n    label="Main Sequence";\n    style=filled;\n    color=lightblue;')),
        _lines(places.where(shown), 1, F.col("pos"), F.format_string('    seq_%d [label="%s", color=%s];', "pos", "label", "color")),
        _lines(_followed(grammars), 2, F.col("pos"), F.format_string("    seq_%d -> seq_%d;", F.col("pos"), F.col("pos") + 1)),
        _lines(grammars, 3, 0, F.lit("  }\n")),
        _lines(rules, 4, F.col("rule_id"), F.format_string('  subgraph cluster_rule_%d {\n    label="Rule %d";\n    style=filled;\n    color=lightgrey;', "rule_id", "rule_id"), -1),
        _lines(inner.where(shown), 4, F.col("rule_id"), F.format_string('    rule_%d_%d [label="%s", color=%s];', "rule_id", "ordinal", "label", "color"), place),
        _lines(inner.where("ordinal + 1 < n"), 4, F.col("rule_id"), F.format_string("    rule_%d_%d -> rule_%d_%d;", F.col("rule_id"), F.col("ordinal"), F.col("rule_id"), F.col("ordinal") + 1), place + 1),
        _lines(rules, 4, F.col("rule_id"), F.lit("  }\n"), 2 * F.size("symbols")),
        _lines(inner.where(F.col("uses").isNotNull()), 5, F.col("rule_id"), F.format_string("  rule_%d_%d -> rule_%d_0 [style=dashed, color=blue];", "rule_id", "ordinal", "child"), place),
        _lines(grammars, 9, 0, F.lit("}")),
    ])


def _numbered_nodes(grammars: DataFrame, deepest: int | None, terminals: bool) -> DataFrame:
    """The nodes, and the rule that each is or belongs to as ``number``."""
    rules = analyze(grammars)
    rules = rules if deepest is None else rules.where(F.col("depth") <= deepest)
    name = F.concat(F.lit("R"), F.col("rule_id"))
    rule = F.struct(F.lit(-1).alias("ordinal"), F.lit(-1).cast("long").alias("sym"))
    inner = F.filter(F.transform("symbols", lambda s, i: F.struct(i.alias("ordinal"), s.alias("sym"))), lambda x: x["sym"].between(0, 3))
    rows = rules.select("seq_id", "rule_id", "usage_count", "depth", F.explode(F.concat(F.array(rule), inner) if terminals else F.array(rule)).alias("x"))
    is_base, base = F.col("x.ordinal") >= 0, F.col("x.sym")
    place = F.concat(F.lit("T_"), code_base(base), F.lit("_R"), F.col("rule_id"), F.lit("_"), F.col("x.ordinal"))
    of_rule = lambda c: F.when(~is_base, F.col(c)).alias(c)
    return rows.select("seq_id", F.when(is_base, place).otherwise(name).alias("id"), F.when(is_base, format_symbol(base)).otherwise(name).alias("label"), F.when(is_base, "terminal").otherwise("rule").alias("type"), of_rule("usage_count"), of_rule("depth"), F.col("rule_id").alias("number"))


def graph_nodes(grammars: DataFrame, deepest: int | None = None, terminals: bool = True) -> DataFrame:
    """seq_id, id, label, type, usage_count, depth: rules (of limited depth) and the bases of each rule."""
    return _numbered_nodes(grammars, deepest, terminals).drop("number")


def _shown_uses(grammars: DataFrame, deepest: int | None, terminals: bool) -> DataFrame:
    """seq_id, rule_id, ordinal, sym: symbols of rules, and neighbours in final sequences (rule_id is then of the first, and ``near`` its place), of which both ends are shown."""

    def run(batches):
        for batch in bounded(batches):
            rows = []
            for seq_id, (symbols, bodies) in zip(batch.column("seq_id").to_pylist(), grammars_in(batch)):
                found = analyze_rules(bodies)
                shown = bodies.keys() if deepest is None else {r for r in bodies if found[r][0] <= deepest}
                seen = lambda s: terminals if 0 <= s <= 3 else (s - 4 if s >= 4 else -5 - s) in shown
                rows += [(seq_id, r, k, s, None) for r in shown for k, s in enumerate(bodies[r]) if seen(s)]
                named = [(s - 4 if s >= 4 else -5 - s) if not 0 <= s <= 3 else None for s in symbols]
                rows += [(seq_id, a, None, symbols[k + 1], k) for k, (a, b) in enumerate(zip(named, named[1:])) if a in shown and b in shown]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["seq_id", "rule_id", "ordinal", "sym", "near"])

    return grammars.select("seq_id", "symbols", "rules").mapInArrow(run, "seq_id long, rule_id long, ordinal long, sym long, near long")


def _numbered_edges(grammars: DataFrame, deepest: int | None, terminals: bool) -> DataFrame:
    """The edges, and the rule in which each is as ``number``, 0 for those of final sequences."""
    rows, near = _shown_uses(grammars, deepest, terminals), F.col("near").isNotNull()
    target = F.when(is_rule("sym"), F.concat(F.lit("R"), rule_of("sym"))).otherwise(F.concat(F.lit("T_"), code_base("sym"), F.lit("_R"), F.col("rule_id"), F.lit("_"), F.col("ordinal")))
    name = F.when(near, F.concat(F.lit("E_S_"), F.col("near"))).otherwise(F.concat(F.lit("E_R"), F.col("rule_id"), F.lit("_"), F.col("ordinal")))
    return rows.select("seq_id", name.alias("id"), F.concat(F.lit("R"), F.col("rule_id")).alias("source"), target.alias("target"), F.when(near, 0).otherwise(F.col("rule_id")).alias("number"))


def graph_edges(grammars: DataFrame, deepest: int | None = None, terminals: bool = True) -> DataFrame:
    """seq_id, id, source, target: rule to symbol, and neighbouring rules of the final sequence; both ends are nodes."""
    return _numbered_edges(grammars, deepest, terminals).drop("number")


def graphml_lines(grammars: DataFrame, deepest: int | None = None, terminals: bool = True) -> DataFrame:
    """GraphML, elements in the order of their ids."""
    keys = "".join(f'\n  <key id="{i}" for="node" attr.name="{n}" attr.type="{t}"/>' for i, n, t in (("d_label", "label", "string"), ("d_type", "type", "string"), ("d_usage", "usage_count", "int"), ("d_depth", "depth", "int")))
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}\n  <graph id="G" edgedefault="directed">'
    data = lambda key, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<data key="{key}">'), F.col(c).cast("string"), F.lit("</data>"))).otherwise("")
    nodes, edges, number = _numbered_nodes(grammars, deepest, terminals), _numbered_edges(grammars, deepest, terminals), F.col("number")
    return _union([
        _lines(grammars, 0, 0, F.lit(head)),
        _lines(nodes, 1, number, F.concat(F.lit('    <node id="'), "id", F.lit('">'), data("d_label", "label"), data("d_type", "type"), data("d_usage", "usage_count"), data("d_depth", "depth"), F.lit("</node>"))),
        _lines(edges, 2, number, F.concat(F.lit('    <edge id="'), "id", F.lit('" source="'), "source", F.lit('" target="'), "target", F.lit('"/>'))),
        _lines(grammars, 9, 0, F.lit("  </graph>\n</graphml>")),
    ])


def _symbol_json(s: Column, i: Column, dialect: str) -> Column:
    if dialect == "array":
        kind = F.when(s.between(0, 3), "terminal").otherwise("non-terminal")
        return F.struct(i.cast("long").alias("id"), kind.alias("type"), F.when(s.between(0, 3), code_base(s)).otherwise(rule_of(s).cast("string")).alias("value"), strand_of(s).alias("strand"))
    kind = F.when(s.between(0, 3), "terminal").otherwise("non_terminal")
    return F.struct(i.cast("long").alias("id"), kind.alias("type"), F.when(s.between(0, 3), format_symbol(s)).alias("value"), rule_of(s).alias("rule_id"), strand_of(s).alias("strand"))


def grammar_json(grammars: DataFrame, dialect: str = "array") -> DataFrame:
    """seq_id, json. Dialect array: rules in a list. object: rules by id, with empty ones for those that are missing."""
    depth = analyze(grammars, "fallback" if dialect == "object" else "raise")
    body = F.struct(F.col("rule_id").alias("id"), F.transform("symbols", lambda s, i: _symbol_json(s, i, dialect)).alias("symbols"), "usage_count", "depth")
    rules = depth.groupBy("seq_id").agg(F.array_sort(F.collect_list(body), lambda a, b: (a["id"] - b["id"]).cast("int")).alias("known"))
    rows = grammars.select("seq_id", F.transform("symbols", lambda s, i: _symbol_json(s, i, dialect)).alias("final_sequence")).join(rules, "seq_id", "left")
    if dialect == "array":
        return rows.select("seq_id", F.to_json(F.struct("final_sequence", F.coalesce("known", F.array().cast(rules.schema["known"].dataType)).alias("rules"))).alias("json"))
    named = F.transform(F.coalesce("known", F.array().cast(rules.schema["known"].dataType)), lambda r: F.struct(r["id"].cast("string").alias("key"), F.struct(r["symbols"].alias("symbols"), r["usage_count"].alias("usage_count"), r["depth"].alias("depth")).alias("value")))
    used = F.array_distinct(F.transform(F.filter("final_sequence", lambda s: s["rule_id"].isNotNull()), lambda s: s["rule_id"].cast("string")))
    absent = F.array_except(used, F.transform("named", lambda e: e["key"]))
    rows = rows.withColumn("named", named)
    kind = rows.schema["named"].dataType.elementType["value"].dataType
    empty = F.struct(F.array().cast(kind["symbols"].dataType).alias("symbols"), F.lit(1).cast("long").alias("usage_count"), F.lit(0).cast(kind["depth"].dataType).alias("depth"))
    rows = rows.withColumn("all", F.concat("named", F.transform(absent, lambda k: F.struct(k.alias("key"), empty.alias("value")))))
    return rows.select("seq_id", F.to_json(F.struct("final_sequence", F.map_from_entries("all").alias("rules"))).alias("json"))


def repeat_summary(grammars: DataFrame, least: int = 2, preview: int = 50) -> DataFrame:
    """seq_id, RuleID, UsageCount, ExpandedLength, Preview of rules used often enough."""
    rules = expand_rules(grammars).where(F.col("usage_count") >= least)
    short = F.when(F.length("dna") > preview, F.concat(F.substring("dna", 1, preview), F.lit("..."))).otherwise(F.col("dna"))
    return rules.select("seq_id", F.col("rule_id").alias("RuleID"), F.col("usage_count").alias("UsageCount"), F.length("dna").cast("long").alias("ExpandedLength"), short.alias("Preview"))


def repeat_lines(grammars: DataFrame) -> DataFrame:
    rows = repeat_summary(grammars)
    return _union([
        _lines(grammars, 0, 0, F.lit("RuleID\tUsageCount\tExpandedLength\tSequence(Preview)")),
        _lines(rows, 1, -F.col("UsageCount"), F.concat_ws("\t", *(F.col(c).cast("string") for c in ("RuleID", "UsageCount", "ExpandedLength", "Preview"))), F.col("RuleID")),
    ])


def stats_lines(grammars: DataFrame) -> DataFrame:
    """The text report of each grammar, its rules' assembly indices and the sequence's."""
    from ..operators.grammar import compression_stats, sequence_assembly_index

    rows = compression_stats(grammars).join(sequence_assembly_index(grammars), "seq_id")
    report = F.format_string("--- Grammar Statistics ---\nNumber of Rules: %d\nCompressed Sequence Length (Symbols): %d\nCompressed Sequence Length (Base Pairs): %d\nMaximum Rule Depth: %d\nTotal Symbols in Rule Definitions: %d\nAverage Symbols per Rule: %.2f\nRules with Assembly Index calculated: %d\n--- End of Statistics ---", "n_rules", "final_symbols", "original_size", "max_depth", "rule_symbols", "avg_symbols_per_rule", "n_rules")
    rules = analyze(grammars)
    return _union([
        _lines(rows, 0, 0, report),
        _lines(rules, 1, F.col("rule_id"), F.format_string("Rule %d: assembly index %d, length %d, depth %d", "rule_id", "assembly_index", "expanded_length", "depth")),
        _lines(rows, 2, 0, F.format_string("Total assembly index: %d", "assembly_index")),
    ])


WRITERS = {"text": text_lines, "fasta": fasta_lines, "gfa": gfa_lines, "dot": dot_lines, "graphml": graphml_lines, "repeats": repeat_lines, "stats": stats_lines}


def format_of(path: str) -> str:
    kind = FORMATS.get(os.path.splitext(path)[1].lstrip(".").lower())
    if kind is None:
        raise ValueError(f"no format is known for {path}")
    return kind


def lines_for(grammars: DataFrame, kind: str, **options) -> DataFrame:
    if kind == "json":
        return _lines(grammar_json(grammars, **options), 0, 0, F.col("json"))
    if kind not in WRITERS:
        raise ValueError(f"unknown format {kind!r}")
    return WRITERS[kind](grammars, **options)


def write_lines(lines: DataFrame, path: str, one_file: bool = True) -> None:
    """The lines in order: one local file, of which the driver holds a partition's lines at a time, or a folder of text files written in parallel."""
    ordered = lines.orderBy(*ORDER)
    if not one_file:
        ordered.select(F.col("line").alias("value")).write.text(path)
        return
    with open(path, "w", encoding="utf-8") as out:
        for row in ordered.toLocalIterator():
            out.write(row["line"] + "\n")


def export_grammar(grammars: DataFrame, path: str, kind: str | None = None, one_file: bool = True, **options) -> None:
    write_lines(lines_for(grammars, kind or format_of(path), **options), path, one_file)


def write_json_streaming(grammars: DataFrame, path: str, flush: int = 1000) -> int:
    """One grammar in the object dialect, rule by rule in order of ids, so that the driver holds few; returns the number of rules."""
    rules = analyze(grammars).select("rule_id", F.to_json(F.struct(F.transform("symbols", lambda s, i: _symbol_json(s, i, "object")).alias("symbols"), "usage_count", "depth")).alias("json"))
    sequence = grammars.select(F.to_json(F.transform("symbols", lambda s, i: _symbol_json(s, i, "object"))).alias("json")).first()["json"]
    n = 0
    with open(path, "w", encoding="utf-8") as out:
        out.write('{"final_sequence":' + sequence + ',"rules":{')
        for n, row in enumerate(rules.orderBy("rule_id").toLocalIterator(), 1):
            out.write(("," if n > 1 else "") + f'"{row["rule_id"]}":{row["json"]}')
            if n % flush == 0:
                out.flush()
        out.write("}}")
    return n


def edges(grammars: DataFrame) -> DataFrame:
    return rule_edges(explode_rules(grammars))
