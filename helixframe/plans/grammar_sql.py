"""SQL of the grammars and of what is made of them, for comparison on small tables.

A sequence is a string in which rule r is the character of number ``FIRST`` + r, so
that replacing a pair from left to right is replacing a string.  Each step of
the recursion replaces every sequence's most frequent pair, ties to the least.
"""

from __future__ import annotations

FIRST = 4096

SEQUENCES = "s AS (SELECT doc_id AS seq_id, upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g')) AS dna FROM documents)"


def is_base(x: str) -> str:
    return f"unicode({x}) < {FIRST}"


def number(x: str) -> str:
    """A symbol's number as the engine writes it."""
    return f"(CASE WHEN {is_base(x)} THEN instr('ACGT', {x}) - 1 ELSE unicode({x}) - {FIRST - 4} END)"


def shown(x: str) -> str:
    return f"(CASE WHEN {is_base(x)} THEN {x} ELSE 'R' || (unicode({x}) - {FIRST}) END || '+')"


def of_rule(x: str, values: str, base: str) -> str:
    """The entry of a rule symbol in a list by rule, or the value of a base."""
    return f"(CASE WHEN {is_base(x)} THEN {base} ELSE {values}[unicode({x}) - {FIRST - 1}] END)"


def windows(k: int) -> str:
    return "list_transform(range(1, len(l) - %d), lambda i: %s)" % (k - 2, " || ".join(f"l[i + {j}]" if j else "l[i]" for j in range(k)))


def build(k: int = 2) -> str:
    """g: seq_id, s (the final string), rules, texts and depths by rule; rules: a row for each; symbols: the final ones, in order."""
    twice = "" if k == 2 else f" AND length(any_value(s)) - length(replace(any_value(s), pair, '')) >= {2 * k}"
    text, depth = (" || ".join(of_rule(f"pair[{j + 1}]", "texts", f"pair[{j + 1}]") for j in range(k)), "1 + greatest(%s)" % ", ".join(of_rule(f"pair[{j + 1}]", "depths", "0") for j in range(k)))
    return f"""WITH RECURSIVE {SEQUENCES},
g(seq_id, r, s, rules, texts, depths) USING KEY (seq_id) AS (
  SELECT seq_id, 0, dna, []::STRUCT(body VARCHAR, n BIGINT, used BIGINT)[], []::VARCHAR[], []::INTEGER[] FROM s
  UNION
  SELECT g.seq_id, r + 1, replace(s, pair, chr({FIRST} + r)),
    list_append(rules, {{'body': pair, 'n': n, 'used': (length(s) - length(replace(s, pair, chr({FIRST} + r)))) // {k - 1}}}),
    list_append(texts, {text}), list_append(depths, {depth})
  FROM g JOIN (
    SELECT seq_id, pair, count(*) AS n FROM (SELECT seq_id, s, unnest({windows(k)}) AS pair FROM (SELECT seq_id, s, string_split(s, '') AS l FROM g))
    GROUP BY seq_id, pair HAVING count(*) >= 2{twice} QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY count(*) DESC, pair) = 1) AS best ON best.seq_id = g.seq_id),
rules AS (
  SELECT seq_id, i - 1 AS rule_id, rules[i].body AS body, rules[i].used AS used, rules[i].n AS n, texts[i] AS dna, depths[i] AS depth
  FROM (SELECT *, unnest(range(1, len(rules) + 1)) AS i FROM g)),
bodies AS (
  SELECT seq_id, rule_id, i - 1 AS ordinal, body[i] AS sym, length(body) AS size FROM (SELECT *, unnest(range(1, length(body) + 1)) AS i FROM rules)),
symbols AS (
  SELECT seq_id, i - 1 AS pos, l[i] AS sym, l[i + 1] AS next, depths, rules FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT *, CASE WHEN s = '' THEN [] ELSE string_split(s, '') END AS l FROM g)))
"""


PAIRS = build()


def joined(text: str, sep: str, each) -> str:
    """The symbols of a string, each as the function says, with a separator."""
    return f"array_to_string(list_transform(CASE WHEN {text} = '' THEN [] ELSE string_split({text}, '') END, lambda x: {each('x')}), '{sep}')"


def wrap(text: str) -> str:
    return f"rtrim(regexp_replace({text}, '(.{{80}})', '\\1' || chr(10), 'g'), chr(10))"


NUMBERS = joined("body", " ", number)
RULES_SQL = f"{PAIRS} SELECT seq_id, rule_id, {NUMBERS} AS symbols, used AS usage_count, n AS pair_count FROM rules"
ANALYSIS_SQL = f"{PAIRS} SELECT seq_id, rule_id, {NUMBERS} AS symbols, used AS usage_count, depth, length(dna) AS expanded_length, length(dna) - 1 AS assembly_index FROM rules"
LEVELS_SQL = f"{PAIRS} SELECT seq_id, rule_id, depth, length(dna) AS expanded_length, length(dna) - 1 AS assembly_index FROM rules"
EDGES_SQL = f"{PAIRS} SELECT seq_id, rule_id AS parent, {number('sym')} - 4 AS child, ordinal::INTEGER AS ordinal, '+' AS strand FROM bodies WHERE NOT {is_base('sym')}"
OPENED = joined("s", "", lambda x: of_rule(x, "list_transform(rules, lambda one: one.body)", x))
TO_DEPTH_SQL = f"""{PAIRS}, once AS (SELECT seq_id, rules, {OPENED} AS s FROM g), twice AS (SELECT seq_id, {OPENED} AS s FROM once)
SELECT seq_id, {joined("s", " ", number)} AS symbols FROM twice"""
STATS = "st AS (SELECT seq_id, count(*) AS n_rules, sum(length(body))::BIGINT AS rule_symbols, max(depth)::BIGINT AS max_depth, round(avg(used), 6) AS avg_usage, arg_min(rule_id, (-used, rule_id)) AS most_used_rule FROM rules GROUP BY seq_id), f AS (SELECT g.seq_id, length(s) AS final_symbols, length(dna) AS original_size FROM g JOIN s AS q USING (seq_id))"
STATS_SQL = f"""{PAIRS}, {STATS}
SELECT seq_id, original_size, final_symbols + coalesce(rule_symbols, 0) AS compressed_size,
  CASE WHEN original_size > 0 THEN round((final_symbols + coalesce(rule_symbols, 0)) / original_size, 6) ELSE 0.0::DOUBLE END AS ratio,
  coalesce(n_rules, 0) AS n_rules, coalesce(max_depth, 0) AS max_depth, final_symbols, coalesce(rule_symbols, 0) AS rule_symbols,
  CASE WHEN n_rules > 0 THEN round(rule_symbols / n_rules, 6) ELSE 0.0::DOUBLE END AS avg_symbols_per_rule, coalesce(avg_usage, 0.0::DOUBLE) AS avg_usage, most_used_rule
FROM f LEFT JOIN st USING (seq_id)"""
BACK = "list_reverse(list_transform(b, lambda x: CASE WHEN x BETWEEN 0 AND 3 THEN 3 - x ELSE -1 - x END))"
DEDUPLICATED_SQL = f"""{PAIRS}, b AS (SELECT seq_id, used, list_transform(string_split(body, ''), lambda x: {number('x')}) AS b FROM rules), c AS (SELECT seq_id, used, least(b, {BACK}) AS body FROM b)
SELECT seq_id, array_to_string(body, ' ') AS body, sum(used)::BIGINT AS usage_count, count(*) AS n_origins FROM c GROUP BY seq_id, body"""
MERGED = "m AS (SELECT row_number() OVER (ORDER BY length(dna), dna) - 1 AS rule_id, dna, length(dna) AS expanded_length, sum(used)::BIGINT AS usage_count, count(*) AS n_origins FROM rules GROUP BY dna)"
MERGED_SQL = f"{PAIRS}, {MERGED} SELECT * FROM m"
ORIGINS_SQL = f"{PAIRS}, {MERGED} SELECT seq_id, rules.rule_id AS old_rule_id, m.rule_id AS rule_id FROM rules JOIN m USING (dna)"
PREVIEW = "CASE WHEN length(dna) > 50 THEN substr(dna, 1, 50) || '...' ELSE dna END"
SUMMARY_SQL = f'{PAIRS} SELECT seq_id, rule_id AS "RuleID", used AS "UsageCount", length(dna) AS "ExpandedLength", {PREVIEW} AS "Preview" FROM rules WHERE used >= 2'
LONGEST_SQL = f"{PAIRS} SELECT seq_id, rule_id, {NUMBERS} AS symbols, used AS usage_count, dna, length(dna) AS expanded_length FROM rules ORDER BY length(dna) DESC, seq_id, rule_id LIMIT 20"


def lines(*parts: tuple) -> str:
    """Rows of lines; a part is (table, section, item, line, place, condition), the last two if they are needed."""
    out = []
    for table, section, item, line, *rest in parts:
        place, where = (rest + ["0", "true"][len(rest) :])[:2]
        out.append(f"SELECT seq_id, {section}::INTEGER AS section, ({item})::BIGINT AS item, ({place})::BIGINT AS place, {line} AS line FROM {table} WHERE {where}")
    return "\nUNION ALL ".join(out)


spaced = joined("body", " ", shown)
link = lambda a, b: f"concat_ws(chr(9), 'L', CASE WHEN {is_base(a)} THEN 'T_' || {a} ELSE (unicode({a}) - {FIRST})::VARCHAR END, '+', CASE WHEN {is_base(b)} THEN 'T_' || {b} ELSE (unicode({b}) - {FIRST})::VARCHAR END, '+', '0M')"
SEGMENT = "concat_ws(chr(9), 'S', rule_id::VARCHAR, dna, 'LN:i:' || length(dna))"
BOTH_RULES = f"NOT {is_base('sym')} AND next IS NOT NULL AND NOT {is_base('coalesce(next, sym)')}"
SEQUENCE = joined("s", " ", shown)

LINES_SQL = {
    "text_lines": PAIRS + lines(
        ("g", 0, "0", "'== Sequence =='"), ("g", 1, "0", joined("s", "", shown)), ("g", 2, "0", "''"), ("g", 3, "0", "'== Rules =='"),
        ("rules", 4, "rule_id", f"format('Rule {{}}: {{}} (usage: {{}})', rule_id, {joined('body', '', shown)}, used)"),
    ),
    "text_lines_full": PAIRS + lines(
        ("g", 0, "0", "format('== Final Sequence ({} symbols) ==', length(s))"), ("g", 1, "0", SEQUENCE), ("g", 2, "0", "''"), ("g", 3, "0", "format('== Rules ({} total) ==', len(rules))"),
        ("rules", 4, "rule_id", f"format('R{{}} [Usage={{}}] -> {{}}', rule_id, used, {spaced})"),
    ),
    "fasta_lines": PAIRS + lines(("rules", 0, "rule_id", f"format('>Rule_{{}} usage={{}} depth={{}}', rule_id, used, depth) || chr(10) || {wrap('dna')}")),
    "fasta_lines_full": PAIRS + lines(
        ("rules", 0, "rule_id", f"format('>Rule_{{}} [Usage={{}}] [Symbols=2]', rule_id, used) || chr(10) || {wrap('dna')}"),
        ("(SELECT g.seq_id, length(s) AS n, q.dna AS dna FROM g JOIN s AS q USING (seq_id))", 1, "0", f"format('>Final_Sequence [Length={{}}]', n) || chr(10) || {wrap('dna')}"),
    ),
    "gfa_lines": PAIRS + lines(("g", 0, "0", "'H' || chr(9) || 'VN:Z:1.0'"), ("rules", 1, "rule_id", SEGMENT), ("symbols", 2, "pos", link("sym", "next"), "0", BOTH_RULES)),
    "gfa_lines_rules": PAIRS + lines(("g", 0, "0", "'H' || chr(9) || 'VN:Z:1.0'"), ("rules", 1, "rule_id", SEGMENT), ("rules", 2, "rule_id", link("body[1]", "body[2]"))),
    "repeats_lines": PAIRS + lines(
        ("g", 0, "0", "concat_ws(chr(9), 'RuleID', 'UsageCount', 'ExpandedLength', 'Sequence(Preview)')"),
        ("rules", 1, "-used", f"concat_ws(chr(9), rule_id::VARCHAR, used::VARCHAR, length(dna)::VARCHAR, {PREVIEW})", "rule_id", "used >= 2"),
    ),
}
LINES_SQL["text_lines_wrapped"] = LINES_SQL["text_lines_full"].replace(f"1::INTEGER AS section, (0)::BIGINT AS item, (0)::BIGINT AS place, {SEQUENCE}", f"1::INTEGER AS section, (0)::BIGINT AS item, (0)::BIGINT AS place, {wrap(SEQUENCE)}")
LINES_SQL["gfa_top_lines"] = PAIRS + """,
top AS (SELECT * FROM rules QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY length(dna) DESC, rule_id) <= 5),
tb AS (SELECT bodies.* FROM bodies JOIN top USING (seq_id, rule_id)),
wanted AS (SELECT seq_id, rule_id FROM top UNION SELECT seq_id, unicode(sym) - %d FROM tb WHERE NOT %s),
seg AS (SELECT rules.* FROM rules JOIN wanted USING (seq_id, rule_id)),
used_bases AS (SELECT DISTINCT seq_id, sym FROM tb WHERE %s)
""" % (FIRST, is_base("sym"), is_base("sym")) + lines(
    ("g", 0, "0", "'H' || chr(9) || 'VN:Z:1.0'"), ("seg", 1, "rule_id", SEGMENT),
    ("used_bases", 2, number("sym"), "concat_ws(chr(9), 'S', 'T_' || sym, sym, 'LN:i:1')"),
    ("tb", 3, "rule_id", f"concat_ws(chr(9), 'L', rule_id::VARCHAR, '+', CASE WHEN {is_base('sym')} THEN 'T_' || sym ELSE (unicode(sym) - {FIRST})::VARCHAR END, '+', '0M')", "ordinal"),
)
LINES_SQL["stats_lines"] = f"""{PAIRS}, {STATS}, w AS (
  SELECT f.seq_id, coalesce(n_rules, 0) AS n, final_symbols, original_size, coalesce(max_depth, 0) AS deep, coalesce(rule_symbols, 0) AS total, CASE WHEN n_rules > 0 THEN 2.0 ELSE 0.0 END AS mean, original_size - final_symbols AS assembly
  FROM f LEFT JOIN st USING (seq_id))
""" + lines(
    ("w", 0, "0", "concat_ws(chr(10), '--- Grammar Statistics ---', 'Number of Rules: ' || n, 'Compressed Sequence Length (Symbols): ' || final_symbols, 'Compressed Sequence Length (Base Pairs): ' || original_size, 'Maximum Rule Depth: ' || deep, 'Total Symbols in Rule Definitions: ' || total, 'Average Symbols per Rule: ' || printf('%.2f', mean), 'Rules with Assembly Index calculated: ' || n, '--- End of Statistics ---')"),
    ("rules", 1, "rule_id", "format('Rule {}: assembly index {}, length {}, depth {}', rule_id, length(dna) - 1, length(dna), depth)"),
    ("w", 2, "0", "format('Total assembly index: {}', assembly)"),
)
DEPTH_COLOR = "CASE WHEN deepest = 0 THEN 'lightyellow' WHEN deep / deepest < 0.2 THEN 'lightgreen' WHEN deep / deepest < 0.4 THEN 'palegreen' WHEN deep / deepest < 0.6 THEN 'khaki' WHEN deep / deepest < 0.8 THEN 'lightsalmon' ELSE 'lightcoral' END"
BASE_COLOR = "CASE sym WHEN 'A' THEN 'lightgreen' WHEN 'C' THEN 'lightblue' WHEN 'G' THEN 'orange' ELSE 'pink' END"


def described(table: str, columns: str) -> str:
    """Symbols with their label and colour."""
    return f"""SELECT seq_id, {columns}, sym, CASE WHEN {is_base('sym')} THEN sym ELSE format('R{{}}({{}})', unicode(sym) - {FIRST}, g.rules[unicode(sym) - {FIRST - 1}].used) END AS label,
      CASE WHEN {is_base('sym')} THEN {BASE_COLOR} ELSE {DEPTH_COLOR} END AS color
    FROM (SELECT *, {of_rule('sym', 'g.depths', '0')} AS deep, coalesce(list_max(g.depths), 0) AS deepest FROM {table} JOIN (SELECT seq_id, rules, depths FROM g) AS g USING (seq_id))"""


LINES_SQL["dot_lines"] = f"""{PAIRS}, ds AS ({described('(SELECT seq_id, pos, sym, next FROM symbols)', 'pos, next').replace('g.rules[', 'rules[')}),
di AS ({described('bodies', 'rule_id, ordinal, size').replace('g.rules[', 'rules[')})
""" + lines(
    ("g", 0, "0", "concat_ws(chr(10), 'digraph Grammar {', '  graph [rankdir=LR];', '  node [shape=box, style=filled, fontname=\"Arial\"];', '  subgraph cluster_sequence {', '    label=\"Main Sequence\";', '    style=filled;', '    color=lightblue;')"),
    ("ds", 1, "pos", "format('    seq_{} [label=\"{}\", color={}];', pos, label, color)"),
    ("ds", 2, "pos", "format('    seq_{} -> seq_{};', pos, pos + 1)", "0", "next IS NOT NULL"),
    ("g", 3, "0", "'  }' || chr(10)"),
    ("rules", 4, "rule_id", "concat_ws(chr(10), '  subgraph cluster_rule_' || rule_id || ' {', '    label=\"Rule ' || rule_id || '\";', '    style=filled;', '    color=lightgrey;')", "-1"),
    ("di", 4, "rule_id", "format('    rule_{}_{} [label=\"{}\", color={}];', rule_id, ordinal, label, color)", "2 * ordinal"),
    ("di", 4, "rule_id", "format('    rule_{}_{} -> rule_{}_{};', rule_id, ordinal, rule_id, ordinal + 1)", "2 * ordinal + 1", "ordinal + 1 < size"),
    ("rules", 4, "rule_id", "'  }' || chr(10)", "2 * length(body)"),
    ("di", 5, "rule_id", f"format('  rule_{{}}_{{}} -> rule_{{}}_0 [style=dashed, color=blue];', rule_id, ordinal, unicode(sym) - {FIRST})", "2 * ordinal", f"NOT {is_base('sym')}"),
    ("g", 9, "0", "'}'"),
)
NODE = f"CASE WHEN {is_base('sym')} THEN 'T_' || sym ELSE 'R' || (unicode(sym) - {FIRST}) END"
LINES_SQL["dot_lines_graph"] = PAIRS + lines(
    ("g", 0, "0", "concat_ws(chr(10), 'digraph Grammar {', '  rankdir=LR;', '  node [shape=box, style=filled, fillcolor=lightgrey];')"),
    ("rules", 1, "rule_id", "format('  R{} [label=\"R{} (Usage={})\", shape=box, fillcolor=lightblue];', rule_id, rule_id, used)"),
    (f"(SELECT DISTINCT seq_id, sym FROM bodies WHERE {is_base('sym')})", 2, number("sym"), f"format('  T_{{}} [label=\"{{}}\", shape=ellipse, fillcolor=white];', sym, sym)"),
    ("bodies", 3, "rule_id", f"format('  R{{}} -> {{}};', rule_id, {NODE})", "ordinal"),
    ("g", 9, "0", "'}'"),
)
KEYS = "".join(f"|  <key id=\"{i}\" for=\"node\" attr.name=\"{n}\" attr.type=\"{t}\"/>" for i, n, t in (("d_label", "label", "string"), ("d_type", "type", "string"), ("d_usage", "usage_count", "int"), ("d_depth", "depth", "int")))
LINES_SQL["graphml_lines"] = PAIRS + lines(
    ("g", 0, "0", f"replace('<?xml version=\"1.0\" encoding=\"UTF-8\"?>|<graphml xmlns=\"http://graphml.graphdrawing.org/xmlns\">{KEYS}|  <graph id=\"G\" edgedefault=\"directed\">', '|', chr(10))"),
    ("rules", 1, "rule_id", "format('    <node id=\"R{}\"><data key=\"d_label\">R{}</data><data key=\"d_type\">rule</data><data key=\"d_usage\">{}</data><data key=\"d_depth\">{}</data></node>', rule_id, rule_id, used, depth)"),
    ("bodies", 1, "rule_id", "format('    <node id=\"T_{}_R{}_{}\"><data key=\"d_label\">{}+</data><data key=\"d_type\">terminal</data></node>', sym, rule_id, ordinal, sym)", "0", is_base("sym")),
    ("bodies", 2, "rule_id", f"format('    <edge id=\"E_R{{}}_{{}}\" source=\"R{{}}\" target=\"{{}}\"/>', rule_id, ordinal, rule_id, CASE WHEN {is_base('sym')} THEN format('T_{{}}_R{{}}_{{}}', sym, rule_id, ordinal) ELSE 'R' || (unicode(sym) - {FIRST}) END)"),
    ("symbols", 2, "0", f"format('    <edge id=\"E_S_{{}}\" source=\"R{{}}\" target=\"R{{}}\"/>', pos, unicode(sym) - {FIRST}, unicode(next) - {FIRST})", "0", BOTH_RULES),
    ("g", 9, "0", "'  </graph>' || chr(10) || '</graphml>'"),
)


def json_symbols(text: str) -> str:
    one = f"CASE WHEN {is_base('x')} THEN format('{{{{\"id\":{{}},\"type\":\"terminal\",\"value\":\"{{}}+\",\"strand\":\"+\"}}}}', i - 1, x) ELSE format('{{{{\"id\":{{}},\"type\":\"non_terminal\",\"rule_id\":{{}},\"strand\":\"+\"}}}}', i - 1, unicode(x) - {FIRST}) END"
    return f"'[' || array_to_string(list_transform(CASE WHEN {text} = '' THEN [] ELSE string_split({text}, '') END, lambda x, i: {one}), ',') || ']'"


LINES_SQL["json_object_lines"] = PAIRS + f""", j AS (
  SELECT seq_id, string_agg(format('"{{}}":{{{{"symbols":{{}},"usage_count":{{}},"depth":{{}}}}}}', rule_id, {json_symbols('body')}, used, depth), ',' ORDER BY rule_id) AS rules_json FROM rules GROUP BY seq_id)
""" + lines(("(SELECT g.seq_id AS seq_id, s, rules_json FROM g LEFT JOIN j USING (seq_id))", 0, "0", f"'{{\"final_sequence\":' || {json_symbols('s')} || ',\"rules\":{{' || coalesce(rules_json, '') || '}}}}'"))

KMER_RULES_SQL = f"{build(4)} SELECT seq_id, rule_id, {NUMBERS} AS symbols, used AS usage_count, n AS pair_count FROM rules"

EVICTED_SQL = f"""{PAIRS},
e(seq_id, s, b, late) USING KEY (seq_id) AS (
  SELECT seq_id, any_value(g.s), list({{'r': rule_id, 'c': chr(({FIRST} + rule_id)::INTEGER), 'body': body, 'n': n}} ORDER BY rule_id), false FROM rules JOIN (SELECT seq_id, s FROM g) AS g USING (seq_id) GROUP BY seq_id
  UNION
  SELECT seq_id, replace(s, x.c, x.body), list_transform(list_filter(b, lambda y: y.r <> x.r), lambda y: {{'r': y.r, 'c': y.c, 'body': replace(y.body, x.c, x.body), 'n': y.n}}), late OR uses > 1
  FROM (SELECT seq_id, s, b, late, best.uses AS uses, best.x AS x FROM (
    SELECT *, list_sort(list_transform(b, lambda y: {{'uses': length(whole) - length(replace(whole, y.c, '')), 'newest': -y.r, 'x': y}}))[1] AS best
    FROM (SELECT *, s || array_to_string(list_transform(b, lambda y: y.body), '') AS whole FROM e WHERE len(b) > 0)))
  WHERE (NOT late AND uses <= 1) OR len(b) > 8),
left_rules AS (SELECT seq_id, s || array_to_string(list_transform(b, lambda y: y.body), '') AS whole, unnest(b) AS x FROM e)
SELECT seq_id, x.r AS rule_id, {joined('x.body', ' ', number).replace('lambda x:', 'lambda z:').replace("unicode(x)", "unicode(z)").replace("'ACGT', x)", "'ACGT', z)")} AS symbols, length(whole) - length(replace(whole, x.c, '')) AS usage_count, x.n AS pair_count FROM left_rules"""

#: Fixed value of the word hash, and its steps in SQL over a list of words.
FX = 0x517CC1B727220A95
TWO_64 = 2**64


def fx_sql(words: str) -> str:
    """The word hash of a list of small numbers, as a signed 64-bit number."""
    step = f"((xor(((h * 32) % {TWO_64}::UHUGEINT) + (h // {2**59}::UHUGEINT), w)) * {FX}::UHUGEINT) % {TWO_64}::UHUGEINT"
    h = f"list_reduce({words}, lambda h, w: {step}, 0::UHUGEINT)"
    return f"(CASE WHEN {h} >= {2**63}::UHUGEINT THEN ({h}::HUGEINT - {TWO_64}::HUGEINT) ELSE {h}::HUGEINT END)::BIGINT"


def codes_sql(text: str) -> str:
    return f"list_transform(CASE WHEN {text} = '' THEN [] ELSE string_split({text}, '') END, lambda x: (instr('ACGT', x) - 1)::UHUGEINT)"


FINGERPRINTS_SQL = f"WITH {SEQUENCES} SELECT seq_id, {fx_sql(codes_sql('dna'))} AS fingerprint FROM s"


def window_fingerprints_sql(w: int) -> str:
    return f"""WITH {SEQUENCES}, k AS (SELECT seq_id, i - 1 AS pos, substr(dna, i, {w}) AS kmer FROM (SELECT seq_id, dna, unnest(range(1, length(dna) - {w} + 2)) AS i FROM s)),
f AS (SELECT kmer, {fx_sql(codes_sql('kmer'))} AS fingerprint FROM (SELECT DISTINCT kmer FROM k))
SELECT seq_id, pos, fingerprint FROM k JOIN f USING (kmer)"""


def phrases(prints: dict[str, int], window: int = 8, shortest: int = 2, longest: int = 256) -> str:
    """p: seq_id, start, len, content of the first level's phrases; prints are the fingerprints of two bases, and of one at the end."""
    values = ", ".join(f"('{k}', {v}::UBIGINT)" for k, v in prints.items())
    half = window // 2
    return f"""WITH {SEQUENCES}, v(bases, p) AS (VALUES {values}),
marked AS (SELECT seq_id, i, p FROM (SELECT seq_id, i, substr(dna, i, 2) AS bases FROM (SELECT seq_id, dna, unnest(range(1, length(dna) + 1)) AS i FROM s)) JOIN v USING (bases)),
w AS (SELECT seq_id, i, p = min(p) OVER (PARTITION BY seq_id ORDER BY i ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS least FROM marked),
l AS (SELECT seq_id, list(least ORDER BY i) AS least FROM w GROUP BY seq_id),
c AS (SELECT seq_id, list_reduce(list_transform(range(1, len(least)), lambda i: [i]),
  lambda acc, x: CASE WHEN (least[x[1] + 1] AND x[1] - acc[-1] >= {shortest}) OR x[1] - acc[-1] >= {longest} THEN list_concat(acc, x) ELSE acc END, [0::BIGINT]) AS cuts FROM l),
p AS (SELECT seq_id, a AS start, b - a AS len, substr(dna, a + 1, b - a) AS content FROM (
  SELECT seq_id, dna, cuts[k] AS a, coalesce(cuts[k + 1], length(dna)) AS b FROM (SELECT *, unnest(range(1, len(cuts) + 1)) AS k FROM c JOIN s USING (seq_id))))
"""


A, B = number("sym"), number("next")
SYMBOL_DIGRAMS_SQL = f"""{PAIRS}, d AS (SELECT {A}::BIGINT AS a, {B}::BIGINT AS b FROM symbols WHERE next IS NOT NULL),
c AS (SELECT CASE WHEN a < 4 AND b < 4 THEN least([a, b], [3 - b, 3 - a]) WHEN a = b THEN [-1 - b, -1 - a] ELSE [a, b] END AS kmer FROM d)
SELECT array_to_string(kmer, ' ') AS kmer, count(*) AS n FROM c GROUP BY kmer"""
WORDS = f"list_transform(flatten(list_transform(string_split(body, ''), lambda x: CASE WHEN {is_base('x')} THEN [0, {number('x')}, 0] ELSE [1, {number('x')} - 4, 0] END)), lambda v: v::UHUGEINT)"
RULE_PRINTS_SQL = f"{PAIRS} SELECT seq_id, rule_id, {fx_sql(WORDS)} AS fingerprint FROM rules"
DNA_FASTA_SQL = f"WITH {SEQUENCES} " + lines(("s", 0, "0", f"'>Sequence' || chr(10) || {wrap('dna')}"))
