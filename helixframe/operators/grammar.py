"""Analysis, expansion, simplification and merging of grammars."""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import bounded
from ..functions.dna import is_rule, reverse_complement, rule_of
from ..shared import keep
from .ranges import with_starts
from .repair import GRAMMAR, RULES, _grammar_batch

COMPLEMENT = str.maketrans("ACGTacgt", "TGCAtgca")


class GrammarError(ValueError):
    """A rule that is missing, or that contains itself."""


def order_rules(rules: dict[int, list[int]]) -> list[int]:
    """Rule ids with children before parents; raises on missing rules and cycles."""
    state: dict[int, int] = {}
    out: list[int] = []
    for first in sorted(rules):
        stack = [(first, False)]
        while stack:
            r, done = stack.pop()
            if done:
                state[r] = 2
                out.append(r)
            elif state.get(r) == 1:
                raise GrammarError(f"rule {r} contains itself")
            elif r not in state:
                if r not in rules:
                    raise GrammarError(f"rule {r} is missing")
                state[r] = 1
                stack.append((r, True))
                for s in rules[r]:
                    if s >= 4 or s < 0:
                        child = s - 4 if s >= 4 else -5 - s
                        if state.get(child) == 1:
                            raise GrammarError(f"rule {child} contains itself")
                        if child not in state:
                            stack.append((child, False))
    return out


def text_of(sym: int, texts: dict[int, str]) -> str:
    if 0 <= sym <= 3:
        return "ACGT"[sym]
    return texts[sym - 4] if sym >= 4 else texts[-5 - sym][::-1].translate(COMPLEMENT)


def expand_all(rules: dict[int, list[int]]) -> dict[int, str]:
    texts: dict[int, str] = {}
    for r in order_rules(rules):
        texts[r] = "".join(text_of(s, texts) for s in rules[r])
    return texts


class Expander:
    """The texts of a grammar's symbols, by symbol; those of the other strand are made when they are met."""

    def __init__(self, bodies: dict[int, list[int]]):
        ids = list(bodies)
        in_order = ids == list(range(len(ids))) and all(max(body, default=0) < 4 + r and min(body, default=0) >= -4 - r for r, body in bodies.items())
        self.texts = dict(enumerate("ACGT"))
        for r in ids if in_order else order_rules(bodies):
            self.texts[4 + r] = self.text(bodies[r])

    def __missing__(self, sym: int) -> str:
        self.texts[sym] = found = self.texts[-1 - sym][::-1].translate(COMPLEMENT)
        return found

    def text(self, symbols: list[int]) -> str:
        texts = self.texts
        try:
            return "".join([texts[s] for s in symbols])
        except KeyError:
            return "".join([texts[s] if s in texts else self.__missing__(s) for s in symbols])


def grammars_in(batch) -> list[tuple[list[int], dict[int, list[int]]]]:
    """(symbols, bodies by rule id) of each grammar of a batch."""
    rules = batch.column("rules")
    flat = rules.flatten()
    ids, bodies = flat.field("rule_id").to_pylist(), flat.field("symbols")
    numbers, edges = bodies.flatten().to_pylist(), bodies.offsets.to_numpy() - (bodies.offsets[0].as_py() if len(bodies.offsets) else 0)
    cut = list(map(numbers.__getitem__, map(slice, edges[:-1].tolist(), edges[1:].tolist())))
    out, at = [], 0
    symbols = batch.column("symbols").to_pylist() if "symbols" in batch.schema.names else [[]] * len(rules)
    for own, n in zip(symbols, pa.compute.list_value_length(rules).to_pylist()):
        n = n or 0
        out.append((own or [], dict(zip(ids[at : at + n], cut[at : at + n]))))
        at += n
    return out


def analyze_rules(rules: dict[int, list[int]], on_cycle: str = "raise") -> dict[int, tuple[int, int, int]]:
    """Rule id to (depth, expanded length, assembly index).

    Depth is 1 more than the deepest child.  The assembly index adds up the
    children's and one join between neighbours.  With ``on_cycle`` fallback, rules of a cycle and those
    with missing rules get depth 0 and the joins of their own symbols.
    """
    try:
        order = order_rules(rules)
    except GrammarError:
        if on_cycle != "fallback":
            raise
        order, users, open_ = [], {}, {}
        for r, body in rules.items():
            needs = {s - 4 if s >= 4 else -5 - s for s in body if not 0 <= s <= 3}
            open_[r] = len(needs)
            for c in needs:
                users.setdefault(c, []).append(r)
        ready = sorted(r for r, n in open_.items() if not n)
        while ready:
            order += ready
            after = []
            for r in ready:
                for user in users.get(r, ()):
                    open_[user] -= 1
                    if not open_[user]:
                        after.append(user)
            ready = sorted(after)
    out: dict = {}
    for r in order:
        parts = [out[s - 4 if s >= 4 else -5 - s] if not 0 <= s <= 3 else (0, 1, 0) for s in rules[r]]
        out[r] = (1 + max((p[0] for p in parts), default=0), sum(p[1] for p in parts), sum(p[2] for p in parts) + max(0, len(parts) - 1))
    for r, body in rules.items():
        out.setdefault(r, (0, sum(0 <= s <= 3 for s in body), max(0, len(body) - 1)))
    return out


def _bodies(rules) -> dict[int, list[int]]:
    return {r["rule_id"]: r["symbols"] for r in rules or []}


def explode_rules(grammars: DataFrame) -> DataFrame:
    """seq_id, rule_id, symbols, usage_count, pair_count."""
    return grammars.select("seq_id", F.inline("rules"))


def explode_symbols(grammars: DataFrame) -> DataFrame:
    """seq_id, pos, sym of the final sequences."""
    return grammars.select("seq_id", F.posexplode("symbols").alias("pos", "sym"))


def rule_edges(rules: DataFrame) -> DataFrame:
    """seq_id, parent, child, ordinal, strand: uses of rules in rules."""
    rows = rules.select("seq_id", F.col("rule_id").alias("parent"), F.posexplode("symbols").alias("ordinal", "sym")).where(is_rule("sym"))
    return rows.select("seq_id", "parent", rule_of("sym").alias("child"), "ordinal", F.when(F.col("sym") < 0, "-").otherwise("+").alias("strand"))


def analyze(grammars: DataFrame, on_cycle: str = "raise") -> DataFrame:
    """seq_id, rule_id, symbols, usage_count, depth, expanded_length, assembly_index; a grammar is handled in one task."""
    schema = "seq_id long, rule_id long, symbols array<long>, usage_count long, depth int, expanded_length long, assembly_index long"

    def run(batches):
        for batch in bounded(batches):
            rows = []
            for _, bodies in grammars_in(batch):
                found = analyze_rules(bodies, on_cycle)
                rows += [found[r] for r in bodies]
            kinds = [pa.int32(), pa.int64(), pa.int64()]
            yield with_rules(batch, [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 3, kinds)], ["depth", "expanded_length", "assembly_index"])

    return grammars.select("seq_id", "rules").mapInArrow(run, schema)


MOST_IN_A_TASK = 50_000  # rules of one grammar that a task takes together


def rule_levels(rules: DataFrame, most: int = MOST_IN_A_TASK) -> DataFrame:
    """seq_id, rule_id, depth, expanded_length, assembly_index of rules.

    Grammars of up to ``most`` rules are brought together, once, and handled in tasks; those of more by rounds of joins.
    Rules that are missing or in a cycle are an error.
    """

    def run(batches):
        seq_id, held, large = None, {}, False
        known: list = []
        raw: list = []

        def close():
            try:
                known.extend((seq_id, r, *x) for r, x in analyze_rules(held).items())
            except GrammarError:  # the rounds say so to the driver
                raw.extend((seq_id, r, body) for r, body in held.items())

        def rows():
            columns = list(zip(*((*k[:2], None, *k[2:]) for k in known), *((*r, None, None, None) for r in raw))) or [()] * 6
            known.clear()
            raw.clear()
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["seq_id", "rule_id", "symbols", "depth", "expanded_length", "assembly_index"])

        for batch in bounded(batches):
            for now, r, body in zip(*(batch.column(c).to_pylist() for c in ("seq_id", "rule_id", "symbols"))):
                if now != seq_id:
                    close()
                    seq_id, held, large = now, {}, False
                held[r] = body
                if large or len(held) > most:
                    raw.extend((seq_id, r, body) for r, body in held.items())
                    held, large = {}, True
            yield rows()
        close()
        yield rows()

    schema = "seq_id long, rule_id long, symbols array<long>, depth int, expanded_length long, assembly_index long"
    found = keep(rules.select("seq_id", "rule_id", "symbols").repartition("seq_id").sortWithinPartitions("seq_id", "rule_id").mapInArrow(run, schema))
    done, left = found.where(F.col("symbols").isNull()).drop("symbols"), found.where(F.col("symbols").isNotNull())
    return done if left.isEmpty() else done.unionByName(levels_by_rounds(left))


def levels_by_rounds(rules: DataFrame) -> DataFrame:
    """The same of rules too many for one task: a round of joins for each level; each round's rules are written out."""
    symbols = keep(rules.select("seq_id", "rule_id", F.posexplode("symbols").alias("ordinal", "sym")))
    size = keep(symbols.groupBy("seq_id", "rule_id").agg(F.count("*").alias("m"), F.count(F.when(~is_rule("sym"), 1)).alias("plain")))
    edges = keep(symbols.where(is_rule("sym")).select("seq_id", "rule_id", rule_of("sym").alias("child")))
    done = keep(size.where("m = plain").select("seq_id", "rule_id", F.lit(1).alias("depth"), F.col("m").alias("expanded_length"), (F.col("m") - 1).alias("assembly_index")))
    left = keep(size.where("m > plain"))
    while not left.isEmpty():
        known = done.select("seq_id", F.col("rule_id").alias("child"), "depth", "expanded_length", "assembly_index")
        sums = edges.join(known, ["seq_id", "child"]).groupBy("seq_id", "rule_id").agg(F.count("*").alias("found"), F.max("depth").alias("deepest"), F.sum("expanded_length").alias("length"), F.sum("assembly_index").alias("index"))
        ready = left.join(sums, ["seq_id", "rule_id"]).where(F.col("found") + F.col("plain") == F.col("m"))
        ready = keep(ready.select("seq_id", "rule_id", (F.col("deepest") + 1).alias("depth"), (F.col("length") + F.col("plain")).alias("expanded_length"), (F.col("index") + F.col("m") - 1).alias("assembly_index")))
        if ready.isEmpty():
            raise GrammarError("a rule is missing or contains itself")
        done = keep(done.unionByName(ready))
        left = keep(left.join(ready, ["seq_id", "rule_id"], "left_anti"))
    return done


def expand(grammars: DataFrame) -> DataFrame:
    """seq_id, dna: the text each grammar stands for."""

    def run(batches):
        for batch in bounded(batches):
            out = [Expander(bodies).text(symbols) for symbols, bodies in grammars_in(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("seq_id"), pa.array(out, pa.string())], ["seq_id", "dna"])

    return grammars.select("seq_id", "symbols", "rules").mapInArrow(run, "seq_id long, dna string")


def expand_rules(grammars: DataFrame) -> DataFrame:
    """seq_id, rule_id, symbols, usage_count, dna."""

    def run(batches):
        for batch in bounded(batches):
            texts = []
            for _, bodies in grammars_in(batch):
                known = Expander(bodies).texts
                texts += [known[4 + r] for r in bodies]
            yield with_rules(batch, [pa.array(texts, pa.string())], ["dna"])

    return grammars.select("seq_id", "rules").mapInArrow(run, "seq_id long, rule_id long, symbols array<long>, usage_count long, dna string")


def with_rules(batch, columns: list, names: list[str]) -> pa.RecordBatch:
    """A row for each rule of a batch: seq_id, rule_id, symbols, usage_count and further columns."""
    rules = batch.column("rules")
    flat = rules.flatten()
    n = pa.compute.fill_null(pa.compute.list_value_length(rules), 0).to_numpy(zero_copy_only=False)
    owner = batch.column("seq_id").take(pa.array(np.repeat(np.arange(len(n)), n)))
    return pa.RecordBatch.from_arrays([owner, *(flat.field(c) for c in ("rule_id", "symbols", "usage_count")), *columns], ["seq_id", "rule_id", "symbols", "usage_count", *names])


def sequence_assembly_index(grammars: DataFrame) -> DataFrame:
    """seq_id, assembly_index: summed over the rule symbols of each final sequence."""
    rules = analyze(grammars).select("seq_id", "rule_id", "assembly_index")
    used = explode_symbols(grammars).where(is_rule("sym")).select("seq_id", rule_of("sym").alias("rule_id"))
    sums = used.join(rules, ["seq_id", "rule_id"]).groupBy("seq_id").agg(F.sum("assembly_index").alias("assembly_index"))
    return grammars.select("seq_id").join(sums, "seq_id", "left").withColumn("assembly_index", F.coalesce("assembly_index", F.lit(0)))


def compression_stats(grammars: DataFrame) -> DataFrame:
    """Per sequence: original and compressed size, ratio, rules, max depth, symbols in rules and their mean, usage mean, most used rule."""
    rules = analyze(grammars)
    used = F.min(F.struct(-F.col("usage_count"), "rule_id"))
    sums = rules.groupBy("seq_id").agg(F.count("*").alias("n_rules"), F.sum(F.size("symbols")).alias("rule_symbols"), F.max("depth").alias("max_depth"), F.round(F.avg("usage_count"), 6).alias("avg_usage"), used.alias("u"))
    covered = explode_symbols(grammars).withColumn("rule_id", rule_of("sym")).join(rules.select("seq_id", "rule_id", "expanded_length"), ["seq_id", "rule_id"], "left").groupBy("seq_id").agg(F.sum(F.coalesce("expanded_length", F.lit(1))).alias("original_size"))
    out = grammars.select("seq_id", F.size("symbols").cast("long").alias("final_symbols")).join(covered, "seq_id", "left").join(sums, "seq_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    size = F.col("final_symbols") + zero("rule_symbols")
    ratio = F.when(zero("original_size") > 0, F.round(size / zero("original_size"), 6)).otherwise(0.0)
    mean = F.when(zero("n_rules") > 0, F.round(zero("rule_symbols") / zero("n_rules"), 6)).otherwise(0.0)
    return out.select("seq_id", zero("original_size").alias("original_size"), size.alias("compressed_size"), ratio.alias("ratio"), zero("n_rules").alias("n_rules"), zero("max_depth").alias("max_depth"), "final_symbols", zero("rule_symbols").alias("rule_symbols"), mean.alias("avg_symbols_per_rule"), F.coalesce("avg_usage", F.lit(0.0)).alias("avg_usage"), F.col("u.rule_id").alias("most_used_rule"))


def inline_rules(symbols: list[int], rules: dict[int, list[int]], gone: set[int]):
    """Puts the bodies of some rules in the place of their symbols, in bodies too."""
    bodies: dict[int, list[int]] = {}

    def opened(body):
        out = []
        for s in body:
            r = s - 4 if s >= 4 else -5 - s
            if not 0 <= s <= 3 and r in gone:
                inner = bodies[r]
                out += inner if s >= 4 else [3 - x if 0 <= x <= 3 else -1 - x for x in reversed(inner)]
            else:
                out.append(s)
        return out

    for r in order_rules(rules):
        bodies[r] = opened(rules[r])
    return opened(symbols), {r: b for r, b in bodies.items() if r not in gone}


def references(symbols: list[int], rules: dict[int, list[int]]) -> dict[int, int]:
    out = dict.fromkeys(rules, 0)
    for body in [symbols, *rules.values()]:
        for s in body:
            if not 0 <= s <= 3:
                r = s - 4 if s >= 4 else -5 - s
                out[r] = out.get(r, 0) + 1
    return out


def evict(symbols: list[int], rules: dict[int, list[int]], most: int):
    """Inlines the least used rules, ties to the newest, until ``most`` are left.

    Counts change only as bodies are copied: an inlined rule adds what its body holds,
    once for each use but one.  The bodies are put in place together at the end.
    """
    n, gone = references(symbols, rules), set()
    opened = {r: Counter(s - 4 if s >= 4 else -5 - s for s in body if not 0 <= s <= 3) for r, body in rules.items()}
    users: dict[int, set] = {r: set() for r in rules}
    for r, held in opened.items():
        for c in held:
            users[c].add(r)
    heap = [(k, -r) for r, k in n.items()]
    heapq.heapify(heap)
    while len(rules) - len(gone) > most:
        k, r = heapq.heappop(heap)
        r = -r
        if r in gone or n[r] != k:
            continue
        gone.add(r)
        for c, held in opened[r].items():
            users[c].discard(r)
            n[c] += held * (k - 1)
            heapq.heappush(heap, (n[c], -c))
        for user in users.pop(r):
            times = opened[user].pop(r)
            for c, held in opened[r].items():
                opened[user][c] += times * held
                users[c].add(user)
    return inline_rules(symbols, rules, gone)


def simplify(grammars: DataFrame, inline_single: bool = True, most_rules: int | None = None) -> DataFrame:
    """Grammar rows with rules of one reference put in their place and, beyond ``most_rules``, the least used ones (ties: the newest).

    usage_count becomes the true number of references; rules keep their numbers.
    """

    def one(symbols, rules):
        bodies = _bodies(rules)
        chosen = {r["rule_id"]: r["pair_count"] for r in rules}
        while inline_single:
            once = {r for r, n in references(symbols, bodies).items() if n <= 1}
            if not once:
                break
            symbols, bodies = inline_rules(symbols, bodies, once)
        if most_rules is not None and len(bodies) > most_rules:
            symbols, bodies = evict(symbols, bodies, most_rules)
        n = references(symbols, bodies)
        return symbols, [{"rule_id": r, "symbols": bodies[r], "usage_count": n[r], "pair_count": chosen[r]} for r in sorted(bodies)]

    def run(batches):
        for batch in bounded(batches):
            found = [one(s or [], r or []) for s, r in zip(batch.column("symbols").to_pylist(), batch.column("rules").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("seq_id"), pa.array([s for s, _ in found], pa.list_(pa.int64())), pa.array([r for _, r in found], RULES)], ["seq_id", "symbols", "rules"])

    return grammars.select("seq_id", "symbols", "rules").mapInArrow(run, GRAMMAR)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Adds ``number``, from 0, in the order of the columns; rows are sorted by range, and only counts of ranges are summed in one task."""
    ranged = keep(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("_range", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_place", place).join(F.broadcast(bases), "_range").withColumn("number", F.col("_place") + F.col("_before")).drop("_range", "_place", "_before")


#: The modulus and the bases of the two hashes that rules are known by.
MODULUS = 2**61 - 1
BASES = (806_515_533_049_393, 1_304_969_544_928_657)


def content_of(bodies: dict[int, list[int]]) -> dict[int, tuple]:
    """Rule id to (length, two hashes of what it expands to, two of its reverse complement).

    Both are put together from those of the rule's symbols, children first; nothing is expanded.
    """
    one = {c: ((1, BASES, (c + 1,) * 2, (4 - c,) * 2)) for c in range(4)}
    known: dict[int, tuple] = {}
    for r in order_rules(bodies):
        n, power, ahead, back = 0, (1, 1), (0, 0), (0, 0)
        for s in bodies[r]:
            size, p, f, b = one[s] if 0 <= s <= 3 else known[s - 4 if s >= 4 else -5 - s]
            f, b = (b, f) if s < 0 else (f, b)
            ahead = tuple((x * q + y) % MODULUS for x, q, y in zip(ahead, p, f))
            back = tuple((y * q + x) % MODULUS for x, q, y in zip(back, power, b))
            n, power = n + size, tuple(x * q % MODULUS for x, q in zip(power, p))
        known[r] = (n, power, ahead, back)
    return {r: (n, *ahead, *back) for r, (n, _, ahead, back) in known.items()}


CONTENT = ("length", "high", "low")


def rule_contents(grammars: DataFrame, either_strand: bool, *by: str) -> DataFrame:
    """by, old_rule_id, usage_count, pair_count, length, high, low, turned of each rule: what it is known by.

    With ``either_strand`` a rule and its reverse complement have the hashes of the lesser, and ``turned`` says that these are the other strand's.
    Two rules of different content are taken for one with a probability below length / 2**120.
    """
    kinds = grammars.select(*by).schema

    def run(batches):
        for batch in bounded(batches):
            rules = batch.column("rules")
            flat, rows = rules.flatten(), []
            for _, bodies in grammars_in(batch):
                found = content_of(bodies)
                for r in bodies:
                    n, *prints = found[r]
                    turned = either_strand and prints[2:] < prints[:2]
                    rows.append((n, *(prints[2:] if turned else prints[:2]), turned))
            owner = pa.array(np.repeat(np.arange(len(rules)), pa.compute.fill_null(pa.compute.list_value_length(rules), 0).to_numpy(zero_copy_only=False)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, [pa.int64()] * 3 + [pa.bool_()])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(owner) for c in by), *(flat.field(c) for c in ("rule_id", "usage_count", "pair_count")), *columns], [*by, "old_rule_id", "usage_count", "pair_count", *CONTENT, "turned"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds)
    return grammars.select(*by, "rules").mapInArrow(run, f"{schema}, old_rule_id long, usage_count long, pair_count long, length long, high long, low long, turned boolean")


def chosen_texts(grammars: DataFrame, chosen: DataFrame) -> DataFrame:
    """seq_id, old_rule_id, dna of the chosen rules (seq_id, old_rule_id); no others are expanded."""
    wanted = chosen.groupBy(F.col("seq_id").alias("of")).agg(F.collect_list("old_rule_id").alias("wanted"))

    def run(batches):
        for batch in bounded(batches):
            ids, texts, owners = [], [], []
            for seq_id, want, (_, bodies) in zip(batch.column("seq_id").to_pylist(), batch.column("wanted").to_pylist(), grammars_in(batch)):
                for r in want:
                    ids.append(r)
                    texts.append(expansion(4 + r, bodies))
                    owners.append(seq_id)
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["seq_id", "old_rule_id", "dna"])

    return grammars.select("seq_id", "rules").join(wanted, F.col("seq_id") == F.col("of")).mapInArrow(run, "seq_id long, old_rule_id long, dna string")


def expansion(sym: int, bodies: dict[int, list[int]]) -> str:
    """The bases of one symbol; no other rules are opened than those in it."""
    out, stack = [], [sym]
    while stack:
        s = stack.pop()
        if 0 <= s <= 3:
            out.append("ACGT"[s])
        else:
            body = bodies[s - 4 if s >= 4 else -5 - s]
            stack.extend(reversed(body) if s >= 4 else (3 - x if 0 <= x <= 3 else -1 - x for x in body))
    return "".join(out)


def merge_grammars(grammars: DataFrame, either_strand: bool = False) -> tuple[DataFrame, DataFrame]:
    """One grammar of many: rules (rule_id, dna, expanded_length, usage_count, n_origins) and origins (seq_id, old_rule_id, rule_id, flipped).

    Rules that expand to the same DNA are one, and with ``either_strand`` those that expand to
    each other's reverse complement, of which the lesser stays and the other's origins are
    flipped.  They are known by hashes; one rule of each content is expanded, and they are numbered by length and DNA.
    """
    known = keep(rule_contents(grammars, either_strand, "seq_id"))
    same = known.groupBy(*CONTENT).agg(F.sum("usage_count").alias("usage_count"), F.count("*").alias("n_origins"), F.min(F.struct("seq_id", "old_rule_id", "turned")).alias("one"))
    same = keep(same.select(*CONTENT, "usage_count", "n_origins", "one.*"))
    texts = same.join(chosen_texts(grammars, same.select("seq_id", "old_rule_id")), ["seq_id", "old_rule_id"])
    hashed = F.when(F.col("turned"), reverse_complement("dna")).otherwise(F.col("dna"))
    dna = F.least(F.col("dna"), reverse_complement("dna")) if either_strand else F.col("dna")
    named = texts.select(*CONTENT, dna.alias("dna"), F.col("length").alias("expanded_length"), "usage_count", "n_origins", (dna != hashed).alias("swapped"))
    named = keep(numbered(named, "expanded_length", "dna").withColumnRenamed("number", "rule_id"))
    origins = known.join(named.select(*CONTENT, "rule_id", "swapped"), list(CONTENT)).select("seq_id", "old_rule_id", "rule_id", (F.col("turned") != F.col("swapped")).alias("flipped"))
    return named.select("rule_id", "dna", "expanded_length", "usage_count", "n_origins"), origins


def renamed(rows: DataFrame, origins: DataFrame, *by: str) -> DataFrame:
    """The rows (by, .., sym) with the symbols of rules in the numbers of origins (by, old_rule_id, rule_id, flipped)."""
    child = origins.select(*by, F.col("old_rule_id").alias("child"), F.col("rule_id").alias("to"), F.col("flipped").alias("turned"))
    found = rows.withColumn("child", rule_of("sym")).join(child, [*by, "child"], "left")
    forward = (F.col("sym") >= 4) != F.col("turned")
    sym = F.when(F.col("sym").between(0, 3), F.col("sym")).when(forward, 4 + F.col("to")).otherwise(-5 - F.col("to"))
    return found.withColumn("sym", sym).drop("child", "to", "turned")


def turned_body(symbols) -> Column:
    """A rule's symbols read on the other strand."""
    return F.reverse(F.transform(symbols, lambda s: F.when(s.between(0, 3), 3 - s).otherwise(-1 - s)))


def in_order(*place: str) -> Column:
    """The symbols of a group in the order of some columns."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*place, "sym"))), lambda x: x["sym"])


def merged_sequences(grammars: DataFrame, origins: DataFrame) -> DataFrame:
    """seq_id, pos, sym with the merged grammar's rule numbers; nothing of any sequence is dropped."""
    return renamed(explode_symbols(grammars), origins, "seq_id").select("seq_id", "pos", "sym")


def merged_rules(grammars: DataFrame, origins: DataFrame) -> DataFrame:
    """rule_id, symbols: a body for each merged rule, in merged numbers; of several, the least."""
    return _merged_bodies(grammars, origins, "seq_id").groupBy("rule_id").agg(F.min("symbols").alias("symbols"))


def _merged_bodies(grammars: DataFrame, origins: DataFrame, *by: str) -> DataFrame:
    """by, rule_id, symbols: the body of each origin in merged numbers, on the merged rule's strand."""
    rules = grammars.select(*by, F.inline("rules")).select(*by, F.col("rule_id").alias("old_rule_id"), F.posexplode("symbols").alias("ordinal", "sym"))
    bodies = renamed(rules, origins, *by).groupBy(*by, "old_rule_id").agg(in_order("ordinal").alias("symbols"))
    named = bodies.join(origins, [*by, "old_rule_id"])
    return named.select(*by, "rule_id", F.when(F.col("flipped"), turned_body(F.col("symbols"))).otherwise(F.col("symbols")).alias("symbols"))


def merge_chunk_tables(chunks: DataFrame, either_strand: bool = False) -> tuple[DataFrame, DataFrame]:
    """Of the grammars (seq_id, idx, symbols, rules) of sequences' chunks: the chunks' symbols (seq_id, idx, symbols) and the rules
    (seq_id, rule_id, symbols, usage_count, pair_count) of one grammar for each sequence.

    Rules of a sequence that expand to the same DNA are one (with ``either_strand``, or to its
    reverse complement), known by hashes and numbered by length and these, so that a rule comes after those it uses.
    usage_count and pair_count are summed.  Nothing is expanded or gathered by sequence.
    """
    by = ("seq_id", "idx")
    built = keep(chunks.select(*by, "symbols", "rules"))
    known = keep(rule_contents(built, either_strand, *by))
    same = known.groupBy("seq_id", *CONTENT).agg(F.sum("usage_count").alias("usage_count"), F.sum("pair_count").alias("pair_count"))
    placed = with_starts(same, ["seq_id", *CONTENT], [1, 4])
    named = keep(placed.select("seq_id", *CONTENT, "usage_count", "pair_count", (F.col("start_1") - F.col("start_0")).alias("rule_id")))
    origins = keep(known.join(named.select("seq_id", *CONTENT, "rule_id"), ["seq_id", *CONTENT]).select(*by, "old_rule_id", "rule_id", F.col("turned").alias("flipped")))
    bodies = _merged_bodies(built, origins, *by).groupBy("seq_id", "rule_id").agg(F.min("symbols").alias("symbols"))
    rules = bodies.join(named, ["seq_id", "rule_id"]).select("seq_id", "rule_id", "symbols", "usage_count", "pair_count")
    symbols = renamed(built.select(*by, F.posexplode("symbols").alias("pos", "sym")), origins, *by).groupBy(*by).agg(in_order("pos").alias("symbols"))
    return built.select(*by).join(symbols, list(by), "left").withColumn("symbols", F.coalesce("symbols", F.array().cast("array<long>"))), rules


def merge_chunks(chunks: DataFrame, either_strand: bool = False) -> DataFrame:
    """Grammar rows, one for each sequence, of ``merge_chunk_tables``, for sequences whose grammar fits a row."""
    symbols, rules = merge_chunk_tables(chunks, either_strand)
    rule = F.struct("rule_id", "symbols", "usage_count", "pair_count")
    gathered = rules.groupBy("seq_id").agg(F.array_sort(F.collect_list(rule), lambda a, b: F.signum(a["rule_id"] - b["rule_id"]).cast("int")).alias("rules"))
    part = F.transform(F.array_sort(F.collect_list(F.struct("idx", "symbols"))), lambda p: p["symbols"])
    whole = symbols.groupBy("seq_id").agg(F.flatten(part).alias("symbols")).join(gathered, "seq_id", "left")
    return whole.withColumn("rules", F.coalesce("rules", F.array().cast(gathered.schema["rules"].dataType)))


def used_enough(rules: DataFrame, least: int) -> DataFrame:
    return rules.where(F.col("usage_count") >= least)


def canonical_body(symbols) -> F.Column:
    """The lesser of a rule's symbols and their reverse complement: equal for rules that are each other's reverse."""
    return F.least(symbols, turned_body(symbols))


def deduplicate_rules(rules: DataFrame) -> DataFrame:
    """body, usage_count, n_origins: rules of equal or reverse symbols as one, within a grammar's numbering."""
    return rules.groupBy("seq_id", canonical_body(F.col("symbols")).alias("body")).agg(F.sum("usage_count").alias("usage_count"), F.count("*").alias("n_origins"))
