"""Pair replacement of sequences too long for a task: rounds of Spark jobs over pieces of sequences.

In each round a set of frequent pairs of each sequence is chosen and replaced in all its
pieces at once.  No chosen pair's end begins another, so occurrences of two never overlap, and a piece
needs to know only the symbols beside it and, of a run of one symbol that comes into it, whether
its length so far is odd.  Pairs are gone through in order of count (greatest first), then symbols, and each is
taken that overlaps with none taken before; those of less than a ``share``-th of the sequence's
greatest count wait for later rounds.  So there are about as many rounds as
steps of that factor down from the greatest count, times a few.

A round's table has the pieces and what the next choice needs of them: each task counts the pairs inside its pieces
as it writes them, so no round reads symbols twice, and sequences that are
done are set aside.  Of a sequence the first ``MOST_LOOKED_AT`` pairs are gone through in a round and at most ``MOST_A_ROUND`` chosen,
which bounds what one task sorts and what goes to each piece; the others come up again in the next.

Frequencies count overlapping pairs; replacement goes left to right without overlap.  Rules are
numbered by round, then by that order.  Null and empty sequences have no symbols and no rules.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import bounded
from ..functions.dna import _codes
from ..shared import drop, keep_at, new_path
from .kmers import pieces

SYMBOLS_A_PIECE, MOST_LOOKED_AT, MOST_A_ROUND = 65_536, 200_000, 20_000
PIECE, COUNT, DONE, USE = 0, 1, 2, 3
STATE = "kind int, seq_id long, made long, piece long, symbols array<long>, first long, last long, tail long, size long, a long, b long, n long"
NAMES = [field.split()[0] for field in STATE.split(", ")]


def lists_in(column) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a list column, and where each list begins, with the end."""
    return column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - (column.offsets[0].as_py() if len(column.offsets) else 0)


def counted(*keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct rows of some columns of numbers from 0, in order, and how many there are of each."""
    wide = [int(k.max()) + 1 for k in keys]
    code, room = keys[0].astype(np.int64), wide[0]
    for k, w in zip(keys[1:], wide[1:]):
        room *= w
        if room < 1 << 62:
            code = code * w + k
    if room >= 1 << 62:  # too many for one number
        order = np.lexsort(keys[::-1])
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
        begins = np.flatnonzero(new)
        return (*(k[order][begins] for k in keys), np.diff(begins, append=len(order)))
    code.sort()
    begins = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    rest, out = code[begins], []
    for w in reversed(wide[1:]):
        rest, place = np.divmod(rest, w)
        out.append(place)
    return (rest, *reversed(out), np.diff(begins, append=len(code)))


def table(kind: int, rows: int, **columns) -> pa.RecordBatch:
    """Rows of one kind; columns that aren't given are null."""
    kinds = [pa.int32(), *[pa.int64()] * 3, pa.list_(pa.int64()), *[pa.int64()] * 7]
    columns["kind"] = np.full(rows, kind, np.int32)
    arrays = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(rows, t) for c, t in zip(NAMES, kinds)]
    return pa.RecordBatch.from_arrays(arrays, NAMES)


def state_of(seq_id: np.ndarray, piece: np.ndarray, made: np.ndarray, flat: np.ndarray, edges: np.ndarray, alone: np.ndarray, least: int):
    """The rows of a round's table for some pieces that aren't empty, given by their numbers one after another."""
    size = np.diff(edges)
    if len(size):
        new = np.ones(len(flat), bool)
        new[1:] = flat[1:] != flat[:-1]
        new[edges[:-1]] = True
        tail = edges[1:] - np.maximum.accumulate(np.where(new, np.arange(len(flat)), 0))[edges[1:] - 1]
        symbols = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat, pa.int64()))
        yield table(PIECE, len(size), seq_id=seq_id, piece=piece, made=made, symbols=symbols, first=flat[edges[:-1]], last=flat[edges[1:] - 1], tail=tail, size=size)
    inner = np.ones(max(len(flat) - 1, 0), bool)
    inner[edges[1:-1] - 1] = False
    inner = np.flatnonzero(inner)
    if len(inner):
        names, first, seq = np.unique(seq_id, return_index=True, return_inverse=True)
        s, a, b, n = counted(np.repeat(seq, size)[inner], flat[inner], flat[inner + 1])
        stay = ~alone[first][s] | (n >= least)  # of a sequence in one piece, these are all
        if stay.any():
            yield table(COUNT, int(stay.sum()), seq_id=names[s[stay]], made=made[first][s[stay]], a=a[stay], b=b[stay], n=n[stay])


def encoded(seqs: DataFrame, size: int) -> DataFrame:
    """The first round's table of (seq_id, dna)."""

    def run(batches):
        for batch in bounded(batches):
            found = [_codes(dna.decode()).astype(np.int64) for dna in batch.column("dna").to_pylist()]
            if found:
                edges = np.concatenate([[0], np.cumsum([len(x) for x in found])])
                piece = batch.column("piece").to_numpy()
                yield from state_of(batch.column("seq_id").to_numpy(), piece, np.zeros(len(piece), np.int64), np.concatenate(found), edges, np.zeros(len(piece), bool), 2)

    cut = pieces(seqs, 0, size=size).select("seq_id", F.floor(F.col("start") / size).alias("piece"), "dna")
    return spread(cut).mapInArrow(run, STATE)


def spread(held: DataFrame) -> DataFrame:
    """Pieces dealt out to as many tasks as the session says, however few bytes they have."""
    return held.repartition(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), "seq_id", "piece")


def beside(held: DataFrame) -> DataFrame:
    """of, at, follow, before, odd for each piece: the symbols beside it, and whether the run that comes into it is of odd length.

    A piece of one symbol goes on with the run before it.  Windows run over pieces, not symbols.
    """
    along = Window.partitionBy("seq_id").orderBy("piece")
    ends = held.select("seq_id", "piece", "first", "last", "tail", "made", F.lag("last").over(along).alias("before"), F.lead("first").over(along).alias("follow"), (F.col("tail") == F.col("size")).alias("whole"))
    goes_on = F.col("whole") & F.col("before").eqNullSafe(F.col("first"))
    grouped = ends.withColumn("run", F.sum(F.when(goes_on, 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    length = F.sum("tail").over(Window.partitionBy("seq_id", "run").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0))
    odd = F.coalesce(F.lag("length").over(along), F.lit(0)) % 2 == 1
    return grouped.withColumn("length", length).select(F.col("seq_id").alias("of"), F.col("piece").alias("at"), "made", "last", "follow", "before", odd.alias("odd"))


def chosen_pairs(counts: DataFrame, share: int | None, most: int) -> DataFrame:
    """seq_id, rule_id, a, b, n: the pairs of (seq_id, made, a, b, n) that a round replaces; without a share, the first of each sequence."""
    order = F.struct((-F.col("n")).alias("less"), "a", "b", "made")
    top = counts.groupBy("seq_id").agg(F.max("n").alias("top"), F.min(order).alias("best"))
    if share is None:
        return top.select("seq_id", F.col("best.made").alias("rule_id"), "best.a", "best.b", F.col("top").alias("n"))
    frequent = counts.join(top, "seq_id").where(F.col("n") * share >= F.col("top")).select("seq_id", "made", "a", "b", "n", order.alias("order"))
    place = F.row_number().over(Window.partitionBy("seq_id").orderBy("order"))
    looked_at = frequent.withColumn("place", place).where(F.col("place") <= MOST_LOOKED_AT)

    def run(batches):
        now, begins, ends, taken = None, set(), set(), 0
        for batch in bounded(batches):
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("seq_id", "made", "a", "b", "n"))):
                seq_id, made, a, b, n = row
                if seq_id != now:
                    now, begins, ends, taken = seq_id, set(), set(), 0
                if a not in ends and b not in begins and taken < most:
                    begins.add(a)
                    ends.add(b)
                    out.append((seq_id, made + taken, a, b, n))
                    taken += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 5)], ["seq_id", "rule_id", "a", "b", "n"])

    return looked_at.select("seq_id", "made", "a", "b", "n", "place").repartition("seq_id").sortWithinPartitions("seq_id", "place").mapInArrow(run, "seq_id long, rule_id long, a long, b long, n long")


def find_rows(keys: tuple, rows: tuple) -> np.ndarray:
    """For each row of some columns, where it stands among distinct rows ``keys``, or -1."""
    at, code, wide = np.zeros(len(rows[0]), np.int64), np.zeros(len(keys[0]), np.int64), 1
    known = np.ones(len(rows[0]), bool)
    for k, x in zip(keys, rows):
        values, inverse = np.unique(k, return_inverse=True)
        place = np.minimum(np.searchsorted(values, x), len(values) - 1)
        known &= values[place] == x
        code, at, wide = code * len(values) + inverse, at * len(values) + place, wide * len(values)
    order = np.argsort(code)
    place = np.minimum(np.searchsorted(code[order], at), len(code) - 1)
    return np.where(known & (code[order][place] == at), order[place], -1)


def replaced(seq: np.ndarray, flat: np.ndarray, edges: np.ndarray, follow: np.ndarray, before: np.ndarray, odd: np.ndarray, pairs: tuple):
    """Pieces after a round, as (numbers, where pieces begin, rows of pairs used).

    ``seq`` numbers the sequences of pieces, ``pairs`` are (seq, a, b, rule); -1 in ``follow`` and ``before`` is none.
    """
    size = np.diff(edges)
    wide = np.concatenate([[0], np.cumsum(size + 1)])
    x = np.empty(wide[-1], np.int64)
    inside = np.ones(len(x), bool)
    inside[wide[1:] - 1] = False
    x[inside], x[~inside] = flat, follow
    owner = np.repeat(np.arange(len(size)), size + 1)
    at = np.flatnonzero(inside)
    hit = np.full(len(x), -1)
    hit[at] = find_rows(pairs[:3], (seq[owner[at]], x[at], x[at + 1]))
    head = find_rows(pairs[:3], (seq, before, x[wide[:-1]]))
    taken = (head >= 0) & ((before != x[wide[:-1]]) | odd)
    hit[wide[:-1][taken]] = -1
    found = np.flatnonzero(hit >= 0)
    new = np.ones(len(found), bool)  # where a run of hits begins, which is of one symbol
    new[1:] = found[1:] != found[:-1] + 1
    place = np.arange(len(found))
    found = found[(place - np.maximum.accumulate(np.where(new, place, 0))) % 2 == 0] if len(found) else found
    x[found] = pairs[3][hit[found]]
    stay = inside
    stay[found + 1] = False
    stay[wide[:-1][taken]] = False
    return x[stay], np.concatenate([[0], np.cumsum(np.bincount(owner[stay], minlength=len(size)))]), hit[found]


def next_state(held: DataFrame, around: DataFrame, chosen: DataFrame, least: int) -> DataFrame:
    """The next round's table: pieces with the chosen pairs replaced, and those of sequences without any as done."""
    rule = chosen.groupBy("seq_id").agg(F.collect_list(F.struct("a", "b", "rule_id")).alias("pairs"))
    place = around.select("of", "at", "follow", "before", "odd")
    ready = spread(held.select("seq_id", "piece", "made", "symbols")).join(place, (F.col("seq_id") == F.col("of")) & (F.col("piece") == F.col("at"))).join(rule, "seq_id", "left")

    def run(batches):
        for batch in bounded(batches):
            open_ = batch.filter(batch.column("pairs").is_valid())
            done = batch.filter(batch.column("pairs").is_null())
            if done.num_rows:
                yield table(DONE, done.num_rows, **{c: done.column(c) for c in ("seq_id", "piece", "made", "symbols")})
            if not open_.num_rows:
                continue
            ids, piece, made = (open_.column(c).to_numpy() for c in ("seq_id", "piece", "made"))
            none = lambda c: open_.column(c).fill_null(-1).to_numpy()
            follow, before, odd = none("follow"), none("before"), open_.column("odd").to_numpy(zero_copy_only=False)
            flat, edges = lists_in(open_.column("symbols"))
            names, seq = np.unique(ids, return_inverse=True)
            given, first = open_.column("pairs"), np.unique(seq, return_index=True)[1]
            given = given.take(pa.array(first))
            fields, bounds = given.flatten(), np.concatenate([[0], np.cumsum(given.value_lengths().to_numpy())])
            a, b, number = (fields.field(c).to_numpy() for c in ("a", "b", "rule_id"))
            of = np.repeat(np.arange(len(names)), np.diff(bounds))
            after, ends, used = replaced(seq, flat, edges, follow, before, odd, (of, a, b, 4 + number))
            made = made + np.diff(bounds)[seq]
            some = np.diff(ends) > 0
            yield from state_of(ids[some], piece[some], made[some], after, np.concatenate([ends[:1], ends[1:][some]]), ((follow < 0) & (before < 0))[some], least)
            if len(used):
                rules, n = np.unique(used, return_counts=True)
                yield table(USE, len(rules), seq_id=names[of[rules]], a=number[rules], n=n)

    return ready.mapInArrow(run, STATE)


def build_spread(seqs: DataFrame, least: int = 2, share: int | None = 4, rounds: int | None = None, size: int = SYMBOLS_A_PIECE) -> tuple[DataFrame, DataFrame]:
    """Pieces (seq_id, piece, symbols) when no pair is left ``least`` times or after so many rounds, and the rules (seq_id, rule_id, a, b, n, used).

    With ``share`` None a round makes one rule in each sequence, that of its most frequent pair.
    """
    if least < 2:
        raise ValueError("a rule must be used twice at least")
    spark = seqs.sparkSession
    base, chosen_base = new_path(spark), new_path(spark)
    state, place = keep_at(encoded(seqs, size), f"{base}/round=0", "kind")
    for r in itertools.count():
        held = state.where(F.col("kind") == PIECE)
        if r == rounds:
            break
        around, around_at = keep_at(beside(held))
        borders = around.where(F.col("follow").isNotNull()).select("of", "made", "last", "follow", F.lit(1).cast("long").alias("n")).toDF("seq_id", "made", "a", "b", "n")
        inside = state.where(F.col("kind") == COUNT).select("seq_id", "made", "a", "b", "n")
        counts = inside.unionByName(borders).groupBy("seq_id", "a", "b").agg(F.max("made").alias("made"), F.sum("n").alias("n")).where(F.col("n") >= least)
        counts, counts_at = (counts, None) if share is None else keep_at(counts)
        chosen, _ = keep_at(chosen_pairs(counts, share, MOST_A_ROUND), f"{chosen_base}/round={r}")
        if chosen.isEmpty():
            break
        before, (state, place) = place, keep_at(next_state(held, around, chosen, least), f"{base}/round={r + 1}", "kind")
        drop(spark, before + f"/kind={PIECE}", before + f"/kind={COUNT}", around_at, *[counts_at] * (counts_at is not None))
    if r == 0:
        return held.select("seq_id", "piece", "symbols"), spark.createDataFrame([], "seq_id long, rule_id long, a long, b long, n long, used long")
    left = spark.read.schema(STATE + ", round int").parquet(base)
    whole = left.where(F.col("kind").isin(PIECE, DONE)).select("seq_id", "piece", "symbols")
    used = left.where(F.col("kind") == USE).groupBy("seq_id", F.col("a").alias("rule_id")).agg(F.sum("n").alias("used"))
    made = spark.read.schema("seq_id long, rule_id long, a long, b long, n long, round int").parquet(chosen_base)
    return whole, made.join(used, ["seq_id", "rule_id"], "left").select("seq_id", "rule_id", "a", "b", "n", F.coalesce("used", F.lit(0)).alias("used"))


def placed_symbols(held: DataFrame) -> DataFrame:
    """seq_id, pos, sym of pieces (seq_id, piece, symbols)."""
    before = F.coalesce(F.sum(F.size("symbols")).over(Window.partitionBy("seq_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = held.select(F.col("seq_id").alias("of"), F.col("piece").alias("at"), before.alias("start"))
    placed = held.join(starts, (F.col("seq_id") == F.col("of")) & (F.col("piece") == F.col("at")))
    return placed.select("seq_id", "start", F.posexplode("symbols").alias("i", "sym")).select("seq_id", (F.col("start") + F.col("i")).cast("long").alias("pos"), "sym")


def grammar_rows(held: DataFrame, rules: DataFrame) -> DataFrame:
    """Grammar rows, one for each sequence, of pieces and rules; for sequences whose grammar fits a row."""
    part = F.transform(F.array_sort(F.collect_list(F.struct("piece", "symbols"))), lambda p: p["symbols"])
    symbols = held.groupBy("seq_id").agg(F.flatten(part).alias("symbols"))
    rule = F.struct("rule_id", F.array("a", "b").alias("symbols"), F.col("used").alias("usage_count"), F.col("n").alias("pair_count"))
    made = rules.groupBy("seq_id").agg(F.array_sort(F.collect_list(rule), lambda x, y: F.signum(x["rule_id"] - y["rule_id"]).cast("int")).alias("rules"))
    kind = "array<struct<rule_id:long,symbols:array<long>,usage_count:long,pair_count:long>>"
    return symbols.join(made, "seq_id", "left").withColumn("rules", F.coalesce("rules", F.array().cast(kind)))
