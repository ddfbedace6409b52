"""Suffix order, common prefixes and repeats of sequences too long for a task.

Suffixes are ranked first by their next ``FIRST`` bases, as a number that sorts as they do, then by
doubling: among suffixes of equal rank the one comes first whose continuation, ``h`` bases
on, has the lower rank.  Only suffixes whose rank is shared go on, and their table of each round is kept, so
two suffixes have ``h`` bases in common if both are in the table of ``h`` with one rank; common prefixes of neighbours
are put together from these from the longest down.

Groups of equal rows are numbered over tables sorted by range: a group may run over
any number of ranges, each of which passes on one row (how many rows it has, where its last group begins).
Repeats are intervals of neighbours; a stack of open ones is kept while a range is read, and
one pass over the ranges, in their order, joins their stacks.

That is for sequences too long for a task.  The suffixes of shorter ones (a piece at most) are sorted and swept inside tasks, many
sequences at a time, without an exchange.

Null and empty sequences have no suffixes.  A suffix that ends sorts before one that goes on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import bounded
from ..functions.dna import _codes
from ..shared import keep
from .kmers import PIECE, pieces
from .ranges import with_starts

FIRST = 27  # 5**27 is below 2**63


def first_bases(seqs: DataFrame, size: int = PIECE) -> DataFrame:
    """seq_id, pos, key: the next bases of every place as digits 1 to 4 of a number to base 5, 0 beyond the end."""

    def run(batches):
        for batch in batches:
            for seq_id, start, owned, dna in zip(*(batch.column(c).to_pylist() for c in ("seq_id", "start", "owned", "dna"))):
                x = np.zeros(owned + FIRST, np.int64)
                codes = _codes(dna.decode())[: len(x)]
                x[: len(codes)] = codes + 1
                key = np.zeros(owned, np.int64)
                for j in range(FIRST):
                    key = key * 5 + x[j : j + owned]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(owned, seq_id)), pa.array(np.arange(start, start + owned)), pa.array(key)], ["seq_id", "pos", "key"])

    return pieces(seqs, FIRST - 1, size=size).mapInArrow(run, "seq_id long, pos long, key long")


def ranked_suffixes(seqs: DataFrame, size: int = PIECE) -> tuple[DataFrame, list[tuple[int, DataFrame]]]:
    """seq_id, pos, rank, key of every suffix, and for each length h the table of those that shared their first h bases with another."""
    ranked = with_starts(first_bases(seqs, size), ["seq_id", "key", "pos"], [1, 2])
    now = keep(ranked.select("seq_id", "pos", (F.col("start_1") - F.col("start_0")).alias("rank"), "key", "alone"))
    done, shared, h = [], [], FIRST
    while True:
        done.append(now.where("alone").drop("alone"))
        left = now.where(~F.col("alone")).drop("alone")
        if left.isEmpty():
            break
        shared.append((h, left.select("seq_id", "pos", "rank")))
        known = left
        for table in done:
            known = known.unionByName(table)
        after = known.select(F.col("seq_id").alias("of"), (F.col("pos") - h).alias("at"), F.col("rank").alias("next"))
        pairs = left.join(after, (F.col("seq_id") == F.col("of")) & (F.col("pos") == F.col("at")), "left").select("seq_id", "rank", F.coalesce("next", F.lit(-1)).alias("next"), "pos", "key")
        finer = with_starts(pairs, ["seq_id", "rank", "next", "pos"], [2, 3])
        now = keep(finer.select("seq_id", "pos", (F.col("rank") + F.col("start_1") - F.col("start_0")).alias("rank"), "key", "alone"))
        h *= 2
    whole = done[0]
    for table in done[1:]:
        whole = whole.unionByName(table)
    return whole, shared


def sorted_suffixes(texts: list[np.ndarray], prefixes: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Of sequences of codes: the suffixes of one after the other in order, as (sequence, place), and, if asked for, the common prefix with the one before (0 for a sequence's first)."""
    size = np.array([len(x) for x in texts], np.int64)
    sid = np.repeat(np.arange(len(texts)), size)
    n = len(sid)
    if not n:
        return sid, sid, sid
    begin = np.repeat(np.cumsum(size) - size, size)
    after = begin + size[sid]
    rank, width, h = np.concatenate(texts).astype(np.int64) + 1, 3, 1
    at = np.arange(n)
    while True:  # ranks of h bases; codes themselves at first
        following = np.where(at + h < after, rank[np.minimum(at + h, n - 1)], 0)
        if 2 * width + int(sid[-1]).bit_length() <= 62:
            rank = rank << width | following
            width, h = 2 * width, 2 * h
            continue
        break
    order = np.argsort(rank | sid << width)  # the first h bases of a suffix fit one number
    place = (rank | sid << width)[order]
    new = np.concatenate([[True], place[1:] != place[:-1]])
    while True:
        first = np.maximum.accumulate(np.where(new, at, 0))
        ranked = np.empty(n, np.int64)
        ranked[order] = first + 1
        open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(open_):
            break
        who = order[open_]
        following = np.where(who + h < after[who], ranked[np.minimum(who + h, n - 1)], 0)
        finer = np.lexsort((following, first[open_]))
        order[open_] = who[finer]
        following, group = following[finer], first[open_]
        new[open_] = np.concatenate([[True], (group[1:] != group[:-1]) | (following[1:] != following[:-1])])
        h *= 2
    return sid[order], order - begin[order], common_prefixes(np.concatenate(texts), order, sid, after) if prefixes else None


def common_prefixes(codes: np.ndarray, order: np.ndarray, sid: np.ndarray, after: np.ndarray) -> np.ndarray:
    """How far each suffix in order and the one before are equal, all together, by steps of halving length over names of stretches."""
    n = len(codes)
    a, b = order[1:], order[:-1]
    near = sid[a] == sid[b]
    a, b = a[near], b[near]
    most = np.minimum(after[a] - a, after[b] - b)
    found, level = np.zeros(len(a), np.int64), 0
    names, tables = codes.astype(np.int64), []
    while True:  # names of stretches of 2**level bases, equal if they are
        tables.append(names)
        step = 1 << level
        if step * 2 > int(most.max(initial=0)):
            break
        pair = names[: len(names) - step] * (n + 4) + names[step:]
        names = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        level += 1
        here = most >= 1 << level
        if not (names[a[here]] == names[b[here]]).any():
            break
    for level in reversed(range(len(tables))):
        step = 1 << level
        go = np.flatnonzero(found + step <= most)
        equal = tables[level][a[go] + found[go]] == tables[level][b[go] + found[go]]
        found[go[equal]] += step
    out = np.zeros(n, np.int64)
    out[1:][near] = found
    return out


def codes_in(batch) -> list[np.ndarray]:
    return [_codes(dna or "") for dna in batch.column("dna").to_pylist()]


def short_and_long(seqs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Sequences whose suffixes one task sorts, and those of more than ``size`` bases, whose suffixes are ranked over ranges."""
    few = F.coalesce(F.length("dna"), F.lit(0)) <= size
    return seqs.select("seq_id", "dna").where(few), seqs.where(~few)


def suffix_arrays(seqs: DataFrame, size: int = PIECE) -> DataFrame:
    """seq_id, rank, pos: each sequence's suffixes in order. Sequences of up to ``size`` bases are sorted in tasks without an exchange."""

    def run(batches):
        for batch in bounded(batches):
            texts = codes_in(batch)
            owner, place, _ = sorted_suffixes(texts, False)
            n = np.array([len(x) for x in texts], np.int64)
            rank = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([batch.column("seq_id").take(pa.array(owner)), pa.array(rank, LONG), pa.array(place, LONG)], ["seq_id", "rank", "pos"])

    short, long = short_and_long(seqs, size)
    found = short.mapInArrow(run, "seq_id long, rank long, pos long")
    return found.unionByName(ranked_suffixes(long, size)[0].select("seq_id", "rank", "pos")) if not long.isEmpty() else found


def neighbours(seqs: DataFrame, size: int = PIECE) -> DataFrame:
    """seq_id, rank, pos, lcp: each sequence's suffixes in order, and how many bases each has in common with the one before (0 for the first)."""
    ranked, shared = ranked_suffixes(seqs, size)
    ranked = keep(ranked)
    before = ranked.select(F.col("seq_id").alias("of"), (F.col("rank") + 1).alias("at"), F.col("pos").alias("b"), F.col("key").alias("before"))
    both = keep(ranked.select("seq_id", "rank", F.col("pos").alias("a"), "key").join(before, (F.col("seq_id") == F.col("of")) & (F.col("rank") == F.col("at")), "left").drop("of", "at"))
    equal = F.col("key").eqNullSafe(F.col("before"))
    near = both.where(~equal).select("seq_id", "rank", F.col("a").alias("pos"), F.when(F.col("b").isNull(), 0).otherwise(digits("key", "before")).alias("lcp"))
    if not shared:
        return near
    far = both.where(equal).select("seq_id", "rank", F.col("a").alias("pos"), "a", "b", F.lit(0).cast("long").alias("lcp"))
    for h, table in reversed(shared):
        of = lambda place, name: table.select(F.col("seq_id"), F.col("pos").alias(place), F.col("rank").alias(name))
        found = far.join(of("a", "rank_a"), ["seq_id", "a"], "left").join(of("b", "rank_b"), ["seq_id", "b"], "left")
        step = F.when(F.col("rank_a") == F.col("rank_b"), h).otherwise(0)
        far = keep(found.select("seq_id", "rank", "pos", (F.col("a") + step).alias("a"), (F.col("b") + step).alias("b"), (F.col("lcp") + step).alias("lcp")))
    key = lambda place, name: ranked.select("seq_id", F.col("pos").alias(place), F.col("key").alias(name))
    rest = far.join(key("a", "key_a"), ["seq_id", "a"], "left").join(key("b", "key_b"), ["seq_id", "b"], "left")
    more = F.when(F.col("key_a").isNull() | F.col("key_b").isNull(), 0).otherwise(digits("key_a", "key_b"))
    return near.unionByName(rest.select("seq_id", "rank", "pos", (F.col("lcp") + more).alias("lcp")))


def digits(a: str, b: str) -> Column:
    """How many leading digits of two different keys are equal."""
    same = F.lit(0).cast("long")
    for j in range(FIRST):
        same = same + F.when(F.expr(f"`{a}` div {5**j}L = `{b}` div {5**j}L"), 1).otherwise(0)
    return same


LONG = pa.int64()
TRIPLES = pa.list_(pa.list_(LONG))
EDGE = pa.struct([("part", LONG), ("seq_id", LONG), ("events", TRIPLES), ("gained", pa.list_(LONG)), ("stack", TRIPLES), ("leaf", LONG)])
EDGE_SQL = "struct<part: long, seq_id: long, events: array<array<long>>, gained: array<long>, stack: array<array<long>>, leaf: long>"


class Stack:
    """Open intervals, each [common length, suffixes, least place], and what is to be added to the top."""

    def __init__(self):
        self.open: list[list[int]] = []
        self.out: list[tuple[int, int, int]] = []

    def step(self, h: int, n: int, place: int, bottom: int = 0) -> tuple[int, int]:
        """Goes on to a common length h, with n suffixes more; returns what the interval of ``bottom`` gains if h isn't above it."""
        while self.open and self.open[-1][0] > h:
            top = self.open.pop()
            n, place = n + top[1], min(place, top[2])
            self.out.append((top[0], n, place))
        if h <= bottom:
            return n, place
        if self.open and self.open[-1][0] == h:
            top = self.open[-1]
            top[1], top[2] = top[1] + n, min(top[2], place)
        else:
            self.open.append([h, n, place])
        return 0, place


def swept(shortest: int, least: int):
    """Intervals that begin and end in a range, and what the range has for its neighbours."""

    def run(batches):
        stack, events, gained, leaf, part, seq_id, floor = Stack(), [], [0, 0], None, None, None, None
        for batch in batches:
            found: list = []
            for part, seq_id_now, place, h in zip(*(batch.column(c).to_pylist() for c in ("part", "seq_id", "pos", "lcp"))):
                h = h if h >= shortest else 0
                if floor is None:
                    events.append([h, 0, 0])
                    floor = h
                else:
                    n, p = stack.step(h, 1, leaf, floor)
                    if n and floor:
                        gained = [gained[0] + n, min(gained[1], p) if gained[0] else p]
                    if h < floor:
                        events.append([h, *gained])
                        gained, floor = [0, 0], h
                if stack.out:
                    found += [(seq_id, *x) for x in stack.out if x[1] >= least]
                    stack.out = []
                leaf, seq_id = place, seq_id_now
            yield pa.RecordBatch.from_arrays([*(pa.array(c, LONG) for c in (zip(*found) if found else [()] * 4)), pa.nulls(len(found), EDGE)], ["seq_id", "length", "n", "pos", "edge"])
        if part is not None:
            edge = {"part": part, "seq_id": seq_id, "events": events, "gained": gained, "stack": stack.open, "leaf": leaf}
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, LONG)] * 4, pa.array([edge], EDGE)], ["seq_id", "length", "n", "pos", "edge"])

    return run


def joined_stacks(least: int):
    def run(batches):
        stack, leaf, seq_id, found = Stack(), None, None, []

        def drained():
            found.extend((seq_id, *x) for x in stack.out if x[1] >= least)
            stack.out = []

        for batch in batches:
            for edge in batch.column("edge").to_pylist():
                (h, _, _), *more = edge["events"]
                if leaf is not None:
                    stack.step(h, 1, leaf)
                for h, n, place in more:  # the interval at the top, of the length before, is closed with what the range gave it
                    stack.step(h, n, place)
                drained()
                if edge["gained"][0] and stack.open:
                    top = stack.open[-1]
                    top[1], top[2] = top[1] + edge["gained"][0], min(top[2], edge["gained"][1])
                stack.open += edge["stack"]
                leaf, seq_id = edge["leaf"], edge["seq_id"]
        if leaf is not None:
            stack.step(0, 1, leaf)
            drained()
        yield pa.RecordBatch.from_arrays([pa.array(c, LONG) for c in (zip(*found) if found else [()] * 4)], ["seq_id", "length", "n", "pos"])

    return run


def repeats_from(seqs: DataFrame, shortest: int, least: int = 2, size: int = PIECE) -> DataFrame:
    """seq_id, length, n, pos: the maximal repeats of each sequence, substrings of ``shortest`` bases or more that
    occur ``least`` times and that no further base on the right keeps together; pos is the first place.
    Those of sequences of up to ``size`` bases are found in tasks without an exchange."""

    def run(batches):
        for batch in bounded(batches):
            owner, place, h = sorted_suffixes(codes_in(batch))
            stack, found, leaf, last = Stack(), [], 0, -1
            h = np.where(h >= shortest, h, 0)
            some = np.flatnonzero((h > 0) | np.append(h[1:] > 0, False))  # neighbours of a long prefix; between them nothing is open
            for k, common, pos in zip(owner[some].tolist(), h[some].tolist(), place[some].tolist()):
                if last >= 0:
                    stack.step(common, 1, leaf)
                    found += [(last, *x) for x in stack.out if x[1] >= least]
                    stack.out = []
                leaf, last = pos, k
            if last >= 0:
                stack.step(0, 1, leaf)
                found += [(last, *x) for x in stack.out if x[1] >= least]
            columns = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("seq_id").take(pa.array(columns[0], LONG)), *(pa.array(c, LONG) for c in columns[1:])], ["seq_id", "length", "n", "pos"])

    short, long = short_and_long(seqs, size)
    found = short.mapInArrow(run, "seq_id long, length long, n long, pos long")
    return found.unionByName(repeats_over_ranges(long, shortest, least, size)) if not long.isEmpty() else found


def repeats_over_ranges(seqs: DataFrame, shortest: int, least: int = 2, size: int = PIECE) -> DataFrame:
    """The same of sequences of any length."""
    ranged = neighbours(seqs, size).repartitionByRange("seq_id", "rank").sortWithinPartitions("seq_id", "rank")
    found = keep(ranged.select(F.spark_partition_id().cast("long").alias("part"), "seq_id", "pos", "lcp").mapInArrow(swept(shortest, least), f"seq_id long, length long, n long, pos long, edge {EDGE_SQL}"))
    edges = found.where(F.col("edge").isNotNull()).select("edge").repartition(1).sortWithinPartitions("edge.part")
    over = edges.mapInArrow(joined_stacks(least), "seq_id long, length long, n long, pos long")
    return found.where(F.col("edge").isNull()).drop("edge").unionByName(over)
