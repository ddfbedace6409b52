"""Locally consistent grammars of sequences too long for a task: each level is parsed in pieces.

Where a phrase may begin depends on half a window of symbols only, so pieces find these
places alone, with some symbols of their neighbours.  Which of them begin a phrase depends
further on how far back the phrase before began, at most ``longest`` symbols.  So each piece works out, for
every such distance that it could be entered with, the one it is left with; these short tables are gone through in the
order of pieces, and then each piece knows its phrases.  A phrase belongs to the piece it begins in.

A level's phrases are counted and named for each sequence by Spark, in order of first place, as ``lcg.lcg`` names
them, and pieces are cut anew from the named text.  Results don't depend on the size of pieces.  Null
and empty sequences have no symbols and no rules.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import bounded
from ..functions.dna import _codes
from ..shared import keep
from .kmers import pieces
from .lcg import MOST_LEVELS, pair_print
from .ranges import with_starts
from .repair import in_numpy, lists_of

SIZE = 65_536


def possible_begins(x: np.ndarray, window: int, ended: bool) -> np.ndarray:
    """Whether each symbol's fingerprint is the least within half a window; of text that goes on, the last symbols are not to be relied on."""
    n = len(x)
    if not n:
        return np.zeros(0, bool)
    pairs, which = np.unique(x[:-1] << 32 | x[1:], return_inverse=True)
    known = np.array([pair_print(k >> 32, k & 0xFFFFFFFF) for k in pairs.tolist()], np.uint64)
    prints = np.append(known[which] if len(which) else np.zeros(0, np.uint64), np.uint64(pair_print(int(x[-1]), None)) if ended else ~np.uint64(0))
    half = window // 2
    padded = np.concatenate([np.full(half, ~np.uint64(0)), prints, np.full(half, ~np.uint64(0))])
    low = padded[:n].copy()
    for k in range(1, 2 * half + 1):
        np.minimum(low, padded[k : k + n], out=low)
    return low == prints


class Begins:
    """The places of a piece of ``size`` symbols where phrases may begin, and what follows from the distance it is entered with."""

    def __init__(self, places: list[int], size: int, shortest: int, longest: int):
        self.places, self.size, self.least, self.longest = places, size, min(shortest, longest), longest

    def walk(self, last: int, k: int = 0, stop: int | None = None):
        """(next place's number, begin) of each phrase after one that began at ``last``, up to ``stop``."""
        stop = self.size if stop is None else stop
        while True:
            while k < len(self.places) and (self.places[k] <= last or self.places[k] - last < self.least):
                k += 1
            at = self.places[k] if k < len(self.places) else stop
            last = last + self.longest if min(at, stop) - last > self.longest else at
            if last >= stop:
                return
            yield k, last

    def left_with(self) -> list[int]:
        """For each distance from 0 to ``longest`` back to the last begin, that distance at the piece's end."""
        known: dict[int, int] = {}
        out = []
        for distance in range(self.longest + 1):
            met, last = [-distance], -distance
            for _, last in self.walk(-distance):
                if last in known:
                    last = known[last]
                    break
                met.append(last)
            out.append(self.size - last)
            known.update(dict.fromkeys(met, last))
        return out


def context(held: DataFrame, window: int, longest: int) -> DataFrame:
    """seq_id, piece, symbols, before, after (symbols beside the piece; null at an end)."""
    left, right = max(window // 2, 1), longest + window // 2 + 1
    tails = held.select("seq_id", (F.col("piece") + 1).alias("piece"), F.slice("symbols", F.greatest(F.size("symbols") - left + 1, F.lit(1)), left).alias("before"))
    heads = held.select("seq_id", (F.col("piece") - 1).alias("piece"), F.slice("symbols", 1, right).alias("after"))
    return held.join(tails, ["seq_id", "piece"], "left").join(heads, ["seq_id", "piece"], "left")


def marked(held: DataFrame, window: int, shortest: int, longest: int) -> DataFrame:
    """seq_id, piece, symbols (with those after the piece), own (its size), ended (nothing is left out at the end), places, leaving."""

    def run(batches):
        for batch in bounded(batches):
            rows = []
            beside = [batch.column(c) for c in ("before", "after")]
            for seq_id, piece, x, *sides in zip(batch.column("seq_id").to_pylist(), batch.column("piece").to_pylist(), in_numpy(batch.column("symbols")), *(in_numpy(c.fill_null([])) for c in beside)):
                before, after = sides
                whole = np.concatenate([before, x, after])
                ended = len(after) < longest + window // 2 + 1
                may = np.flatnonzero(possible_begins(whole, window, ended)[len(before) :])
                places = may[may <= len(x) + longest].tolist()
                first = piece == 0
                goes_on = not ended or len(after) > 0  # a sequence's last piece is left for no other
                table = Begins([p for p in places if p < len(x) and not (first and p == 0)], len(x), shortest, longest).left_with() if goes_on else []
                rows.append((seq_id, piece, np.concatenate([x, after]), len(x), ended, places, table))
            columns = list(zip(*rows)) or [()] * 7
            arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), lists_of(columns[2]), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.bool_()), lists_of(columns[5]), lists_of(columns[6])]
            yield pa.RecordBatch.from_arrays(arrays, ["seq_id", "piece", "symbols", "own", "ended", "places", "leaving"])

    return context(held, window, longest).mapInArrow(run, "seq_id long, piece long, symbols array<long>, own long, ended boolean, places array<long>, leaving array<long>")


def entered(found: DataFrame) -> DataFrame:
    """of, at, distance: how far back the last phrase began when each piece is entered; a sequence's short tables go through one task, in order."""

    def run(batches):
        now, distance = None, 0
        for batch in bounded(batches):
            out = []
            for seq_id, piece, leaving in zip(*(batch.column(c).to_pylist() for c in ("seq_id", "piece", "leaving"))):
                if seq_id != now:
                    now, distance = seq_id, 0
                out.append((seq_id, piece, distance))
                distance = leaving[distance] if leaving else 0
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 3)], ["of", "at", "distance"])

    ordered = found.select("seq_id", "piece", "leaving").repartition("seq_id").sortWithinPartitions("seq_id", "piece")
    return ordered.mapInArrow(run, "of long, at long, distance long")


def phrases_of(held: DataFrame, window: int, shortest: int, longest: int, size: int) -> DataFrame:
    """seq_id, piece, start, body of the phrases of pieces (seq_id, piece, symbols), all of ``size`` symbols but a sequence's last."""
    found = keep(marked(held, window, shortest, longest))
    ready = found.join(entered(found), (F.col("seq_id") == F.col("of")) & (F.col("piece") == F.col("at")))

    def run(batches):
        for batch in bounded(batches):
            ids, numbers, starts, bodies = [], [], [], []
            for seq_id, piece, x, own, ended, places, distance in zip(batch.column("seq_id").to_pylist(), batch.column("piece").to_pylist(), in_numpy(batch.column("symbols")), *(batch.column(c).to_pylist() for c in ("own", "ended", "places", "distance"))):
                first = piece == 0
                end = len(x) if ended else own + longest + 1
                walk = Begins([p for p in places if not (first and p == 0)], own, shortest, longest)
                begins = [0] if first else []
                for _, at in walk.walk(-distance, stop=end):
                    begins.append(at)
                    if at >= own:
                        break
                else:
                    begins.append(end)
                for a, b in zip(begins, begins[1:]):
                    if a < own:
                        ids.append(seq_id)
                        numbers.append(piece)
                        starts.append(piece * size + a)
                        bodies.append(x[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int64()), pa.array(starts, pa.int64()), lists_of(bodies)], ["seq_id", "piece", "start", "body"])

    return ready.mapInArrow(run, "seq_id long, piece long, start long, body array<long>")


def encoded(seqs: DataFrame, size: int) -> DataFrame:
    """seq_id, piece, symbols of (seq_id, dna)."""

    def run(batches):
        for batch in bounded(batches):
            found = [_codes(dna.decode()).astype(np.int64) for dna in batch.column("dna").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("seq_id"), batch.column("piece"), lists_of(found)], ["seq_id", "piece", "symbols"])

    cut = pieces(seqs, 0, size=size).select("seq_id", F.floor(F.col("start") / size).alias("piece"), "dna")
    return cut.mapInArrow(run, "seq_id long, piece long, symbols array<long>")


def recut(parts: DataFrame, size: int) -> DataFrame:
    """Pieces of ``size`` symbols of rows (seq_id, piece, symbols) in order."""
    before = F.coalesce(F.sum(F.size("symbols").cast("long")).over(Window.partitionBy("seq_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    starts = parts.select(F.col("seq_id").alias("of"), F.col("piece").alias("at"), before.alias("start"))
    placed = parts.where(F.size("symbols") > 0).join(starts, (F.col("seq_id") == F.col("of")) & (F.col("piece") == F.col("at")))
    n = F.size("symbols")
    each = placed.select("seq_id", "symbols", "start", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + n - 1) / size))).alias("piece"))
    begin = F.greatest(F.col("piece") * size - F.col("start"), F.lit(0))
    end = F.least((F.col("piece") + 1) * size - F.col("start"), F.size("symbols"))
    part = F.struct((F.col("start") + begin).alias("from"), F.slice("symbols", (begin + 1).cast("int"), (end - begin).cast("int")).alias("symbols"))
    return each.groupBy("seq_id", "piece").agg(F.flatten(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["symbols"])).alias("symbols"))


def phrases(seqs: DataFrame, window: int = 8, shortest: int = 2, longest: int = 256, size: int = SIZE) -> DataFrame:
    """seq_id, start, len, content: the first level's phrases."""
    check(window, shortest, longest, size)
    found = phrases_of(keep(encoded(seqs, size)), window, shortest, longest, size)
    content = F.translate(F.array_join(F.col("body").cast("array<string>"), ""), "0123", "ACGT")
    return found.select("seq_id", "start", F.size("body").cast("long").alias("len"), content.alias("content"))


def phrase_rules(seqs: DataFrame, window: int = 8, shortest: int = 2, longest: int = 256, least: int = 2) -> DataFrame:
    """content, n: phrases of the first level that are frequent over all sequences."""
    found = phrases(seqs, window, shortest, longest).where(F.col("len") >= shortest)
    return found.groupBy("content").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def check(window: int, shortest: int, longest: int, size: int) -> None:
    if shortest < 2 or longest < shortest or size < longest + window:
        raise ValueError("phrases have two symbols at least, and pieces more than a phrase and a window")


def build_spread(seqs: DataFrame, window: int = 8, shortest: int = 2, longest: int = 256, least: int = 2, size: int = SIZE, levels: int = MOST_LEVELS) -> tuple[DataFrame, DataFrame]:
    """Pieces (seq_id, piece, symbols) of the last level, and the rules (seq_id, rule_id, symbols, used) of all levels, ``levels`` at most."""
    check(window, shortest, longest, size)
    held, done, rules = keep(encoded(seqs, size)), [], None
    for _ in range(levels):
        found = keep(phrases_of(held, window, shortest, longest, size))
        counted = found.where(F.size("body") >= shortest).groupBy("seq_id", "body").agg(F.count("*").alias("n"), F.min("start").alias("first")).where(F.col("n") >= least)
        named = keep(counted if rules is None else counted.join(rules.select("seq_id", F.col("symbols").alias("body"), "rule_id"), ["seq_id", "body"], "left"))
        if named.isEmpty():
            break
        fresh = named if rules is None else named.where(F.col("rule_id").isNull())
        made = fresh.select("seq_id", "first", "body", "n")
        placed = with_starts(made, ["seq_id", "first"], [1, 2]).select("seq_id", "body", "n", (F.col("start_1") - F.col("start_0")).alias("place"))
        if rules is None:
            rules = keep(placed.select("seq_id", F.col("place").alias("rule_id"), F.col("body").alias("symbols"), F.col("n").alias("used")))
        else:
            next_one = rules.groupBy("seq_id").agg((F.max("rule_id") + 1).alias("next"))
            more = placed.join(next_one, "seq_id", "left").select("seq_id", (F.coalesce("next", F.lit(0)) + F.col("place")).alias("rule_id"), F.col("body").alias("symbols"), F.col("n").alias("used"))
            again = named.where(F.col("rule_id").isNotNull()).select("seq_id", "rule_id", F.col("n").alias("again"))
            old = rules.join(again, ["seq_id", "rule_id"], "left").select("seq_id", "rule_id", "symbols", (F.col("used") + F.coalesce("again", F.lit(0))).alias("used"))
            rules = keep(old.unionByName(more))
        active = named.select("seq_id").distinct()
        done.append(held.join(active, "seq_id", "left_anti"))
        names = named.select("seq_id", "body").join(rules.select("seq_id", F.col("symbols").alias("body"), "rule_id"), ["seq_id", "body"])
        out = F.when(F.col("rule_id").isNotNull(), F.array(4 + F.col("rule_id"))).otherwise(F.col("body"))
        replaced = found.join(active, "seq_id", "left_semi").join(names, ["seq_id", "body"], "left").select("seq_id", "piece", F.struct("start", out.alias("out")).alias("x"))
        parts = replaced.groupBy("seq_id", "piece").agg(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["out"])).alias("symbols"))
        held = keep(recut(keep(parts), size))
    for table in done:
        held = held.unionByName(table)
    return held, rules if rules is not None else seqs.sparkSession.createDataFrame([], "seq_id long, rule_id long, symbols array<long>, used long")


def grammar_rows(held: DataFrame, rules: DataFrame) -> DataFrame:
    """Grammar rows, one for each sequence, of pieces and rules; for sequences whose grammar fits a row."""
    part = F.transform(F.array_sort(F.collect_list(F.struct("piece", "symbols"))), lambda p: p["symbols"])
    symbols = held.groupBy("seq_id").agg(F.flatten(part).alias("symbols"))
    rule = F.struct("rule_id", "symbols", F.col("used").alias("usage_count"), F.col("used").alias("pair_count"))
    made = rules.groupBy("seq_id").agg(F.array_sort(F.collect_list(rule), lambda x, y: F.signum(x["rule_id"] - y["rule_id"]).cast("int")).alias("rules"))
    kind = "array<struct<rule_id:long,symbols:array<long>,usage_count:long,pair_count:long>>"
    return symbols.join(made, "seq_id", "left").withColumn("rules", F.coalesce("rules", F.array().cast(kind)))
