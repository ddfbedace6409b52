"""Parts of what a grammar stands for: ranges, and symbols down to a depth.

Sums of expansion lengths along the final symbols tell where a range begins, and rules' lengths
which of their symbols it meets; nothing else is opened.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import bounded
from .grammar import grammars_in, order_rules
from .repair import back, lists_of

SPREAD = 64  # groups that a sequence's ranges are dealt out to


def rule_lengths(bodies: dict[int, list[int]]) -> dict[int, int]:
    """What each rule expands to, in bases, children first."""
    out: dict[int, int] = {}
    for r in order_rules(bodies):
        out[r] = sum(1 if 0 <= s <= 3 else out[s - 4 if s >= 4 else -5 - s] for s in bodies[r])
    return out


class Reader:
    """Reads ranges of one grammar; ``opened`` counts the rules it has opened."""

    def __init__(self, symbols: list[int], bodies: dict[int, list[int]]):
        self.symbols, self.bodies, self.lengths = symbols, bodies, rule_lengths(bodies)
        self.ends = np.cumsum([self.size(s) for s in symbols], dtype=np.int64)
        self.opened = 0

    def size(self, s: int) -> int:
        return 1 if 0 <= s <= 3 else self.lengths[s - 4 if s >= 4 else -5 - s]

    def range(self, begin: int, end: int) -> tuple[str, str]:
        """The bases from ``begin`` up to ``end``, and for each whether it comes from a rule read on the other strand (-) or not (+)."""
        begin, end = max(begin, 0), min(end, int(self.ends[-1]) if len(self.ends) else 0)
        if begin >= end:
            return "", ""
        first, last = np.searchsorted(self.ends, [begin, end - 1], side="right")
        stack, at = [(s, "+") for s in reversed(self.symbols[first : last + 1])], int(self.ends[first]) - self.size(self.symbols[first])
        bases, strands = [], []
        while stack and at < end:
            s, strand = stack.pop()
            if at + self.size(s) <= begin:
                at += self.size(s)
            elif 0 <= s <= 3:
                bases.append("ACGT"[s])
                strands.append(strand)
                at += 1
            else:
                self.opened += 1
                body = self.bodies[s - 4 if s >= 4 else -5 - s]
                if s >= 4:
                    stack.extend((x, strand) for x in reversed(body))
                else:
                    stack.extend((back(x), "-" if strand == "+" else "+") for x in body)
        return "".join(bases), "".join(strands)


def expand_ranges(grammars: DataFrame, ranges: DataFrame) -> DataFrame:
    """seq_id, start, stop, dna, strands of ranges (seq_id, start, stop) of what grammars stand for; what lies outside is empty.

    A sequence's ranges are dealt out to ``SPREAD`` groups, each of which reads its grammar once.  Repeated ranges are
    rows of their own; those of sequences without a grammar give none.
    """
    group = F.pmod(F.xxhash64("start", "stop"), F.lit(SPREAD))
    asked = ranges.groupBy(F.col("seq_id").alias("of"), group.alias("group")).agg(F.collect_list(F.struct("start", "stop")).alias("asked"))

    def run(batches):
        for batch in bounded(batches):
            rows = []
            for seq_id, asked, (symbols, bodies) in zip(batch.column("seq_id").to_pylist(), batch.column("asked").to_pylist(), grammars_in(batch)):
                reader = Reader(symbols, bodies)
                rows += [(seq_id, a["start"], a["stop"], *reader.range(a["start"], a["stop"])) for a in asked]
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, kinds)], ["seq_id", "start", "stop", "dna", "strands"])

    joined = grammars.select("seq_id", "symbols", "rules").join(asked, F.col("seq_id") == F.col("of"))
    return joined.select("seq_id", "symbols", "rules", "asked").mapInArrow(run, "seq_id long, start long, stop long, dna string, strands string")


def opened_symbols(symbols: list[int], bodies: dict[int, list[int]], deepest: int) -> list[int]:
    """The symbols with rules opened ``deepest`` times at most."""
    out, stack = [], [(s, 0) for s in reversed(symbols)]
    while stack:
        s, depth = stack.pop()
        if 0 <= s <= 3 or depth == deepest:
            out.append(s)
        else:
            body = bodies[s - 4 if s >= 4 else -5 - s]
            stack.extend((x, depth + 1) for x in (reversed(body) if s >= 4 else map(back, body)))
    return out


def expand_to_depth(grammars: DataFrame, deepest: int) -> DataFrame:
    """seq_id, symbols: the final symbols of each grammar with rules opened ``deepest`` levels down, reversed ones on their strand."""
    if deepest < 0:
        raise ValueError("a depth is 0 at least")

    def run(batches):
        for batch in bounded(batches):
            found = [opened_symbols(symbols, bodies, deepest) for symbols, bodies in grammars_in(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("seq_id"), lists_of(found)], ["seq_id", "symbols"])

    return grammars.select("seq_id", "symbols", "rules").mapInArrow(run, "seq_id long, symbols array<long>")
