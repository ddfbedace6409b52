"""Locally consistent grammars: content-defined phrases, level by level.

A position's fingerprint is the hash of its symbol and the next.  A phrase begins
where the fingerprint is the least within half a window on both sides, if the
phrase before is long enough, or where it has become too long.  Phrases that occur
often enough become rules and the text is parsed again, ``MOST_LEVELS`` times at most: a text that has
phrases to name on the last level keeps them as symbols of that level.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import bounded
from ..functions.dna import _codes, fx_hash, symbol_words
from .repair import GRAMMAR, _grammar_batch

MOST_LEVELS = 100


@functools.lru_cache(maxsize=1 << 16)
def pair_print(a: int, b: int | None) -> int:
    """Fingerprint of a position; the last one of a text is hashed alone."""
    return fx_hash(symbol_words(a) + (symbol_words(b) if b is not None else ()))


def cuts(symbols: list[int], window: int, shortest: int, longest: int) -> list[int]:
    """Where phrases begin."""
    n = len(symbols)
    if not n:
        return []
    x = np.array(symbols, np.int64)
    pairs, which = np.unique(x[:-1] << 32 | x[1:], return_inverse=True)
    known = np.array([pair_print(k >> 32, k & 0xFFFFFFFF) for k in pairs.tolist()], np.uint64)
    prints = np.append(known[which], np.uint64(pair_print(symbols[-1], None)))
    half = window // 2
    padded = np.concatenate([np.full(half, ~np.uint64(0)), prints, np.full(half, ~np.uint64(0))])
    low = padded[:n].copy()
    for k in range(1, 2 * half + 1):
        np.minimum(low, padded[k : k + n], out=low)
    out, last = [0], 0
    for i in [*np.flatnonzero(low == prints).tolist(), n]:
        while i - last > longest:
            last += longest
            out.append(last)
        if 0 < i < n and i - last >= min(shortest, longest):
            last = i
            out.append(i)
    return out


def parse(symbols: list[int], window: int, shortest: int, longest: int) -> list[list[int]]:
    begins = cuts(symbols, window, shortest, longest)
    return [symbols[a:b] for a, b in zip(begins, [*begins[1:], len(symbols)])]


def lcg(symbols: list[int], window: int = 8, shortest: int = 2, longest: int = 256, least: int = 2):
    """(final symbols, rules as (symbols, usage, usage)).

    Phrases are compared by what they expand to, so equal content is one rule at any level.
    """
    rules: list = []
    by_body: dict = {}
    for _ in range(MOST_LEVELS):
        phrases = parse(symbols, window, shortest, longest)
        seen: dict = {}
        for p in phrases:
            if len(p) >= shortest:
                seen[tuple(p)] = seen.get(tuple(p), 0) + 1
        out, made = [], False
        for p in phrases:
            body = tuple(p)
            if seen.get(body, 0) >= least:
                if body not in by_body:
                    by_body[body] = len(rules)
                    rules.append([list(body), 0])
                rules[by_body[body]][1] += 1
                out.append(4 + by_body[body])
                made = True
            else:
                out += p
        if not made or len(out) >= len(symbols):
            for p in phrases if made else []:  # the round is undone
                if seen.get(tuple(p), 0) >= least:
                    rules[by_body[tuple(p)]][1] -= 1
            break
        symbols = out
    while rules and rules[-1][1] <= 0:
        rules.pop()
    return symbols, [(body, used, used) for body, used in rules]


def build(seqs: DataFrame, window: int = 8, shortest: int = 2, longest: int = 256, least: int = 2) -> DataFrame:
    """Grammar rows of (seq_id, dna), each sequence inside a task."""

    def run(batches):
        for batch in bounded(batches):
            yield _grammar_batch(batch.column("seq_id"), [lcg(_codes(d or "").tolist(), window, shortest, longest, least) for d in batch.column("dna").to_pylist()])

    return seqs.select("seq_id", "dna").mapInArrow(run, GRAMMAR)


def build_tuned(seqs: DataFrame, sample: int = 10_000) -> DataFrame:
    """Grammar rows with each sequence's own parameters from ``stats.auto_tune``."""
    from .stats import auto_tune

    tuned = seqs.select("seq_id", "dna").join(auto_tune(seqs, sample), "seq_id")

    def run(batches):
        for batch in bounded(batches):
            rows = zip(*(batch.column(c).to_pylist() for c in ("dna", "window", "min_phrase", "max_phrase", "min_occurrences")))
            yield _grammar_batch(batch.column("seq_id"), [lcg(_codes(d or "").tolist(), w, a, b, n) for d, w, a, b, n in rows])

    return tuned.mapInArrow(run, GRAMMAR)
