"""Runs: stretches of a text's words that repeat with a period.

A run is a stretch with smallest period q, at least ``least`` words and ``times`` periods
long, that neither neighbouring word extends with that period.

Words outside repeated k-grams of their document can't join a run: a run's words without its last
period come again q words later, so each lies in a k-gram found twice, where k is the
shortest overlap that a run can have.  The words of such k-grams form segments, and only
these are searched, by division: a run belongs to the place inside it that is
divisible by the greatest power of two, and there either its right or its left part holds half
its periods (Main and Lorentz).  How far a period goes on is found by ranks of
blocks of 1, 2, 4 ... words, which are exact.

A text is handled whole in one task, several short ones together; nothing is shuffled.

Results: a null or empty text has no words and no runs; its kept text is empty.  Rows
that repeat are each handled alone.  Runs are in order of start, then period, and may overlap.
An empty table gives an empty result.  Further columns of any name don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, slices, small_batches

RUNS = "array<struct<start:long,length:long,period:long>>"
SPLIT = r"[\x20\x09-\x0D]+"


def least_overlap(least: int, times: int) -> int:
    """The least number of words that a run shares with itself, moved by its period."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


def repeated_grams(x: np.ndarray, owner: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a k-gram that its owner has twice; hashes may add words, never take one away."""
    n = len(x) - k + 1
    out = np.zeros(len(x), bool)
    if n < 2:
        return out
    h = owner[:n].astype(np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[j : j + n].astype(np.uint64)
        h ^= h >> np.uint64(29)
    inside = np.flatnonzero(owner[:n] == owner[k - 1 :])
    key = h[inside]
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return out
    at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    for j in range(k):
        out[inside[twice[at] == key] + j] = True
    return out


def segments_of(mask: np.ndarray, owner: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches of masked words of one owner, ``least`` words or longer."""
    cut = np.ones(len(mask), bool)
    cut[1:] = (owner[1:] != owner[:-1]) | ~mask[:-1]
    begin = np.flatnonzero(mask & cut)
    last = np.ones(len(mask), bool)
    last[:-1] = (owner[1:] != owner[:-1]) | ~mask[1:]
    end = np.flatnonzero(mask & last) + 1
    long = end - begin >= least
    return begin[long], end[long]


class Blocks:
    """Ranks of the blocks of 1, 2, 4 ... numbers of an array: equal blocks have equal ranks."""

    def __init__(self, x: np.ndarray, longest: int):
        self.n, self.ranks = len(x), [np.unique(x, return_inverse=True)[1].astype(np.int32)]
        while 2 << len(self.ranks) - 1 <= longest:
            before, step = self.ranks[-1], 1 << len(self.ranks) - 1
            pairs = before[:-step].astype(np.int64) << 32 | before[step:]
            self.ranks.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))

    def onward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers are equal from places a and b on; a is before b."""
        out = np.zeros(len(a), np.int64)
        for j in range(len(self.ranks) - 1, -1, -1):
            fits = b + out + (1 << j) <= self.n
            same = self.ranks[j][np.where(fits, a + out, 0)] == self.ranks[j][np.where(fits, b + out, 0)]
            out += (fits & same).astype(np.int64) << j
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers are equal up to places a and b, these included; a is before b."""
        out = np.zeros(len(a), np.int64)
        for j in range(len(self.ranks) - 1, -1, -1):
            first = a - out - (1 << j) + 1
            same = self.ranks[j][np.maximum(first, 0)] == self.ranks[j][np.maximum(first + b - a, 0)]
            out += ((first >= 0) & same).astype(np.int64) << j
        return out


def ranges(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts n, the owner of each of their units and its number from 1."""
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + 1


def runs_in(x: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of the runs of x that lie in its segments, in order."""
    size = end - begin
    owner, place = ranges(size + 1)  # one place more for each, whose number is found nowhere else
    inner = place <= size[owner]
    y = np.full(len(owner), -1, np.int64)
    source = np.where(inner, begin[owner] + place - 1, 0)
    y[inner] = x[source[inner]]
    y[~inner] = -1 - owner[~inner]
    first = np.cumsum(size + 1) - size - 1
    blocks = Blocks(y, int(size.max()))
    found = []
    w = 1 << (max(least, 2) - 1).bit_length() - 1
    while w < len(y):
        m = np.arange(w, len(y), 2 * w)
        s, e = first[owner[m]], first[owner[m]] + size[owner[m]]
        ok = (m > s) & (m < e)
        m, s, e = m[ok], s[ok], e[ok]
        for right in (True, False):
            most = np.minimum(w, e - m if right else m - s) * 2 // times
            k, q = ranges(most)
            at = m[k]
            a, b = (at - 1, at - 1 + q) if right else (at - q, at)
            hit = y[a] == y[b]
            at, q = at[hit], q[hit]
            a = at if right else at - q  # a and a + q are the first pair after the cut
            on, back = blocks.onward(a, a + q), blocks.backward(a - 1, a - 1 + q)
            start, stop = a - back, a + q + on
            good = stop - start >= np.maximum(least, times * q)
            found.append((start[good], stop[good], q[good]))
        w *= 2
    start, stop, q = (np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*found)) if found else [np.zeros(0, np.int64)] * 3
    order = np.lexsort((q, stop, start))
    start, stop, q = start[order], stop[order], q[order]
    fresh = np.ones(len(q), bool)
    fresh[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])  # of a stretch's periods, the smallest
    start, stop, q = start[fresh], stop[fresh], q[fresh]
    order = np.lexsort((q, start))
    return source[start][order], (source[start] + stop - start)[order], q[order]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and the place of each text's first word, with the end."""
    cut = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.string()))
    flat, edges = cut.flatten(), cut.offsets.to_numpy() - (cut.offsets[0].as_py() if len(cut.offsets) else 0)
    some = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(some)])
    return flat.filter(pa.array(some)), before[edges] if len(edges) else np.zeros(1, np.int64)


def runs_of(texts: pa.Array, least: int, times: int) -> tuple[list, pa.Array, np.ndarray]:
    """The runs of each text as an Arrow list, its text without what runs repeat, and its number of words."""
    words, edges = words_of(texts)
    n = np.diff(edges)
    owner = np.repeat(np.arange(len(texts)), n)
    x = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    begin, end = segments_of(repeated_grams(x, owner, least_overlap(least, times)), owner, least)
    start = stop = q = np.zeros(0, np.int64)
    if len(begin):
        start, stop, q = runs_in(x, begin, end, least, times)
    gone = np.zeros(len(x) + 1, np.int64)
    np.add.at(gone, start + q, 1)
    np.add.at(gone, stop, -1)
    stay = np.cumsum(gone)[:-1] == 0
    left = np.concatenate([[0], np.cumsum(stay)])[edges]
    kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.filter(pa.array(stay))), " ")
    of = owner[start]
    each = pa.StructArray.from_arrays([pa.array(start - edges[of]), pa.array(stop - start), pa.array(q)], names=["start", "length", "period"])
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), each), kept, n


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """doc_id, n_words, runs (start, length, period), text_kept of each row (doc_id, text).

    text_kept has the words that no run contains after its first period, joined by a space.
    """
    if least < 2 or times < 2:
        raise ValueError("a run has two words and two periods at least")
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id")
            for a, b in slices(texts, 2_000_000):
                runs, kept, n = runs_of(texts.slice(a, b - a), least, times)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n, pa.int64()), runs, kept], ["doc_id", "n_words", "runs", "text_kept"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, runs {RUNS}, text_kept string")


def strongest(runs: Column) -> Column:
    """The run with most periods, compared exactly; ties to the smaller start, then period; null without runs."""

    def order(a, b):
        more = a["length"] * b["period"] - b["length"] * a["period"]
        sign = F.when(more != 0, -F.signum(more)).when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["period"] - b["period"]))
        return sign.cast("int")

    return F.get(F.array_sort(runs, order), F.lit(0))


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text: in a tenth of the documents, by the checksum of doc_id, the words from one on are made to repeat."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", SPLIT), lambda w: w != "")
    n = F.size(words)
    rows = docs.select("doc_id", "text", g.alias("g"), ((h % 10 == 0) & F.col("text").rlike(WORD)).alias("chosen"))
    rows = rows.select("doc_id", "text", "g", F.when(F.col("chosen"), words).alias("words"))
    n = F.size("words").cast("long")
    a = F.col("g") % n
    p = 1 + F.floor((n - a) / (3 + F.col("g") % 8))
    placed = rows.select("doc_id", "text", "words", a.alias("a"), p.alias("p"))
    word = lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return placed.select("doc_id", F.when(F.col("words").isNotNull(), F.array_join(F.transform("words", word), " ")).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """The runs as counts, the strongest run and digests."""
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = found.select("doc_id", "runs", "text_kept", strongest(F.col("runs")).alias("best"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text_kept", 256).alias("collapsed_sha256"),
    )
