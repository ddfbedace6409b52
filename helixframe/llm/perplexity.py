"""Quality rules: repetition counts, and the perplexity of a modified Kneser-Ney model.

The model is of order ``ORDER`` over the UTF-8 bytes of a text's words with one
space between them, unfolded, so that it knows every script; n-grams go across
word borders, so the order of words counts.  It grows with the corpus.

Each language has its own model, and no text is scored by what it taught.  A
language's texts are halved by a hash of the text, so that exact copies stay
together, and each half is scored by the model of the other.

1. Tasks count the n-grams of what they read, as sorted arrays, and send them by
   language, last context byte ``d`` and a part of the byte before it.  All contexts
   and suffixes of order 3 and more of an n-gram lie in its own group, and a
   group has at most 2**24 n-grams for each byte before ``d`` that it holds.  Arrays
   of ``FAN`` tasks are merged at a time, in as many rounds as it takes.
2. Orders 1 and 2 and the discounts are made of sums of the groups, at most 65,536
   pairs of bytes for a language.
3. Each group becomes a sorted array of hashes and one of log probabilities.
4. Arrays of up to ``MOST_BROADCAST`` bytes in all are sent to the tasks that score.
   Beyond that texts are packed in blocks, and each block's n-grams are joined to the
   groups by Spark; results are the same.

A document's log perplexity is the mean negative log probability of its bytes
and its end.  For each language (null is one) the bounds lie ``WIDTH`` quartile
ranges outside the quartiles of documents that pass the base rules.

Null texts, empty ones and those of blanks have no words and fail the base rules;
long texts are scored whole; equal texts get equal values; rows that repeat are rows
of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices

ORDER, PARTS, FAN = 5, 4, 64
COUNTED, HELD = 8_000_000, 1_500_000  # bytes of text counted at once, and n-grams that a task holds of a half
MOST_BROADCAST, BLOCK, SLICE = 64_000_000, 16_000_000, 4_000_000
WIDTH = 3.0
LEAST_WORDS, REPEAT_WINDOW, MOST_REPEATED = 20, 8, 30
SYMBOLS = "#*$%&|<>"


def words_of(text) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def mixed(keys: np.ndarray) -> np.ndarray:
    """A 64-bit hash of n-grams; one-to-one."""
    x = (keys ^ (keys >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that end in each byte and in the end of each text, as numbers, and where a text's begin.

    Line ends stand before and after each text, which has none of its own.
    """
    pad = b"\n" * (ORDER - 1)
    raw = np.frombuffer(b"".join([x for t in texts for x in (pad, t, b"\n")]), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    before = np.cumsum(lengths) - lengths
    keys = np.zeros(max(len(raw) - ORDER + 1, 0), np.uint64)
    for k in range(ORDER):
        keys <<= np.uint64(8)
        keys |= raw[k : k + len(keys)]
    real = np.ones(len(keys), bool)
    starts = before[1:] + (ORDER - 1) * np.arange(1, len(texts))
    real[(starts[:, None] - np.arange(1, ORDER)).ravel()] = False
    return keys[real], before


def runs_of(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and their numbers or the sums of ``n``."""
    if n is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    return keys[at], (np.diff(at, append=len(keys)) if n is None else np.add.reduceat(n, at) if len(at) else n)


def with_half(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text, half: a hash of the language, whose last bit tells the half."""
    half = F.xxhash64("lang", F.col("lang").isNull()).bitwiseAND(F.lit(-2)).bitwiseOR(F.pmod(F.xxhash64("text"), F.lit(2)))
    return docs.select("doc_id", "lang", "text", half.alias("half"))


def in_groups(keys: np.ndarray):
    """(d, part, places) of the groups that n-grams are sent to."""
    d, c = (keys >> np.uint64(8)).astype(np.int64) & 255, (keys >> np.uint64(16)).astype(np.int64) & 255
    code = d * PARTS + c % PARTS
    order = np.argsort(code.astype(np.uint16), kind="stable")  # by radix
    found, at = np.unique(code[order], return_index=True)
    for g, places in zip(found.tolist(), np.split(order, at[1:])):
        yield g // PARTS, g % PARTS, places


COUNTS = "lang long, d int, part int, side int, task long, keys binary, n binary"
COUNT_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]


def count_grams(halved: DataFrame) -> DataFrame:
    """lang, d, part, side, task, keys, n: sorted arrays of n-grams and their numbers, from each task."""

    def run(batches):
        task = TaskContext.get().partitionId()
        waiting: dict[int, list[bytes]] = {}
        sizes: dict[int, int] = {}
        held: dict[int, list] = {}

        def counted(half):
            held.setdefault(half, []).append(runs_of(gram_keys(waiting.pop(half))[0]))
            sizes[half] = 0

        def sent(half):
            parts = held.pop(half)
            keys, n = runs_of(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))
            rows = [(half & -2, d, part, half & 1, task, keys[at].tobytes(), n[at].astype(np.int64).tobytes()) for d, part, at in in_groups(keys)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), COUNT_KINDS)], [f.split()[0] for f in COUNTS.split(", ")])

        for batch in batches:
            for half, text in zip(batch.column("half").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                if not words:
                    continue
                waiting.setdefault(half, []).append(b" ".join(words))
                sizes[half] = sizes.get(half, 0) + len(text)
                if sizes[half] >= COUNTED:
                    counted(half)
                    if sum(len(k) for k, _ in held[half]) >= HELD:
                        yield sent(half)
        for half in list(waiting):
            counted(half)
        for half in list(held):
            yield sent(half)

    return halved.select("half", "text").mapInArrow(run, COUNTS)


def numbers_in(column, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def in_rounds(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """The counts with the arrays of many tasks merged, so that ``FAN`` of a group are left at most."""

    def merge(key, table):
        rows = []
        for side in (0, 1):
            mine = table.filter(pa.compute.equal(table.column("side"), side))
            if mine.num_rows:
                keys, n = runs_of(*(np.concatenate(numbers_in(mine.column(c), t)) for c, t in (("keys", np.uint64), ("n", np.int64))))
                rows.append((*(k.as_py() for k in key[:3]), side, key[3].as_py(), keys.tobytes(), n.tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), COUNT_KINDS)], [f.split()[0] for f in COUNTS.split(", ")])

    counts = scratch.keep(counts)
    tasks = counts.agg(F.coalesce(F.max("task"), F.lit(0))).first()[0] + 1
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        counts = scratch.keep(counts.withColumn("task", F.floor(F.col("task") / FAN)).groupBy("lang", "d", "part", "task").applyInArrow(merge, COUNTS))
    return counts


def lower_grams(keys: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of an order from distinct ones of the next, and how many of those each ends."""
    return runs_of(keys & np.uint64((1 << 8 * order) - 1))


def how_often(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


MERGED = "lang long, d int, part int, keys binary, n0 binary, n1 binary, seen array<long>, follow0 binary, follow1 binary"


def merge_counts(counts: DataFrame) -> DataFrame:
    """A row for each group: its n-grams, their numbers in each half, and what orders 1 and 2 and the discounts are made of."""

    def run(key, table):
        side = table.column("side").to_numpy()
        keys, n = (numbers_in(table.column(c), t) for c, t in (("keys", np.uint64), ("n", np.int64)))
        owner = np.repeat(side, [len(k) for k in keys])
        keys, n = np.concatenate(keys), np.concatenate(n)
        known, of = np.unique(keys, return_inverse=True)
        both = [np.bincount(of, np.where(owner == s, n, 0), len(known)).astype(np.int64) for s in (0, 1)]
        seen, follow = [], []
        for count in both:
            mine = known[count > 0]
            four, n4 = lower_grams(mine, 4)
            three, n3 = lower_grams(four, 3)
            seen += how_often(count[count > 0]) + how_often(n4) + how_often(n3)
            follow.append(np.bincount((three & np.uint64(255)).astype(np.int64), minlength=256).astype(np.int64).tobytes())
        row = [*key, *(x.tobytes() for x in (known, *both)), seen, *follow]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.table([pa.array([x.as_py() if isinstance(x, pa.Scalar) else x], t) for x, t in zip(row, kinds)], [f.split()[0] for f in MERGED.split(", ")])

    return counts.groupBy("lang", "d", "part").applyInArrow(run, MERGED)


def discounts(seen) -> np.ndarray:
    """What is taken from counts of 0, 1, 2 and more, from how many n-grams have the counts 1 to 4."""
    n1, n2, n3, n4 = (max(1, x) for x in seen)
    y = n1 / (n1 + 2 * n2)
    return np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0, 0.05, 0.05, 0.05], [0, 0.95, 1.95, 2.95])


BELOW = "of_lang long, of_d int, below binary, off array<double>"


def low_orders(merged: DataFrame) -> DataFrame:
    """For each language and ``d``: the probabilities of all bytes after it by orders 1 and 2, by half, and the discounts of orders 5, 4 and 3."""

    def run(key, table):
        seen = np.array(table.column("seen").to_pylist(), np.int64).sum(0).reshape(2, 3, 4)
        d = table.column("d").to_numpy()
        off = np.array([[discounts(s) for s in one] for one in seen])
        out = np.empty((256, 2, 256))
        for side in (0, 1):
            pairs = np.zeros((256, 256), np.int64)
            np.add.at(pairs, d, np.stack(numbers_in(table.column(f"follow{side}"), np.int64)))
            single = (pairs > 0).sum(0)
            p = np.full(256, 1 / 256)
            for n in (single[None], pairs):
                take = discounts(how_often(n))[np.minimum(n, 3)]
                total = n.sum(1, keepdims=True)
                p = np.where(total > 0, (n - take + take.sum(1, keepdims=True) * p) / np.maximum(total, 1), p)
            out[:, side] = p
        mine = np.unique(d)
        names = [f.split()[0] for f in BELOW.split(", ")]
        return pa.table([pa.array([key[0].as_py()] * len(mine), pa.int64()), pa.array(mine, pa.int32()), pa.array([out[x].tobytes() for x in mine], pa.binary()), pa.array([off.ravel().tolist()] * len(mine), pa.list_(pa.float64()))], names)

    return merged.select("lang", "d", "seen", "follow0", "follow1").groupBy("lang").applyInArrow(run, BELOW)


def interpolated(asked: np.ndarray, grams: np.ndarray, n: np.ndarray, take: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities of an order for n-grams asked about, from its sorted n-grams, their counts, the discounts and the order below."""
    if not len(grams):
        return lower
    at = np.minimum(np.searchsorted(grams, asked), len(grams) - 1)
    hit = grams[at] == asked
    off = take[np.minimum(n, 3)]
    heads, first = np.unique(grams >> np.uint64(8), return_index=True)
    total, left = np.add.reduceat(n, first), np.add.reduceat(off, first)
    head = np.minimum(np.searchsorted(heads, asked >> np.uint64(8)), len(heads) - 1)
    p = (np.where(hit, n[at] - off[at], 0.0) + left[head] * lower) / total[head]
    return np.where(heads[head] == asked >> np.uint64(8), p, lower)


def group_scores(known: np.ndarray, asks: np.ndarray, n: np.ndarray, below: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in order, and log probabilities, of the n-grams of a group that a half asks for, by the counts ``n`` of the other."""
    asked, grams, n = known[asks], known[n > 0], n[n > 0]
    tables = [(grams, n)]
    for order in (4, 3):
        tables.append(lower_grams(tables[-1][0], order))
    p = below[(asked & np.uint64(255)).astype(np.int64)]
    for order, (gram, count), take in zip((3, 4, 5), tables[::-1], off[::-1]):
        p = interpolated(asked & np.uint64((1 << 8 * order) - 1), gram, count, take, p)
    h = mixed(asked)
    order = np.argsort(h)
    return h[order], np.log(p[order]).astype(np.float32)


MODEL = "half long, d int, part int, h binary, log_p binary"


def model_of(merged: DataFrame) -> DataFrame:
    """half, d, part, h, log_p: the n-grams that the half's texts hold, under the model of the other half."""

    def run(batches):
        for batch in batches:
            rows = []
            for lang, d, part, keys, n0, n1, below, off in zip(*(batch.column(c).to_pylist() for c in ("lang", "d", "part", "keys", "n0", "n1", "below", "off"))):
                known, n = np.frombuffer(keys, np.uint64), [np.frombuffer(x, np.int64) for x in (n0, n1)]
                below, off = np.frombuffer(below, np.float64).reshape(2, 256), np.array(off).reshape(2, 3, 4)
                for side in (0, 1):
                    h, log_p = group_scores(known, n[side] > 0, n[1 - side], below[1 - side], off[1 - side])
                    rows.append((lang | side, d, part, h.tobytes(), log_p.tobytes()))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, kinds)], [f.split()[0] for f in MODEL.split(", ")])

    match = (F.col("lang") == F.col("of_lang")) & (F.col("d") == F.col("of_d"))
    ready = merged.join(low_orders(merged), match).select("lang", "d", "part", "keys", "n0", "n1", "below", "off")
    return ready.mapInArrow(run, MODEL)


def repeated_words(words: list[bytes], numbers: dict) -> int:
    """Words inside windows of ``REPEAT_WINDOW`` words that the text has twice or more."""
    n = len(words) - REPEAT_WINDOW + 1
    if n < 2:
        return 0
    x = np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words))
    x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for k in range(REPEAT_WINDOW):
        h = h * np.uint64(0xD6E8FEB86659FD93) + x[k : k + n]
        h ^= h >> np.uint64(32)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, np.int64)
    twice[order[1:][same]] = 1
    twice[order[:-1][same]] = 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += twice
    edges[REPEAT_WINDOW : REPEAT_WINDOW + n] -= twice
    return int((np.cumsum(edges[:-1]) > 0).sum())


def base_features(text: str, words: list[bytes], numbers: dict) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    dups = 0
    if len(lines) > 1:
        lines = [x for x in lines if x.strip(" \t\x0b\x0c\r")]
        dups = len(lines) - len(set(lines))
    n, repeats = len(words), repeated_words(words, numbers)
    return n, chars, symbols, dups, repeats, n < LEAST_WORDS or 100 * repeats > MOST_REPEATED * n


class Lookup:
    """Values of sorted hashes; most are found by their upper bits at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(4, int(len(keys) * 4).bit_length()))
        self.slots = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.slots[(self.keys >> self.shift).astype(np.int64)] = np.arange(len(keys), dtype=np.int32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.slots[(keys >> self.shift).astype(np.int64)]
        missed = np.flatnonzero(self.keys[at] != keys)
        at[missed] = np.searchsorted(self.keys, keys[missed])
        return self.values[at]


SCORED = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, log_ppl double"


def scored_rows(doc_ids, langs, halves: np.ndarray, texts: list, lookup_of) -> pa.RecordBatch:
    """The base features and log_ppl (null without words) of texts; ``lookup_of`` gives a half's look-up."""
    rows: list = []
    for a, b in slices(texts, 4_000_000):
        split = [words_of(t) for t in texts[a:b]]
        numbers = {w: k for k, w in enumerate({w for words in split for w in words})}
        means: list = [None] * len(split)
        for half in np.unique(halves[a:b]).tolist():
            mine = [k for k in np.flatnonzero(halves[a:b] == half).tolist() if split[k]]
            if mine:
                keys, before = gram_keys([b" ".join(split[k]) for k in mine])
                values = lookup_of(half)(mixed(keys)).astype(np.float64)
                for k, x in zip(mine, (-np.add.reduceat(values, before) / np.diff(before, append=len(keys))).tolist()):
                    means[k] = x
        rows += [(*base_features(t or "", words, numbers), x) for t, words, x in zip(texts[a:b], split, means)]
    kinds = [*[pa.int64()] * 5, pa.bool_(), pa.float64()]
    cols = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, kinds)]
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(langs, pa.string()), *cols], [f.split()[0] for f in SCORED.split(", ")])


def score_by_broadcast(halved: DataFrame, model: DataFrame) -> DataFrame:
    """Scores with the whole model in each worker; its size has been checked."""
    arrays: dict[int, list] = {}
    for row in model.select("half", "h", "log_p").collect():
        arrays.setdefault(row.half, []).append((np.frombuffer(row.h, np.uint64), np.frombuffer(row.log_p, np.float32)))
    held = halved.sparkSession.sparkContext.broadcast({half: tuple(map(np.concatenate, zip(*parts))) for half, parts in arrays.items()})

    def run(batches):
        lookups: dict[int, Lookup] = {}

        def lookup_of(half):
            if half not in lookups:
                lookups[half] = Lookup(*held.value[half])
            return lookups[half]

        for batch in batches:
            if batch.num_rows:
                yield scored_rows(*(batch.column(c).to_pylist() for c in ("doc_id", "lang")), batch.column("half").to_numpy(), batch.column("text").to_pylist(), lookup_of)

    return halved.mapInArrow(run, SCORED)


def in_blocks(halved: DataFrame, size: int = BLOCK) -> DataFrame:
    """block, half, docs: texts of a half, about ``size`` characters in a row, as compressed Arrow streams."""

    def run(batches):
        task, number = TaskContext.get().partitionId(), itertools.count()
        waiting: dict[int, list] = {}
        sizes: dict[int, int] = {}

        def packed(half):
            table = pa.table(dict(zip(("doc_id", "lang", "text"), map(pa.array, zip(*waiting.pop(half)), (pa.int64(), pa.string(), pa.string())))))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            sizes[half] = 0
            return pa.RecordBatch.from_arrays([pa.array([f"{task}-{next(number)}"]), pa.array([half], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "half", "docs"])

        for batch in batches:
            for half, *row in zip(*(batch.column(c).to_pylist() for c in ("half", "doc_id", "lang", "text"))):
                waiting.setdefault(half, []).append(row)
                sizes[half] = sizes.get(half, 0) + len(row[2] or "")
                if sizes[half] >= size:
                    yield packed(half)
        for half in list(waiting):
            yield packed(half)

    return halved.select("half", "doc_id", "lang", "text").mapInArrow(run, "block string, half long, docs binary")


def docs_in(stream) -> pa.Table:
    return pa.ipc.open_stream(stream).read_all()


def sliced(model: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The model's groups cut by the leading bits of hashes, so that no row has much more than ``most`` bytes: half, d, part, slice, h, log_p; and the number of bits."""
    largest = model.agg(F.coalesce(F.max(F.octet_length("h") + F.octet_length("log_p")), F.lit(0))).first()[0]
    bits = max(0, -(-largest // most) - 1).bit_length()

    def run(batches):
        for batch in batches:
            rows = []
            for half, d, part, h, log_p in zip(*(batch.column(c).to_pylist() for c in ("half", "d", "part")), numbers_in(batch.column("h"), np.uint64), numbers_in(batch.column("log_p"), np.float32)):
                for k, a, b in slices_of(h, bits):
                    rows.append((half, d, part, k, h[a:b].tobytes(), log_p[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()])], ["half", "d", "part", "slice", "h", "log_p"])

    return model.select("half", "d", "part", "h", "log_p").mapInArrow(run, "half long, d int, part int, slice long, h binary, log_p binary"), bits


def slices_of(h: np.ndarray, bits: int):
    """(slice, begin, end) of the stretches of sorted hashes with equal leading bits."""
    if not bits:
        yield 0, 0, len(h)
        return
    lead = (h >> np.uint64(64 - bits)).astype(np.int64)
    begins = np.flatnonzero(np.concatenate([[True], lead[1:] != lead[:-1]])) if len(lead) else np.zeros(0, np.int64)
    for k, a, b in zip(lead[begins].tolist(), begins.tolist(), np.append(begins[1:], len(lead)).tolist()):
        yield k, a, b


def questions(docs: pa.Table, bits: int):
    """(d, part, slice, sorted hashes) of the n-grams of some texts."""
    texts = [b" ".join(w) for w in map(words_of, docs.column("text").to_pylist()) if w]
    known = runs_of(gram_keys(texts)[0])[0] if texts else np.zeros(0, np.uint64)
    for d, part, at in in_groups(known):
        h = np.sort(mixed(known[at]))
        for k, a, b in slices_of(h, bits):
            yield d, part, k, h[a:b]


def score_by_join(halved: DataFrame, model: DataFrame, scratch: Scratch, size: int = BLOCK, most: int = SLICE) -> DataFrame:
    """Scores blocks of texts, each with the values of its own n-grams.

    The n-grams that blocks ask about go to the slices of the model, each of which is sent once and
    stands before what is asked of it; the values go back to the blocks, in the order of the questions.  So what is sent grows as the model and the questions
    do, and a task holds a slice and a block's questions of it.
    """
    blocks = scratch.keep(in_blocks(halved, size))
    parts, bits = sliced(model, most)

    def ask(batches):
        for batch in batches:
            for block, half, stream in zip(*(batch.column(c).to_pylist() for c in ("block", "half", "docs"))):
                rows = [(half, d, part, k, block, h.tobytes()) for d, part, k, h in questions(docs_in(stream), bits)]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, kinds)], ["half", "d", "part", "slice", "block", "h"])

    def answer(batches):
        held = None
        for batch in batches:
            rows = []
            for *place, block, h, log_p in zip(*(batch.column(c).to_pylist() for c in ("half", "d", "part", "slice", "block", "h", "log_p"))):
                h = np.frombuffer(h, np.uint64)
                if block is None:
                    held = (place, h, np.frombuffer(log_p, np.float32))
                else:
                    assert held and held[0] == place
                    rows.append((block, *place[1:], held[2][np.searchsorted(held[1], h)].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary()])], ["block", "d", "part", "slice", "log_p"])

    place = ["half", "d", "part", "slice"]
    asked = blocks.mapInArrow(ask, "half long, d int, part int, slice long, block string, h binary").withColumn("log_p", F.lit(None).cast("binary"))
    both = parts.withColumn("block", F.lit(None).cast("string")).select(*place, "block", "h", "log_p").unionByName(asked)
    answers = both.repartition(*place).sortWithinPartitions(*place, F.col("block").asc_nulls_first()).mapInArrow(answer, "block string, d int, part int, slice long, log_p binary")

    def score(block, known):
        docs = docs_in(block.column("docs")[0].as_py())
        values = dict(zip(zip(*(known.column(c).to_pylist() for c in ("d", "part", "slice"))), numbers_in(known.column("log_p"), np.float32)))
        asked = list(questions(docs, bits))
        lookup = Lookup(np.concatenate([h for *_, h in asked]), np.concatenate([values[tuple(place)] for *place, _ in asked])) if asked else None
        halves = np.full(docs.num_rows, block.column("half")[0].as_py())
        return pa.Table.from_batches([scored_rows(docs.column("doc_id"), docs.column("lang"), halves, docs.column("text").to_pylist(), lambda _: lookup)])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, SCORED)


def bounds(scored: DataFrame, width: float = WIDTH) -> DataFrame:
    """of, low, high: exact quartiles, from a histogram of log perplexity to three decimals."""
    counts = scored.where(~F.col("base_failed")).groupBy("lang", F.round("log_ppl", 3).alias("x")).count()
    q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.75)), F.col("count"))
    found = counts.groupBy(F.col("lang").alias("of")).agg(q.alias("q"))
    margin = F.lit(width) * (F.col("q")[1] - F.col("q")[0])
    return found.select("of", (F.col("q")[0] - margin).alias("low"), (F.col("q")[1] + margin).alias("high"))


def quality(docs: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """doc_id, n_words, the base counts, base_failed, kept, log_ppl, lang."""
    with Scratch(docs.sparkSession) as scratch:
        halved, counting = with_half(docs), Scratch(docs.sparkSession)
        model = scratch.keep(model_of(counting.keep(merge_counts(in_rounds(count_grams(halved), counting)))))
        counting.close()
        n_bytes = model.agg(F.coalesce(F.sum(F.octet_length("h") + F.octet_length("log_p")), F.lit(0))).first()[0]
        scored = scratch.keep(score_by_broadcast(halved, model) if n_bytes <= most_broadcast else score_by_join(halved, model, scratch))
        joined = scored.join(bounds(scored), F.col("lang").eqNullSafe(F.col("of")), "left")
        inside = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(False))
        return scratch.result(joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"), "log_ppl", "lang"))
