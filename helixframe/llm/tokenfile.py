"""Token ids in binary shards under a Re-Pair grammar.

Texts are encoded as the vocabulary's library does without adding special
tokens; the text of a special token stands for its id, as there.
Documents in ascending doc_id are cut into shards of about ``SHARD_IDS`` ids.
In a shard, frequent pairs of neighbouring ids are replaced by nonterminals,
until no pair within documents is left ``LEAST`` times.  A round replaces many pairs at once; no id that ends one of
them begins another, so their places never overlap but in runs of a single id,
which are paired from the left.  No pair passes the end of a document, so a
document is a slice of the shard's symbols and can be decoded alone.

A shard's bytes, little-endian: the magic ``HXRP``, then as unsigned 32-bit
numbers the version, the number of documents, of rules and of symbols and the first
nonterminal; the documents' ids (signed 64-bit, with a byte for null),
numbers of ids (64-bit) and numbers of symbols (64-bit); the rules' left and right
symbols and expansion lengths (32-bit); and the symbols as four byte planes.

Shards are rows of a table in the shared folder: part (which range of doc_id),
shard, first (ids before it in its part), n_ids, content.  Null texts are empty
and hold the end id alone; rows that repeat a doc_id are kept in text order, and those
without one come first; a text of any length lies in one shard; an empty table
gives no shards.
"""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, Stretches, slices

SHARD_IDS = 1 << 20
PAIRS, LEAST, BITS = 2048, 32, 18
END_ID = 0


@functools.lru_cache(maxsize=1)
def remembered(path: str) -> Stretches:
    """What a Python worker knows of a vocabulary, from task to task."""
    found = tokenizer(path)
    lengths = np.zeros(max(found.get_vocab(with_added_tokens=True).values()) + 1, np.int64)
    for token, k in found.get_vocab(with_added_tokens=False).items():
        lengths[k] = len(token)  # the vocabulary writes each byte as a character
    for k, token in found.get_added_tokens_decoder().items():
        lengths[k] = len(token.content.encode())
    whole = lambda texts: [np.array(e.ids, np.uint32).tobytes() for e in found.encode_batch_fast(texts, add_special_tokens=False)]
    return Stretches(lambda stretches: encode_joined(found, lengths, stretches), whole)


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode_joined(found, lengths: np.ndarray, chunks: list[str], most: int = 1_000) -> list[bytes]:
    """Ids of stretches of text that begin at piece borders: many are encoded as one text and told apart by their tokens' numbers of bytes."""
    out: list[bytes] = []
    for k in range(0, len(chunks), most):
        part = chunks[k : k + most]
        ends = np.cumsum(list(map(len, map(str.encode, part))))
        ids = np.array(found.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, np.uint32)
        cuts = (np.searchsorted(np.cumsum(lengths[ids]), ends, "right") * 4).tolist()
        held = ids.tobytes()
        out += map(held.__getitem__, map(slice, [0, *cuts], cuts))
    return out


def frequent_places(symbols: np.ndarray, last: np.ndarray, least: int) -> np.ndarray:
    """Places of all pairs that occur ``least`` times, and of a few others: those whose slots count as many."""
    slot = ((symbols[:-1] * np.uint32(0x9E3779B1) ^ symbols[1:]) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)).astype(np.int64)
    counts = np.bincount(slot[~last[:-1]], minlength=1 << BITS)
    return np.flatnonzero((counts >= least)[slot] & ~last[:-1])


def sorted_pairs(symbols: np.ndarray, after: np.ndarray, at: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that begin at places, as numbers, in order, and their places, in order for each pair; symbols are below ``top``."""
    wide, far = top.bit_length(), len(symbols).bit_length()
    both = symbols[at].astype(np.uint64)
    both <<= np.uint64(wide)
    both |= symbols[after[at]]
    if 2 * wide + far > 64:
        order = np.argsort(both, kind="stable")
        return both[order], at[order]
    both <<= np.uint64(far)  # pair and place fit in one number, which sorts faster
    both |= at.view(np.uint32)
    both.sort()
    places = (both & np.uint64((1 << far) - 1)).astype(np.int32)
    both >>= np.uint64(far)
    return both, places


def replace_pairs(symbols: np.ndarray, last: np.ndarray, top: int, most: int = PAIRS, least: int = LEAST):
    """The symbols and ends that are left, and the rules as pairs; ``top`` is the first free nonterminal.

    Places keep their numbers and are linked to the next and the one before, so
    a round looks only at pairs that were frequent in the last one and
    at those beside what it replaced: counts of other pairs only fall.
    """
    n = len(symbols)
    if n < 2:
        return symbols, last, []
    symbols = symbols.copy()
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    ends = np.flatnonzero(last)
    after[ends] = -1
    before[0] = -1
    before[ends[:-1] + 1] = -1
    rules: list = []
    alive, looked = np.ones(n, bool), np.zeros(n, bool)
    looked[frequent_places(symbols, last, least)] = True
    while looked.any():
        pairs, at = sorted_pairs(symbols, after, np.flatnonzero(looked).astype(np.int32), top + len(rules))
        new = np.ones(len(pairs), bool)
        new[1:] = pairs[1:] != pairs[:-1]
        first = np.flatnonzero(new)
        count = np.diff(first, append=len(pairs))
        often = count >= least
        full = np.flatnonzero(often)
        if not len(full):
            break
        wide = (top + len(rules)).bit_length()
        begins, finishes, chosen = set(), set(), []
        best = full[np.lexsort((pairs[first[full]], -count[full]))][:most]
        for g, pair in zip(best.tolist(), pairs[first[best]].tolist()):
            a, b = pair >> wide, pair & ((1 << wide) - 1)
            if a in finishes or b in begins or (a == b and a in begins):
                continue
            begins.add(a)
            finishes.add(b)
            if a == b:  # neither in another pair
                begins.add(b)
                finishes.add(a)
            chosen.append((g, a, b))
        rule = np.full(len(first), -1, np.int32)
        rule[[g for g, _, _ in chosen]] = top + len(rules) + np.arange(len(chosen))
        rules += [(a, b) for _, a, b in chosen]
        looked[:] = False
        looked[at[np.repeat(often, count)]] = True
        to = np.repeat(rule, count)
        hit = to >= 0
        at, to = at[hit], to[hit]
        again = np.zeros(len(at), bool)  # a place right after one of the same pair, in a run of one symbol
        again[1:] = (after[at[:-1]] == at[1:]) & (to[1:] == to[:-1])
        if again.any():
            order = np.arange(len(at))
            odd = (order - np.maximum.accumulate(np.where(again, 0, order))) & 1
            at, to = at[odd == 0], to[odd == 0]
        gone = after[at]
        beyond = after[gone]
        symbols[at], after[at] = to, beyond
        alive[gone] = looked[gone] = False
        real = beyond >= 0
        before[beyond[real]] = at[real]
        looked[at] = real
        near = before[at]
        looked[near[near >= 0]] = True
    ended = np.zeros(n, bool)
    ended[alive & (after == -1)] = True
    return symbols[alive], ended[alive], rules


def expansions(rules: np.ndarray, first: int):
    """Of all nonterminals: the lengths, starts and flat ids of what they stand for."""
    flat: list[np.ndarray] = []
    for a, b in rules.tolist():
        parts = [flat[x - first] if x >= first else np.array([x], np.uint32) for x in (a, b)]
        flat.append(np.concatenate(parts))
    lengths = np.array([len(x) for x in flat], np.int64)
    return lengths, np.cumsum(lengths) - lengths, np.concatenate(flat) if flat else np.zeros(0, np.uint32)


def pack_shard(doc_ids: list, ids: list[np.ndarray]) -> bytes:
    n_ids = np.array([len(x) for x in ids], np.int64)
    symbols = np.concatenate(ids).astype(np.uint32)
    last = np.zeros(len(symbols), bool)
    last[np.cumsum(n_ids) - 1] = True
    first = int(symbols.max()) + 1
    symbols, last, rules = replace_pairs(symbols, last, first)
    table = np.array(rules, np.uint32).reshape(-1, 2)
    lengths = np.ones(len(rules), np.uint32)
    for k, pair in enumerate(rules):
        lengths[k] = sum(int(lengths[x - first]) if x >= first else 1 for x in pair)
    ends = np.flatnonzero(last) + 1
    n_symbols = np.diff(ends, prepend=0).astype(np.int64)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([d or 0 for d in doc_ids], np.int64)
    planes = np.ascontiguousarray(symbols.view(np.uint8).reshape(-1, 4).T)
    head = b"HXRP" + struct.pack("<5I", 1, len(ids), len(table), len(symbols), first)
    return b"".join([head, names.tobytes(), known.tobytes(), n_ids.tobytes(), n_symbols.tobytes(), table[:, 0].tobytes(), table[:, 1].tobytes(), lengths.tobytes(), planes.tobytes()])


class Shard:
    """A shard's bytes: its documents, and the ids of all or one of them."""

    def __init__(self, content: bytes):
        if content[:4] != b"HXRP":
            raise ValueError("not a shard of token ids")
        version, docs, rules, symbols, self.first = struct.unpack_from("<5I", content, 4)
        if version != 1:
            raise ValueError(f"unknown version {version}")
        at = 24

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(content, kind, n, at)
            at += out.nbytes
            return out

        names, known = take(np.int64, docs), take(np.uint8, docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(names, known)]
        self.n_ids, self.n_symbols = take(np.int64, docs), take(np.int64, docs)
        self.rules = np.stack([take(np.uint32, rules), take(np.uint32, rules)], 1)
        self.lengths = take(np.uint32, rules).astype(np.int64)
        self.planes = take(np.uint8, symbols * 4).reshape(4, -1)
        self.begins = np.concatenate([[0], np.cumsum(self.n_symbols)])

    def symbols_of(self, begin: int, end: int) -> np.ndarray:
        return np.ascontiguousarray(self.planes[:, begin:end].T).view(np.uint32).ravel()

    @property
    def symbols(self) -> np.ndarray:
        return self.symbols_of(0, self.planes.shape[1])

    @functools.cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each symbol how many ids it stands for, where they begin, and the ids; every rule is expanded."""
        starts, flat = expansions(self.rules, self.first)[1:]
        ids = np.arange(self.first)  # an id stands for itself
        return np.concatenate([np.ones(self.first, np.int64), self.lengths]), np.concatenate([ids, starts + self.first]), np.concatenate([ids.astype(np.uint32), flat])

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        all_lengths, all_starts, all_flat = self.tables
        lengths = all_lengths[symbols]
        at = np.repeat(all_starts[symbols] - (np.cumsum(lengths) - lengths), lengths)
        at += np.arange(len(at))
        return all_flat[at]

    def all_ids(self) -> np.ndarray:
        return self.expand(self.symbols)

    def ids_of(self, k: int, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Of the k-th document alone, or of a range of its ids.

        Only the document's symbols are read, and only rules that the range meets are opened: the stored
        lengths tell where each symbol's ids begin.
        """
        x = self.symbols_of(int(self.begins[k]), int(self.begins[k + 1])).astype(np.int64)
        end = int(self.n_ids[k]) if end is None else min(end, int(self.n_ids[k]))
        size = lambda x: np.where(x >= self.first, self.lengths[np.maximum(x - self.first, 0)] if len(self.lengths) else 1, 1)
        at = np.cumsum(size(x)) - size(x)
        while True:
            met = (at < end) & (at + size(x) > begin)
            x, at = x[met], at[met]
            rule = x >= self.first
            if not rule.any():
                return x.astype(np.uint32)
            owner = np.repeat(np.arange(len(x)), 1 + rule)
            second = np.zeros(len(owner), bool)
            second[1:] = owner[1:] == owner[:-1]
            opened = rule[owner]
            left = np.where(opened, self.rules[np.where(opened, x[owner] - self.first, 0), 0], 0).astype(np.int64)
            right = np.where(opened, self.rules[np.where(opened, x[owner] - self.first, 0), 1], 0).astype(np.int64)
            at = at[owner] + np.where(second, size(left), 0)
            x = np.where(~opened, x[owner], np.where(second, right, left))


def write_shards(docs: DataFrame, path: str, scratch: Scratch, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes the documents' shards as a table that outlives the scratch folder, and returns it as read back."""

    def run(batches):
        part, shard, first = TaskContext.get().partitionId(), 0, 0
        known, end = remembered(path), np.array([END_ID], np.uint32)
        names, ids, held = [], [], 0

        def pack():
            content = pack_shard(names, ids)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([first], pa.int64()), pa.array([held], pa.int64()), pa.array([content], pa.binary())], ["part", "shard", "first", "n_ids", "content"])

        for batch in batches:
            texts, own = batch.column("text"), batch.column("doc_id").to_pylist()
            for a, b in slices(texts):
                for name, found in zip(own[a:b], known.ids(texts.slice(a, b - a))):
                    found = np.append(found, end)
                    names.append(name)
                    ids.append(found)
                    held += len(found)
                    if held >= shard_ids:
                        yield pack()
                        names, ids, shard, first, held = [], [], shard + 1, first + held, 0
        if names:
            yield pack()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return scratch.result(ordered.mapInArrow(run, "part int, shard int, first long, n_ids long, content binary"))


def read_shards(table: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the shards' bytes.

    The totals that are summed up in one task are one row for each range of
    doc_id, that is for each task that wrote.
    """
    parts = table.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = parts.select(F.col("part").alias("of"), before.alias("base"))

    def run(batches):
        for batch in batches:
            for part, first, content in zip(*(batch.column(c).to_pylist() for c in ("part", "first", "content"))):
                shard = Shard(content)
                ids = shard.all_ids()
                ends = np.cumsum(shard.n_ids)
                starts = ends - shard.n_ids
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(crc), pa.int32()), pa.array(shard.doc_ids, pa.int64()), pa.array(starts + first), pa.array(shard.n_ids), pa.array(crc, pa.int64())], ["part", "doc_id", "start", "n_tokens", "ids_crc32"])

    one = table.select("part", "first", "content")
    read = one.mapInArrow(run, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return read.join(F.broadcast(bases), F.col("part") == F.col("of")).select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
