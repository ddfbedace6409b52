"""Byte-level BPE in numpy: length-bucketed padded matrices of ids, merged round by round.

Text is cut into pieces by the vocabulary's pattern.  Distinct pieces are laid
out as rows of padded matrices, one for each length bucket.  In each round every
row merges its leftmost pair of minimum rank; pairs are looked up in a hash
table, merged rows are closed up, and rows with no pair left are taken out of
the matrix.  A piece of more than ``LONG`` bytes is a padded matrix of its own, whose rows
follow each other: a round merges the leftmost pair of minimum rank among the
rows' minima, so that it looks at one or two rows only.

Null texts are empty; an empty text has no ids; texts and pieces of any length are
encoded whole; equal texts get equal results and rows that repeat are rows of
their own; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Stretches, slices, small_batches

NONE = np.int32(2**31 - 1)
LONG = 256
MOST_KNOWN, CHARS = 250_000, 1_000_000  # stretches that a worker remembers, and characters that it encodes at a time


class PairTable:
    """Open-addressing hash table from a pair of ids to the rank of the joined token."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray):
        self.bits = max(4, int(len(pairs) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        left, slot = np.arange(len(pairs)), self.slot(pairs)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.keys[slot[left]] == -1
            first = left[free]
            self.keys[slot[first]] = pairs[first]
            done = self.keys[slot[left]] == pairs[left]
            self.ranks[slot[left[done]]] = ranks[left[done]]
            left = left[~done]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Ranks of packed pairs; NONE where the pair can't be joined."""
        slot = self.slot(keys)
        out = np.where(self.keys[slot] == keys, self.ranks[slot], NONE)
        left = np.flatnonzero((out == NONE) & (self.keys[slot] != -1))
        for _ in range(self.probes):
            if not len(left):
                break
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            here = self.keys[slot[left]]
            hit = here == keys[left]
            out[left[hit]] = self.ranks[slot[left[hit]]]
            left = left[~hit & (here != -1)]
        return out


class Bpe:
    """A vocabulary of ranks: encodes pieces of bytes and decodes ids."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        keys, joined = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    joined.append(rank)
        self.table = PairTable(np.array(keys, np.int64), np.array(joined, np.int32))
        size = max(self.ranks.values()) + 1
        by_id = [b""] * size
        for token, rank in self.ranks.items():
            by_id[rank] = token
        self.lengths = np.array([len(t) for t in by_id], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.id_bytes = {token: np.uint32(rank).tobytes() for token, rank in self.ranks.items()} | {b"": b""}
        self.decimals = np.array([b"%d " % k for k in range(size)])

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        out = np.full(keys.shape, NONE, np.int32)
        real = right >= 0
        out[real] = self.table.find(keys[real])
        return out

    def _bucket(self, rows: np.ndarray) -> list[bytes]:
        """Merges the rows of one padded matrix, -1 pads; each row's ids as bytes."""
        number, ids = [], []
        which = np.arange(len(rows))
        pairs = self._pairs(rows[:, :-1], rows[:, 1:])
        while len(rows):
            at = pairs.argmin(1) if pairs.shape[1] else np.zeros(len(rows), np.int64)
            line = np.arange(len(rows))
            best = pairs[line, at] if pairs.shape[1] else np.full(len(rows), NONE)
            done = best == NONE
            if done.any():
                number.append(which[done])
                ids.append(rows[done])
            go = ~done
            rows, pairs, at, best, which = rows[go], pairs[go], at[go], best[go], which[go]
            if not len(rows):
                break
            rows[np.arange(len(rows)), at] = best
            width = rows.shape[1] - 1
            cols = np.arange(width)
            rows = np.take_along_axis(rows, cols + (cols > at[:, None]), 1)
            if width == 1:
                pairs = pairs[:, :0]
                continue
            cols = np.arange(width - 1)
            pairs = np.take_along_axis(pairs, cols + (cols >= at[:, None]), 1)
            after = np.flatnonzero(at < width - 1)
            pairs[after, at[after]] = self._pairs(rows[after, at[after]], rows[after, at[after] + 1])
            before = np.flatnonzero(at > 0)
            pairs[before, at[before] - 1] = self._pairs(rows[before, at[before] - 1], rows[before, at[before]])
        size = np.concatenate([(x >= 0).sum(1) for x in ids])
        held = b"".join([x[x >= 0].tobytes() for x in ids])
        ends = (np.cumsum(size) * 4).tolist()
        cut = list(map(held.__getitem__, map(slice, [0, *ends], ends)))
        return [cut[k] for k in np.argsort(np.concatenate(number)).tolist()]

    @functools.cached_property
    def rank_of(self) -> dict[int, int]:
        """The hash table's content, for look-ups of one pair."""
        there = self.table.keys >= 0
        return dict(zip(self.table.keys[there].tolist(), self.table.ranks[there].tolist()))

    def _long(self, piece: bytes, width: int = LONG) -> np.ndarray:
        """Merges one piece laid out over the rows of a padded matrix."""
        ids = self.of_byte[np.frombuffer(piece, np.uint8)]
        n = -(-len(ids) // width)
        rows, pairs = np.full((n, width), -1, np.int32), np.full((n, width), NONE, np.int32)
        rows.ravel()[: len(ids)] = ids
        pairs.ravel()[: len(ids) - 1] = self._pairs(ids[:-1], ids[1:])
        size = np.minimum(len(ids) - width * np.arange(n), width).tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # rows that aren't empty
        least = pairs.min(1)

        def rank(left, right) -> int:
            return self.rank_of.get(int(left) << 32 | int(right), int(NONE))

        def drop(r: int, j: int) -> None:
            """Closes a row up over the place ``j``."""
            size[r] -= 1
            rows[r, j : size[r]], pairs[r, j : size[r]] = rows[r, j + 1 : size[r] + 1], pairs[r, j + 1 : size[r] + 1]
            rows[r, size[r]], pairs[r, size[r]] = -1, NONE
            if not size[r]:
                if before[r] >= 0:
                    after[before[r]] = after[r]
                if after[r] < n:
                    before[after[r]] = before[r]

        while True:
            r = int(least.argmin())
            if least[r] == NONE:
                return rows[rows >= 0]
            j = int(pairs[r].argmin())
            rows[r, j] = pairs[r, j]
            if j + 1 < size[r]:
                drop(r, j + 1)
            else:
                beyond = after[r]
                drop(beyond, 0)
                least[beyond] = pairs[beyond].min()
            follow = rows[r, j + 1] if j + 1 < size[r] else rows[after[r], 0] if after[r] < n else None
            pairs[r, j] = rank(rows[r, j], follow) if follow is not None else NONE
            if j:
                pairs[r, j - 1] = rank(rows[r, j - 1], rows[r, j])
            elif before[r] >= 0:
                near = before[r]
                pairs[near, size[near] - 1] = rank(rows[near, size[near] - 1], rows[r, 0])
                least[near] = pairs[near].min()
            least[r] = pairs[r].min()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Each piece's ids as bytes of 32-bit numbers."""
        out: list = list(map(self.id_bytes.get, pieces))
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if out[i] is None:
                if len(piece) > LONG:
                    out[i] = self._long(piece).tobytes()
                else:
                    buckets.setdefault(-(-len(piece) // 4) * 4, []).append(i)
        for width, members in buckets.items():
            for k in range(0, len(members), max(1, 2_000_000 // max(width, 1))):
                part = members[k : k + max(1, 2_000_000 // max(width, 1))]
                mine = [pieces[i] for i in part]
                lengths = np.fromiter(map(len, mine), np.int64, len(mine))
                rows = np.full((len(part), width), -1, np.int32)
                rows[np.arange(width) < lengths[:, None]] = self.of_byte[np.frombuffer(b"".join(mine), np.uint8)]
                for i, ids in zip(part, self._bucket(rows)):
                    out[i] = ids
        return out

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of stretches of text as bytes of 32-bit numbers, each cut into pieces by the pattern."""
        cut = list(map(self.pattern.findall, chunks))
        distinct = list(set(itertools.chain.from_iterable(cut)))
        ids = dict(zip(distinct, self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in distinct])))
        return [ids[pieces[0]] if len(pieces) == 1 else b"".join(map(ids.__getitem__, pieces)) for pieces in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids):
            return b""
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.bytes[at].tobytes()


@functools.lru_cache(maxsize=1)
def remembered(path: str, pattern: str) -> tuple[Bpe, Stretches]:
    """A vocabulary, and the ids of stretches of text; kept by a Python worker from task to task."""
    bpe = Bpe(path, pattern)
    return bpe, Stretches(bpe.encode_chunks, bpe.encode_chunks, MOST_KNOWN)


def encode_texts(bpe: Bpe, known: Stretches, texts):
    """Ids of each text of an Arrow array, as int32, and their decimal text as bytes."""
    for ids in known.ids(texts):
        yield ids.view(np.int32), bpe.decimals[ids].tobytes().translate(None, b"\0")[:-1]


def encode_and_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int), decoded (binary) of each document's whole text."""

    def run(batches):
        bpe, known = remembered(path, pattern)
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts, CHARS):
                ids = [i for i, _ in encode_texts(bpe, known, texts.slice(a, b - a))]
                ends = np.cumsum([0, *map(len, ids)])
                flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.array([bpe.decode(i) for i in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, sha256 of the ids' decimal text and of the decoded bytes; ids and bytes stay inside the task."""

    def run(batches):
        bpe, known = remembered(path, pattern)
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts, CHARS):
                n, named, decoded = [], [], []
                for ids, decimal in encode_texts(bpe, known, texts.slice(a, b - a)):
                    n.append(len(ids))
                    named.append(hashlib.sha256(decimal).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n, pa.int64()), pa.array(named), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
