"""What the text operators share: the word rule, the shared folder and tables written there.

A document's words are the maximal runs of characters other than space and
U+0009 to U+000D.  Operators read the columns they name and no others, so
further columns of any name never disturb them.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import drop, new_path

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lets Arrow batches of the session hold ``BATCH_ROWS`` rows at most from here on.

    That bounds what the JVM and a Python worker hold of rows with whole texts; as the
    frames that operators return run later, the setting stays.
    """
    rows = int(spark.conf.get(BATCH_CONF))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))


class Scratch:
    """Tables in the shared folder that cut a job's lineage; those still held are removed on exit.

    ``keep`` writes and rereads a table; ``keep_sorted`` does so in buckets, sorted
    by the columns, which joins on them read without an exchange.  ``result`` is for the
    table an operator returns, which outlives the block; it is removed when
    the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.names = spark, [], []

    def __enter__(self) -> "Scratch":
        small_batches(self.spark)
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop(self.spark, *self.paths)
        self.paths, self.names = [], []

    def _write(self, df: DataFrame, path: str, partition_by: list[str]) -> DataFrame:
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame, *partition_by: str) -> DataFrame:
        path = new_path(self.spark)
        self.paths.append(path)
        return self._write(df, path, list(partition_by))

    def keep_sorted(self, df: DataFrame, *columns: str) -> DataFrame:
        path, name = new_path(self.spark), f"kept_{uuid.uuid4().hex}"
        self.paths.append(path)
        self.names.append(name)
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, *columns).sortBy(*columns).saveAsTable(name)
        return self.spark.table(name)

    def result(self, df: DataFrame) -> DataFrame:
        return self._write(df, new_path(self.spark), [])


def n_words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(texts, chars: int = 4_000_000):
    """Consecutive index ranges of a list or Arrow array whose texts hold about ``chars`` characters (bytes, in an array), so that memory is bounded by one text or that."""
    sizes = [len(t) if t else 0 for t in texts] if isinstance(texts, list) else pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        held += size
        if held >= chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


ASCII_BLANK = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
BYTE_MASKS = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(16)], np.uint64)


class Stretches:
    """Ids of texts, made of those of their stretches, each computed once and remembered in numpy tables.

    A text is cut before each space and line end that stands between two
    characters that aren't white space, as no piece of the pre-tokenizer's pattern passes
    such a place; a text with other white space beside one is encoded whole.
    Stretches of up to 15 bytes are looked up all at once by those bytes and their
    number, longer ones in a dictionary.  The tables start afresh at ``most`` stretches.

    ``joinable`` gives the ids (bytes of unsigned 32-bit numbers) of strings that begin with a
    space or line end; ``whole`` those of any strings.
    """

    def __init__(self, joinable, whole, most: int = 2_000_000):
        self.joinable, self.whole, self.most = joinable, whole, most
        self.bits = int(2 * most - 1).bit_length()
        self.clear()

    def clear(self) -> None:
        self.low, self.high = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64)
        self.at, self.n = np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.uint16)
        self.held, self.used, self.arena = 0, 0, np.zeros(1 << 16, np.uint32)
        self.long: dict[bytes, tuple[int, int]] = {}

    def store(self, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Puts ids into the arena; where each lies, and how many there are."""
        flat = np.frombuffer(b"".join(ids), np.uint32)
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        if self.used + len(flat) > len(self.arena):
            self.arena = np.concatenate([self.arena[: self.used], np.zeros(max(len(flat), len(self.arena)), np.uint32)])
        self.arena[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(n) - n
        self.used += len(flat)
        self.held += len(ids)
        return at, n

    def slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        x = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return (x >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Slots of stretches, -1 for unknown ones; an empty slot has ``low`` 0, which no stretch has."""
        slot = self.slot(low, high)
        out = np.where((self.low[slot] == low) & (self.high[slot] == high), slot, -1)
        left = np.flatnonzero((out < 0) & (self.low[slot] != 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            hit = (self.low[slot] == low[left]) & (self.high[slot] == high[left])
            out[left[hit]] = slot[hit]
            go = ~hit & (self.low[slot] != 0)
            left, slot = left[go], slot[go]
        return out

    def insert(self, low: np.ndarray, high: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        """Adds distinct unknown stretches."""
        left, slot = np.arange(len(low)), self.slot(low, high)
        while len(left):
            free = self.low[slot] == 0
            taken, first = np.unique(slot[free], return_index=True)
            put = left[free][first]
            self.low[taken], self.high[taken], self.at[taken], self.n[taken] = low[put], high[put], at[put], n[put]
            go = ~((self.low[slot] == low[left]) & (self.high[slot] == high[left]))
            left, slot = left[go], (slot[go] + 1) & ((1 << self.bits) - 1)

    @staticmethod
    def is_wide_blank(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Whether three bytes, or the first two, are a white space character beyond ASCII."""
        general = (x == 0xE2) & (((y == 0x80) & (z >= 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))) | ((y == 0x81) & (z == 0x9F)))
        return ((x == 0xC2) & ((y == 0x85) | (y == 0xA0))) | general | ((x == 0xE1) & (y == 0x9A) & (z == 0x80)) | ((x == 0xE3) & (y == 0x80) & (z == 0x80))

    def beside_blank(self, raw: np.ndarray, cut: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether a text ends after a place, or white space stands before or after it."""
        after = cut + 1
        x = raw[after]
        bad = (after == end) | ASCII_BLANK[x]
        many = np.flatnonzero(x >= 0xC2)
        bad[many] |= self.is_wide_blank(x[many], raw[after[many] + 1], raw[after[many] + 2])
        x = raw[cut - 1]  # of the first text's first byte, the zeros at the end
        x[cut == begin] = 0
        bad |= ASCII_BLANK[x]
        many = np.flatnonzero(x >= 0x80)
        one, two, three = x[many], raw[cut[many] - 2], raw[cut[many] - 3]
        bad[many] |= self.is_wide_blank(two, one, np.zeros_like(one)) & (two == 0xC2) | self.is_wide_blank(three, two, one) & (three >= 0xE1)
        return bad

    def looked_up(self, raw: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of stretches of ``raw`` lie in the arena, and how many there are."""
        at, size = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        short = np.flatnonzero(n <= 15)
        words = np.ndarray(len(raw) - 7, "<u8", raw.tobytes(), strides=(1,))
        low = words[starts[short]] & BYTE_MASKS[n[short]]
        high = words[np.minimum(starts[short] + 8, len(words) - 1)] & BYTE_MASKS[np.maximum(n[short] - 8, 0)] | n[short].astype(np.uint64) << np.uint64(56)
        slot = self.find(low, high)
        new = np.flatnonzero(slot < 0)
        content = memoryview(raw)
        if len(new):
            order = new[np.lexsort((low[new], high[new]))]
            first = np.ones(len(order), bool)
            first[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
            new = order[first]
            where = short[new]
            strings = [str(content[a : a + b], "utf-8", "surrogatepass") for a, b in zip(starts[where].tolist(), n[where].tolist())]
            self.insert(low[new], high[new], *self.store(self.joinable(strings)))
            slot = np.where(slot < 0, self.find(low, high), slot)
        at[short], size[short] = self.at[slot], self.n[slot]
        others = np.flatnonzero(n > 15)
        if len(others):
            found = [bytes(content[a : a + b]) for a, b in zip(starts[others].tolist(), n[others].tolist())]
            unknown = list({x for x in found if x not in self.long})
            if unknown:
                places = self.store(self.joinable([str(x, "utf-8", "surrogatepass") for x in unknown]))
                self.long.update(zip(unknown, zip(*(p.tolist() for p in places))))
            at[others], size[others] = np.array([self.long[x] for x in found], np.int64).T
        return at, size

    def ids(self, texts) -> list[np.ndarray]:
        """The ids of each text of an Arrow array; null is empty."""
        if self.held > self.most:
            self.clear()
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        if not len(texts):
            return []
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
        edges = edges - edges[0]
        raw = np.concatenate([raw, np.zeros(16, np.uint8)])  # so that whole words may be read at the end
        cut = np.flatnonzero((raw == 32) | (raw == 10))
        owner = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(cut, edges)))
        bad = self.beside_blank(raw, cut, edges[owner], edges[owner + 1])
        odd = np.zeros(len(texts), bool)
        odd[owner[bad]] = True
        if odd.any():
            good = ~odd[owner]
            cut, owner = cut[good], owner[good]
        stop = np.append(cut[1:], edges[-1])
        stop = np.minimum(stop, edges[owner + 1])
        at, size = self.looked_up(raw, cut, stop - cut)
        ends = np.cumsum(size)
        place = np.repeat(at - (ends - size), size)
        place += np.arange(len(place))
        flat = self.arena[place]
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        cuts = np.concatenate([[0], ends])[bounds]
        head = edges[1:].copy()  # of a text that isn't cut, all
        some = np.flatnonzero(bounds[1:] > bounds[:-1])
        head[some] = cut[bounds[:-1][some]]
        heads = self.whole([str(memoryview(raw)[a:b], "utf-8", "surrogatepass") for a, b in zip(edges[:-1].tolist(), head.tolist())])
        return [np.concatenate([np.frombuffer(h, np.uint32), flat[a:b]]) if b > a else np.frombuffer(h, np.uint32) for h, a, b in zip(heads, cuts[:-1].tolist(), cuts[1:].tolist())]
