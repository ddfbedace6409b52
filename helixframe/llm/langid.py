"""Language identification by hyperdimensional profiles.

Each letter class has a random vector of +1 and -1.  A trigram's vector binds
(multiplies) its letters' vectors, each permuted (rolled) by its place; a text's
vector bundles (adds) those of the trigrams of its words, with a mark at both
ends of a word.  A language's prototype bundles its training texts, each divided by
its number of trigrams so that no long text rules.  Texts get the language of
the prototype of greatest cosine.

Letters are lower-cased, words are runs of letters, and every letter of every
script has a vector of its own, drawn by its code point.

Null texts, and texts without a letter, are ``und`` with score 0; so is every text
if nothing was learned.  Ties go to the language first in order.  Equal texts
get equal results whatever their number, long texts are taken whole, and an empty table
gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

DIM, SEED = 1024, 5
MARK = 0  # the code point that stands at both ends of a word
UNKNOWN = "und"
SCALE = 1_000_000  # of the whole numbers that Spark adds up, so that sums don't depend on their order
MOST_HELD = 64  # languages whose sums a task holds before it sends them on
MOST_DENSE = 1 << 22  # trigram numbers that are counted in a table instead of by sorting


@functools.lru_cache(maxsize=65_536)
def letter_vector(point: int) -> np.ndarray:
    return np.random.default_rng([SEED, point]).choice(np.array([-1, 1], np.int8), DIM)


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams_of(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The text that each trigram belongs to, its number, and the distinct trigrams as rows of three code points, which the numbers refer to."""
    held = [(t or "").lower() for t in texts]
    points = np.frombuffer("\n".join(["", *held, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.where(letters()[points], points, MARK)
    at = np.flatnonzero(points)
    owner = np.repeat(np.arange(len(held)), np.diff(np.searchsorted(at, np.cumsum([1, *(len(t) + 1 for t in held)]))))
    used = np.zeros(0x110000, bool)
    used[points] = used[MARK] = True
    alphabet = np.flatnonzero(used)
    place = np.zeros(0x110000, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    small, k = place[points], len(alphabet)
    codes = (small[at - 1] * k + small[at]) * k + small[at + 1]
    if k**3 <= MOST_DENSE:
        there = np.zeros(k**3, bool)
        there[codes] = True
        found = np.flatnonzero(there)
        number = (np.cumsum(there) - 1)[codes]
    else:
        found, number = np.unique(codes, return_inverse=True)
    return owner, number, alphabet[np.stack([found // (k * k), found // k % k, found % k], 1)]


def trigram_vectors(found: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 for each trigram."""
    alphabet, rows = np.unique(found, return_inverse=True)
    v = np.stack([letter_vector(p) for p in alphabet.tolist()]) if len(alphabet) else np.zeros((0, DIM), np.int8)
    a, b, c = rows.reshape(-1, 3).T
    return np.roll(v, 2, 1)[a] * np.roll(v, 1, 1)[b] * v[c]


def bundles(texts: list, block: int = 8192) -> np.ndarray:
    """The texts' vectors: their counts of the trigrams that occur, times those trigrams' vectors."""
    owner, number, found = trigrams_of(texts)
    out = np.zeros((len(texts), DIM), np.float32)
    for a in range(0, len(found), block):
        part = found[a : a + block]
        inside = (number >= a) & (number < a + block) if len(found) > block else slice(None)
        counts = np.bincount(owner[inside] * len(part) + number[inside] - a, minlength=len(texts) * len(part))
        out += counts.reshape(len(texts), len(part)).astype(np.float32) @ trigram_vectors(part).astype(np.float32)
    return out


def prototypes(training: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, their vectors of length 1) from rows (text, lang).

    Tasks bundle what they read for each language and Spark adds the bundles up;
    the driver receives ``DIM`` numbers for each language.
    """

    small_batches(training.sparkSession)

    def flushed(sums: dict[str, np.ndarray]):
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM), pa.array(np.arange(DIM)), pa.array(np.rint(total * SCALE).astype(np.int64))], ["lang", "dim", "x"])
        sums.clear()

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for a, b in slices(texts, 1_000_000):
                owner, number, found = trigrams_of(texts[a:b])
                share = 1 / np.maximum(np.bincount(owner, minlength=b - a), 1)
                names = {lang: k for k, lang in enumerate(dict.fromkeys(langs[a:b]))}
                of = np.array([names[lang] for lang in langs[a:b]])
                counts = np.bincount(of[owner] * len(found) + number, share[owner], len(names) * len(found)).reshape(len(names), len(found))
                totals = sum((counts[:, k : k + 8192] @ trigram_vectors(found[k : k + 8192]).astype(np.float64) for k in range(0, len(found), 8192)), np.zeros((len(names), DIM)))
                if len(sums) + len(names) > MOST_HELD:
                    yield from flushed(sums)
                for lang, k in names.items():
                    sums[lang] = sums.get(lang, 0) + totals[k]
        yield from flushed(sums)

    parts = training.select("text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull()).mapInArrow(bundle, "lang string, dim long, x long")
    found = parts.groupBy("lang", "dim").agg(F.sum("x").alias("x")).toPandas()
    table = found.pivot(index="lang", columns="dim", values="x").sort_index()
    vectors = table.to_numpy(np.float64)
    return list(table.index), vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9) if len(vectors) else np.zeros((0, DIM))


def in_test_fold(doc_id) -> F.Column:
    """One document of five, by the crc32 of its doc_id as text; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def predict(docs: DataFrame, languages: list[str], vectors: np.ndarray) -> DataFrame:
    """All columns of ``docs`` as ``row``, with lang_pred and score (the cosine, at least 0)."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((languages, vectors.astype(np.float32)))
    kept = docs.select(F.struct("*").alias("row"))
    schema = kept.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema

    def run(batches):
        names, table = held.value
        for batch in batches:
            row = batch.column("row")
            texts = row.field("text").to_pylist()
            for a, b in slices(texts, 1_000_000):
                sums = bundles(texts[a:b])
                length = np.linalg.norm(sums, axis=1, keepdims=True)
                cosines = (sums / np.maximum(length, 1e-9)) @ table.T if names else np.zeros((b - a, 1))
                real = (length[:, 0] > 0) & bool(names)
                best = cosines.argmax(1)
                top = np.clip(cosines.max(1), 0, 1)
                yield pa.RecordBatch.from_arrays([row.slice(a, b - a), pa.array([names[k] if ok else UNKNOWN for k, ok in zip(best, real)]), pa.array(np.where(real, top, 0.0).astype(np.float64))], ["row", "lang_pred", "score"])

    return kept.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents outside the test fold."""
    narrow = docs.select("doc_id", "text", "lang")
    languages, vectors = prototypes(narrow.where(~in_test_fold(F.col("doc_id"))))
    out = predict(narrow.select("doc_id", "text"), languages, vectors)
    return out.select("row.doc_id", in_test_fold(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")
