"""Rolling hashes, repeats of fixed length, minimizers and bottom-n sketches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import bounded
from ..functions.dna import FX_SEED, _codes
from .kmers import PIECE, count_kmers, pieces


def rolling_hash_counts(seqs: DataFrame, k: int, least: int = 2, size: int = PIECE) -> DataFrame:
    """h, n: windows by hash, summed over all sequences; pieces are hashed whole, and each batch of them sends a hash once."""

    def run(batches):
        for batch in bounded(batches):
            found = [window_hashes(np.frombuffer(raw, np.uint8).astype(np.int64), k)[:own] for raw, own in zip(batch.column("dna").to_pylist(), batch.column("owned").to_pylist())]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in np.unique(np.concatenate(found), return_counts=True)], ["h", "n"])

    return pieces(seqs, k - 1, size=size).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def repeats(seqs: DataFrame, k: int, least: int = 2) -> DataFrame:
    """kmer, n: substrings of length k that occur ``least`` times or more, overlapping ones too."""
    return count_kmers(seqs, k).where(F.col("n") >= least)


def window_hashes(raw: np.ndarray, k: int, base: int = 101, modulus: int = 1_000_000_007) -> np.ndarray:
    """The polynomial hash of every window of k bytes, as ``dna.polynomial_hash`` gives it; windows are put together from halves."""
    n = max(len(raw) - k + 1, 0)
    h, done, part, width = np.zeros(n, np.int64), 0, raw % modulus, 1
    while n:
        if k & width:  # the window's next bytes
            h = (h * pow(base, width, modulus) + part[done : done + n]) % modulus
            done += width
        if done == k:
            break
        part = (part[:-width] * pow(base, width, modulus) + part[width:]) % modulus
        width *= 2
    return h


def least_windows(h: np.ndarray, w: int) -> np.ndarray:
    """For each w consecutive hashes, the place of the least, the rightmost on ties."""
    x = (h << 32) - np.arange(len(h))  # a later place makes an equal hash less
    least = x[: len(x) - w + 1].copy()
    for j in range(1, w):
        np.minimum(least, x[j : j + len(least)], out=least)
    return -least & 0xFFFFFFFF


def piece_minimizers(raw: bytes, lead: int, owned: int, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in a piece, and hashes, of the minimizers of the windows that it owns."""
    h = window_hashes(np.frombuffer(raw, np.uint8).astype(np.int64), k)
    if len(h) < w:
        return np.zeros(0, np.int64), h[:0]
    at = least_windows(h, w)[: lead + owned]
    fresh = np.ones(len(at), bool)
    fresh[1:] = at[1:] != at[:-1]
    fresh[:lead] = False
    return at[fresh], h[at[fresh]]


def minimizers(seqs: DataFrame, k: int, w: int, size: int = PIECE) -> DataFrame:
    """seq_id, pos, h: the least hash of each w consecutive k-mers, the rightmost on ties, each once.

    A piece has one window more to its left, by which it knows whether its
    first minimizer is new, so pieces need no exchange.
    """

    def run(batches):
        for batch in batches:
            ids, starts, owned, lead = (batch.column(c).to_numpy() for c in ("seq_id", "start", "owned", "lead"))
            found = [piece_minimizers(raw, int(a), int(n), k, w) for raw, a, n in zip(batch.column("dna").to_pylist(), lead, owned)]
            n = [len(h) for _, h in found]
            if sum(n):
                pos = np.concatenate([at for at, _ in found]) + np.repeat(starts - lead, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(pos), pa.array(np.concatenate([h for _, h in found]))], ["seq_id", "pos", "h"])

    return pieces(seqs, w + k - 2, left=1, size=size).mapInArrow(run, "seq_id long, pos long, h long")


def minimizer_counts(seqs: DataFrame, k: int, w: int, size: int = PIECE) -> DataFrame:
    """h, n; each batch of pieces sends a hash once."""

    def run(batches):
        for batch in batches:
            found = [piece_minimizers(raw, int(a), int(n), k, w)[1] for raw, a, n in zip(batch.column("dna").to_pylist(), batch.column("lead").to_pylist(), batch.column("owned").to_pylist())]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in np.unique(np.concatenate(found), return_counts=True)], ["h", "n"])

    return pieces(seqs, w + k - 2, left=1, size=size).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def bottom_sketch(seqs: DataFrame, k: int, n: int) -> DataFrame:
    """seq_id, sketch: the n least distinct k-mer hashes, in order; pieces send n at most."""

    def run(batches):
        for batch in batches:
            found = [np.unique(window_hashes(np.frombuffer(raw, np.uint8).astype(np.int64), k)[:own])[:n].tolist() for raw, own in zip(batch.column("dna").to_pylist(), batch.column("owned").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("seq_id"), pa.array(found, pa.list_(pa.int64()))], ["seq_id", "x"])

    least = pieces(seqs, k - 1).mapInArrow(run, "seq_id long, x array<long>").where(F.size("x") > 0)
    return least.groupBy("seq_id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("x")))), 1, n).alias("sketch"))


def sketch_similarity(left: DataFrame, right: DataFrame, n: int) -> DataFrame:
    """a, b, similarity of pairs of sketches (a, sa) and (b, sb) given by a shared key column ``pair``."""
    both = left.join(right, "pair")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, n)
    shared = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    return both.select("pair", "a", "b", F.round(shared / F.size(union), 6).alias("similarity"))


def window_fingerprints(seqs: DataFrame, w: int, size: int = PIECE) -> DataFrame:
    """seq_id, pos, fingerprint of every window of w bases, as ``dna.fingerprint_bases`` gives it; pieces are hashed whole."""

    def run(batches):
        for batch in bounded(batches):
            ids, starts, owned = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("seq_id", "start", "owned"))
            found = [window_prints(_codes(raw.decode()), w)[:own] for raw, own in zip(batch.column("dna").to_pylist(), owned.tolist())]
            n = np.array([len(x) for x in found], np.int64)
            if n.sum():
                pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - starts, n)
                owner = pa.array(np.repeat(np.arange(len(ids)), n))
                yield pa.RecordBatch.from_arrays([batch.column("seq_id").take(owner), pa.array(pos, pa.int64()), pa.array(np.concatenate(found).view(np.int64))], ["seq_id", "pos", "fingerprint"])

    return pieces(seqs, w - 1, size=size).mapInArrow(run, "seq_id long, pos long, fingerprint long")


def window_prints(codes: np.ndarray, w: int) -> np.ndarray:
    """The word hash of every window of w codes, unsigned."""
    x, h = codes.astype(np.uint64), np.zeros(max(len(codes) - w + 1, 0), np.uint64)
    for j in range(w):
        h = (((h << np.uint64(5)) | (h >> np.uint64(59))) ^ x[j : j + len(h)]) * np.uint64(FX_SEED)
    return h
