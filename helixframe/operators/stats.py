"""Composition, entropy and tuning figures of sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import bounded
from .kmers import count_kmers, extract_kmers, most_common


def base_count(x, base: str):
    return (F.length(x) - F.length(F.replace(F.col(x), F.lit(base)))).cast("long")


def longest_run(x):
    """Length of the longest run of one character."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(F.col(x), F.lit(r"((.)\2*)"), F.lit(1)), F.length)), F.lit(0)).cast("long")


def sequence_stats(seqs: DataFrame, dna: str = "dna", k: int | None = None) -> DataFrame:
    """seq_id, length, counts of bases, ambiguous, gc (per cent of A, C, G and T), longest homopolymer; with k, the most common canonical k-mer."""
    acgt = F.col("a") + F.col("c") + F.col("g") + F.col("t")
    out = seqs.select("seq_id", F.length(dna).cast("long").alias("length"), *(base_count(dna, b).alias(b.lower()) for b in "ACGT"), longest_run(dna).alias("longest_run"))
    out = out.withColumn("ambiguous", F.col("length") - acgt).withColumn("gc", F.when(acgt > 0, F.round(100 * (F.col("g") + F.col("c")) / acgt, 6)).otherwise(0.0))
    if k is None:
        return out
    clean = extract_kmers(seqs.select("seq_id", F.upper(dna).alias("dna")), k).where(~F.col("kmer").rlike("[^ACGT]"))
    from ..functions.dna import canonical

    best = most_common(clean.groupBy("seq_id", canonical("kmer").alias("kmer")).agg(F.count("*").alias("n")), "kmer", "seq_id")
    return out.join(best.select("seq_id", F.col("kmer").alias("top_kmer"), F.col("n").alias("top_n")), "seq_id", "left")


def entropy_of(counts: DataFrame) -> DataFrame:
    """seq_id, total, entropy (bits, not rounded) and repetitiveness (share of digrams counted over 1.5 times the mean of 16)."""
    total = counts.groupBy("seq_id").agg(F.sum("n").alias("total"), F.collect_list("n").alias("ns"))
    p = lambda x: x / F.col("total")
    entropy = F.aggregate("ns", F.lit(0.0), lambda acc, x: acc - p(x) * F.log2(p(x)))
    often = F.aggregate(F.filter("ns", lambda x: x > F.col("total") / 16 * 1.5), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return total.select("seq_id", "total", entropy.alias("entropy"), F.round(often / F.col("total"), 6).alias("repetitiveness"))


def digram_entropy(seqs: DataFrame, sample: int | None = None) -> DataFrame:
    """Of the first ``sample`` bases, or all."""
    part = seqs if sample is None else seqs.select("seq_id", F.substring("dna", 1, sample).alias("dna"))
    return entropy_of(count_kmers(part, 2, by=("seq_id",))).withColumn("entropy", F.round("entropy", 6))


def trimer_entropy(seqs: DataFrame, samples: int = 1000) -> DataFrame:
    """The columns seq_id and dna, and entropy: half the 3-mer entropy of up to ``samples`` evenly spaced bases; 0.5 below 3 of them."""

    def entropy(dna) -> float:
        raw = np.frombuffer((dna or "").encode(), np.uint8)
        taken = raw[:: max(len(raw) // max(min(samples, len(raw)), 1), 1)][:samples].astype(np.int64)
        if len(taken) < 3:
            return 0.5
        n = np.unique((taken[:-2] << 16) | (taken[1:-1] << 8) | taken[2:], return_counts=True)[1]
        p = n / n.sum()
        return float(np.round(-(p * np.log2(p)).sum() / 2, 6)) + 0.0

    def run(batches):
        for batch in bounded(batches):
            found = pa.array([entropy(x) for x in batch.column("dna").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("seq_id"), batch.column("dna"), found], ["seq_id", "dna", "entropy"])

    return seqs.select("seq_id", "dna").mapInArrow(run, "seq_id long, dna string, entropy double")


def auto_tune(seqs: DataFrame, sample: int = 10_000) -> DataFrame:
    """seq_id and the parameters for locally consistent parsing that the sequence's digrams suggest."""
    n = seqs.select("seq_id", F.length("dna").alias("n_bases"))
    x = n.join(digram_entropy(seqs, sample), "seq_id", "left")
    r, h, big = F.coalesce("repetitiveness", F.lit(0.0)), F.coalesce("entropy", F.lit(0.0)), F.col("n_bases")
    tuned = F.least(F.lit(sample), big) >= 100

    def pick(column, default):
        return F.when(tuned, column).otherwise(default).cast("int")

    return x.select(
        "seq_id",
        pick(F.when(r > 0.3, 4).when(h > 1.8, 16).otherwise(8), 8).alias("window"),
        pick(F.when(r > 0.4, 2).when(h > 1.9, 3).otherwise(2), 2).alias("min_phrase"),
        pick(F.when(big > 10_000_000, 512).when(big > 1_000_000, 256).otherwise(128), 256).alias("max_phrase"),
        pick(F.when(r > 0.3, 2).when(h > 1.8, 3).otherwise(2), 2).alias("min_occurrences"),
    )
