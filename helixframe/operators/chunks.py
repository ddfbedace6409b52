"""Fixed and adaptive chunks of sequences, and joining them again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_chunks(seqs: DataFrame, size: int | Column, overlap: int = 0) -> DataFrame:
    """seq_id, idx, start, end, is_first, is_last, dna: chunks of ``size``, a number or a column, that share ``overlap`` bases.

    A last chunk that would lie inside the one before is left out.  Chunks are cut from bytes: a
    substring of a STRING is found by walking from its start.
    """
    if isinstance(size, int) and (size <= 0 or not 0 <= overlap < size):
        raise ValueError("overlap must be less than the chunk size")
    whole = seqs.select("seq_id", F.col("dna").cast("binary").alias("raw"), F.octet_length("dna").alias("n"), (F.lit(size) if isinstance(size, int) else size).cast("int").alias("size"))
    step, n = F.col("size") - overlap, F.col("n")
    count = F.when(n <= F.col("size"), 1).otherwise(F.ceil((n - overlap) / step)).cast("int")
    cut = whole.withColumn("chunks", count).select("seq_id", "raw", "n", "size", "chunks", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("idx"))
    start = F.col("idx") * step
    last = F.col("idx") == F.col("chunks") - 1
    end = F.when(last, n).otherwise(F.least(start + F.col("size"), n))
    return cut.select("seq_id", "idx", start.cast("long").alias("start"), end.cast("long").alias("end"), (F.col("idx") == 0).alias("is_first"), last.alias("is_last"), F.substring(F.col("raw"), start + 1, end - start).cast("string").alias("dna"))


def join_chunks(chunks: DataFrame, overlap: int) -> DataFrame:
    """seq_id, dna: chunks put together; of shared bases the later chunk's are kept."""
    part = F.struct("idx", F.when(F.col("is_last"), F.col("dna")).otherwise(F.substring(F.col("dna"), F.lit(1), F.length("dna") - overlap)).alias("dna"))
    return chunks.groupBy("seq_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["dna"]), "").alias("dna"))


def join_two(left: Column, right: Column, overlap: int) -> Column:
    return F.concat(F.substring(left, F.lit(1), F.length(left) - overlap), right)


def best_overlap(left: Column, right: Column, most: int) -> Column:
    """The longest suffix of left, up to ``most``, that right begins with."""
    lengths = F.sequence(F.lit(0), F.least(F.lit(most), F.length(left), F.length(right)))
    return F.array_max(F.filter(lengths, lambda i: F.right(left, i) == F.left(right, i)))


def adaptive_size(entropy: Column, memory: int, workers: int, most: int | None = None) -> Column:
    """Bases for each chunk: a worker's memory, less for higher entropy, from 50,000 to 100,000,000."""
    share = memory // workers if most is None else min(memory // workers, most)
    factor = 0.5 + (1 - entropy) * 0.5
    return F.least(F.greatest(F.floor(share * factor), F.lit(50_000)), F.lit(100_000_000)).cast("long")


def map_chunks(chunks: DataFrame, function, schema: str) -> DataFrame:
    """Applies a function of one chunk row (a dict) that returns a dict, in Arrow batches."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            yield pd.DataFrame([function(row) for row in frame.to_dict("records")], columns=[c.strip().split()[0] for c in schema.split(",")])

    return chunks.mapInPandas(run, schema)
