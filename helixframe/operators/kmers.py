"""K-mers and digrams: extraction, counts, positions, tops.

Sequences are rows (seq_id, dna) of clean DNA.  Long sequences are first cut
into pieces with k - 1 bases of right context; a k-mer belongs to the piece it
starts in, so nothing is lost or counted twice whatever the piece size.  Counts
are hash aggregates, partial in the tasks before the shuffle; no window is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import canonical

PIECE = 65_536


def pieces(seqs: DataFrame, right: int, left: int = 0, size: int = PIECE) -> DataFrame:
    """seq_id, start, owned, lead, dna: pieces of ``size`` owned bases with up to ``left`` before and ``right`` after.

    dna is BINARY here: a slice of bytes costs its own length, while a substring
    of a STRING is found by walking from its start.
    """
    raw = seqs.where(F.length("dna") > 0).select("seq_id", F.col("dna").cast("binary").alias("raw"))
    n = F.octet_length("raw")
    cut = raw.select("seq_id", "raw", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).alias("i"))
    start = F.col("i") * size
    begin = F.greatest(start - left, F.lit(0))
    return cut.select("seq_id", start.cast("long").alias("start"), F.least(F.lit(size), n - start).alias("owned"), (start - begin).alias("lead"), F.substring(F.col("raw"), begin + 1, start - begin + size + right).alias("dna"))


def kmer_at(i, k: int) -> Column:
    """The k-mer at a 1-based place of a piece, as bytes."""
    return F.substring(F.col("dna"), i, F.lit(k))


def extract_kmers(seqs: DataFrame, k: int, canonical_only: bool = False, size: int = PIECE) -> DataFrame:
    """seq_id, pos, kmer."""
    if not 1 <= k <= 255:
        raise ValueError("k must be from 1 to 255")
    part = pieces(seqs, k - 1, size=size)
    last = F.least(F.col("owned"), F.octet_length("dna") - k + 1)
    found = part.where(last > 0).select("seq_id", "start", F.posexplode(F.transform(F.sequence(F.lit(1), last), lambda i: kmer_at(i, k))).alias("i", "bytes"))
    kmer = F.col("bytes").cast("string")
    return found.select("seq_id", (F.col("start") + F.col("i")).alias("pos"), (canonical(kmer) if canonical_only else kmer).alias("kmer"))


def count_kmers(seqs: DataFrame, k: int, canonical_only: bool = False, by: tuple = ()) -> DataFrame:
    """by, kmer, n; strands are folded after the count, so each distinct k-mer is turned once."""
    counted = extract_kmers(seqs, k).groupBy(*by, "kmer").agg(F.count("*").alias("n"))
    return counted.groupBy(*by, canonical("kmer").alias("kmer")).agg(F.sum("n").alias("n")) if canonical_only else counted


def most_common(counts: DataFrame, key: str, by: str | None = None, least: int = 1) -> DataFrame:
    """The row of greatest n, ties to the least key; for each ``by`` if given."""
    order = F.struct(-F.col("n"), F.col(key))
    enough = counts.where(F.col("n") >= least)
    best = F.min(order).alias("best")
    found = enough.groupBy(by).agg(best) if by else enough.agg(best).where(F.col("best").isNotNull())
    return found.select(*([by] if by else []), F.col(f"best.{key}").alias(key), (-F.col("best.col1")).alias("n"))


def top(counts: DataFrame, key: str, n: int) -> DataFrame:
    return counts.orderBy(F.col("n").desc(), F.col(key)).limit(n)


def digrams(seqs: DataFrame) -> DataFrame:
    """seq_id, pos, kmer (two bases), digram_id 0 to 15."""
    code = lambda i: F.instr(F.lit("ACGT"), F.substring("kmer", i, 1)) - 1
    return extract_kmers(seqs, 2).withColumn("digram_id", (code(1) * 4 + code(2)).cast("int"))


def digram_positions(seqs: DataFrame, kmer: str, either_strand: bool = False) -> DataFrame:
    key = canonical("kmer") if either_strand else F.col("kmer")
    want = canonical(F.lit(kmer)) if either_strand else F.lit(kmer)
    return extract_kmers(seqs, len(kmer)).where(key == want).select("seq_id", "pos")


def kmer_positions(seqs: DataFrame, k: int, canonical_only: bool = False) -> DataFrame:
    """seq_id, kmer, n, positions: for each sequence, where each k-mer starts."""
    found = extract_kmers(seqs, k, canonical_only)
    return found.groupBy("seq_id", "kmer").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("pos")).alias("positions"))


def kmer_position_blocks(seqs: DataFrame, k: int, canonical_only: bool = False, size: int = PIECE) -> DataFrame:
    """seq_id, kmer, block, n, first, gaps: where each k-mer starts in each stretch of ``size`` bases, as its first place there and the steps from one to the next.

    A row holds ``size`` places at most, however often a k-mer occurs; blocks in order give all places.
    """
    found = extract_kmers(seqs, k, canonical_only).withColumn("block", F.floor(F.col("pos") / size))
    lists = found.groupBy("seq_id", "kmer", "block").agg(F.array_sort(F.collect_list("pos")).alias("at"))
    gaps = F.zip_with(F.slice("at", 2, size), F.slice("at", 1, size), lambda later, place: later - place)
    return lists.select("seq_id", "kmer", "block", F.size("at").cast("long").alias("n"), F.get("at", F.lit(0)).alias("first"), F.filter(gaps, lambda x: x.isNotNull()).alias("gaps"))


def positions_in(first: Column, gaps: Column) -> Column:
    """The places of a block."""
    return F.aggregate(gaps, F.array(first), lambda done, gap: F.concat(done, F.array(F.element_at(done, -1) + gap)))


def merge_counts(*tables: DataFrame, key: str = "kmer") -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy(key).agg(F.sum("n").alias("n"))


def without_occurrences(found: DataFrame, gone: DataFrame) -> DataFrame:
    """Occurrences (seq_id, pos, kmer) without those of another table."""
    return found.join(gone, ["seq_id", "pos"], "left_anti")


def find_pattern(seqs: DataFrame, pattern: str) -> DataFrame:
    """seq_id, pos of every exact occurrence, overlapping ones too."""
    return digram_positions(seqs, pattern)


def symbol_kmers(symbols: DataFrame, k: int) -> DataFrame:
    """seq_id, pos, kmer (array) of symbol rows (seq_id, symbols array): windows of k."""
    n = F.size("symbols")
    window = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.slice("symbols", i, k))
    return symbols.where(n >= k).select("seq_id", F.posexplode(window).alias("pos", "kmer"))


def canonical_symbols(kmer: Column) -> Column:
    """The lesser of a k-mer of terminals and its reverse complement; others as they are."""
    back = F.reverse(F.transform(kmer, lambda s: F.when(s.between(0, 3), 3 - s).otherwise(-1 - s)))
    return F.when(F.forall(kmer, lambda s: s.between(0, 3)) | (F.size(F.array_distinct(kmer)) == 1), F.least(kmer, back)).otherwise(kmer)
