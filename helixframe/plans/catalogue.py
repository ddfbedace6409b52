"""Queries of the sequence engine over whole tables, and their SQL.

Sequences are the A, C, G and T of each document's text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna as D
from ..operators import access, chunks, grammar, kmers, lcg, parsing, repair, rounds, sketch, stats, suffixes
from ..shared import keep, new_path
from ..sources import export, fasta
from ..streaming import counts as streaming
from . import grammar_sql as G

K, W, SKETCH, ROUNDS = 8, 4, 16, 4
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "compression_stats"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return add


def spelled(df: DataFrame, column: str = "symbols") -> DataFrame:
    """The table with an array of numbers written as text."""
    return df.withColumn(column, F.array_join(F.col(column).cast("array<string>"), " "))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fasta.from_table(table(spark, sf_dir, "documents"))


def grammars(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """Written once: several operators read it."""
    return keep(repair.build(sequences(spark, sf_dir), **options))


S = "s AS (SELECT doc_id AS seq_id, upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g')) AS dna FROM documents)"


def kmer_sql(k: int, source: str = "s") -> str:
    return f"k{k} AS (SELECT seq_id, i - 1 AS pos, substr(dna, i, {k}) AS kmer FROM (SELECT seq_id, dna, unnest(range(1, length(dna) - {k} + 2)) AS i FROM {source}))"


def rc_sql(x: str) -> str:
    return f"translate(reverse({x}), 'ACGT', 'TGCA')"


def hash_sql(x: str, k: int) -> str:
    return "((" + " + ".join(f"ascii(substr({x}, {j + 1}, 1))::BIGINT * {pow(101, k - 1 - j, 1_000_000_007)}" for j in range(k)) + ") % 1000000007)"


# Normalization, encoding and strands.


@query(f"WITH {S} SELECT seq_id, dna FROM s")
def dna_normalize(spark, sf_dir):
    return sequences(spark, sf_dir)


@query("SELECT doc_id AS seq_id, NOT regexp_matches(text, '[^ACGTacgt]') AS strict FROM documents")
def dna_strict_flag(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), D.is_strict("text").alias("strict"))


@query("SELECT doc_id AS seq_id, regexp_replace(text, '[^ACGTacgt]', 'A', 'g') AS dna FROM documents")
def dna_replace_a(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), D.normalize("text", "replace_a").alias("dna"))


@query("SELECT doc_id AS seq_id, regexp_replace(text, '[Nn]', '', 'g') AS text FROM documents")
def drop_n(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), D.drop_n("text").alias("text"))


@query("SELECT page_id AS seq_id, length(regexp_replace(html, '[^ACGTacgt]', '', 'g'))::BIGINT AS n_bases FROM pages")
def pages_valid_bases(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq_id"), D.count_valid("html").cast("long").alias("n_bases"))


@query(f"WITH {S} SELECT seq_id, translate(dna, 'ACGT', '0123') AS codes, substr(translate(dna, 'ACGT', '0123'), 1, 64) AS first_codes FROM s")
def encode_codes(spark, sf_dir):
    return sequences(spark, sf_dir).select("seq_id", D.encode_codes("dna").alias("codes"), D.encode_codes("dna", 64).alias("first_codes"))


@query(f"WITH {S} SELECT seq_id, dna FROM s")
def decode_codes(spark, sf_dir):
    return sequences(spark, sf_dir).select("seq_id", D.decode_codes(D.encode_codes("dna")).alias("dna"))


@query(f"WITH {S} SELECT seq_id, dna, substr(dna, 4, 10) AS part, ceil(length(dna) / 4)::BIGINT AS n_bytes FROM s")
def pack_2bit_roundtrip(spark, sf_dir):
    packed = sequences(spark, sf_dir).withColumn("p", D.pack_2bit("dna"))
    whole = D.unpack_2bit("p.packed", F.lit(0), "p.n")
    part = D.unpack_2bit("p.packed", F.least(F.lit(3), F.col("p.n")), F.greatest(F.least(F.lit(10), F.col("p.n") - 3), F.lit(0)))
    return packed.select("seq_id", whole.alias("dna"), part.alias("part"), F.length("p.packed").cast("long").alias("n_bytes"))


@query(f"WITH {S} SELECT seq_id, {rc_sql('dna')} AS rc, least(dna, {rc_sql('dna')}) AS canonical, dna = {rc_sql('dna')} AS palindrome FROM s")
def reverse_complement(spark, sf_dir):
    return sequences(spark, sf_dir).select("seq_id", D.reverse_complement("dna").alias("rc"), D.canonical("dna").alias("canonical"), D.is_palindrome("dna").alias("palindrome"))


@query(f"WITH {S}, {kmer_sql(6)} SELECT kmer, count(*) AS n FROM k6 WHERE kmer = {rc_sql('kmer')} GROUP BY kmer")
def palindromic_kmers(spark, sf_dir):
    return kmers.count_kmers(sequences(spark, sf_dir), 6).where(D.is_palindrome("kmer"))


@query(f"WITH {S} SELECT seq_id, substr(dna, 11, 20) AS dna FROM s")
def read_range(spark, sf_dir):
    return fasta.read_range(sequences(spark, sf_dir), 10, 20)


@query(G.FINGERPRINTS_SQL)
def base_fingerprints(spark, sf_dir):
    return sequences(spark, sf_dir).select("seq_id", D.fingerprint_bases("dna").alias("fingerprint"))


@query(f"WITH {S} SELECT seq_id, CASE WHEN length(dna) > 0 THEN round(100.0 * (length(dna) - ceil(length(dna) / 4)) / length(dna), 6) ELSE 0.0 END AS saving FROM s")
def memory_saving(spark, sf_dir):
    return sequences(spark, sf_dir).select("seq_id", D.memory_saving(F.length("dna")).alias("saving"))


# K-mers and digrams.


@query(f"WITH {S}, {kmer_sql(K)} SELECT seq_id, pos, kmer FROM k{K}")
def kmer_extract(spark, sf_dir):
    return kmers.extract_kmers(sequences(spark, sf_dir), K)


@query(f"WITH {S}, {kmer_sql(K)} SELECT kmer, count(*) AS n FROM k{K} GROUP BY kmer")
def kmer_counts(spark, sf_dir):
    return kmers.count_kmers(sequences(spark, sf_dir), K)


@query(f"WITH {S}, {kmer_sql(5)} SELECT least(kmer, {rc_sql('kmer')}) AS kmer, count(*) AS n FROM k5 GROUP BY 1")
def canonical_kmer_counts(spark, sf_dir):
    return kmers.count_kmers(sequences(spark, sf_dir), 5, canonical_only=True)


@query(f"WITH {S}, {kmer_sql(K)}, c AS (SELECT seq_id, kmer, count(*) AS n FROM k{K} GROUP BY ALL) SELECT seq_id, kmer, n FROM c QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY n DESC, kmer) = 1")
def most_common_kmer(spark, sf_dir):
    return kmers.most_common(kmers.count_kmers(sequences(spark, sf_dir), K, by=("seq_id",)), "kmer", "seq_id")


@query(f"WITH {S}, {kmer_sql(3)} SELECT seq_id, kmer, count(*) AS n, array_to_string(list_sort(list(pos)), ',') AS positions FROM k3 GROUP BY seq_id, kmer")
def kmer_positions(spark, sf_dir):
    found = kmers.kmer_positions(sequences(spark, sf_dir), 3)
    return found.withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


@query(f"WITH {S}, {kmer_sql(3)}, b AS (SELECT seq_id, kmer, pos, pos // 256 AS block FROM k3), g AS (SELECT *, pos - lag(pos) OVER (PARTITION BY seq_id, kmer, block ORDER BY pos) AS gap FROM b) SELECT seq_id, kmer, block, count(*) AS n, min(pos) AS first, coalesce(string_agg(gap::VARCHAR, ',' ORDER BY pos), '') AS gaps FROM g GROUP BY seq_id, kmer, block")
def kmer_position_blocks(spark, sf_dir):
    found = kmers.kmer_position_blocks(sequences(spark, sf_dir), 3, size=256)
    return found.withColumn("gaps", F.array_join(F.col("gaps").cast("array<string>"), ","))


@query(f"WITH {S}, {kmer_sql(2)} SELECT kmer, count(*) AS n FROM k2 GROUP BY kmer")
def digram_counts(spark, sf_dir):
    return kmers.count_kmers(sequences(spark, sf_dir), 2)


@query(f"WITH {S}, {kmer_sql(2)} SELECT seq_id, pos, kmer, ((instr('ACGT', kmer[1]) - 1) * 4 + instr('ACGT', kmer[2]) - 1)::INTEGER AS digram_id FROM k2")
def digram_ids(spark, sf_dir):
    return kmers.digrams(sequences(spark, sf_dir))


@query(f"WITH {S}, {kmer_sql(2)} SELECT seq_id, pos FROM k2 WHERE kmer IN ('AC', 'GT')")
def digram_positions(spark, sf_dir):
    return kmers.digram_positions(sequences(spark, sf_dir), "AC", either_strand=True)


@query(f"WITH {S}, {kmer_sql(2)} SELECT least(kmer, {rc_sql('kmer')}) AS kmer, count(*) AS n FROM k2 GROUP BY 1")
def canonical_digram_counts(spark, sf_dir):
    return kmers.count_kmers(sequences(spark, sf_dir), 2, canonical_only=True)


@query(f"WITH {S}, {kmer_sql(2)} SELECT kmer, count(*) AS n FROM k2 GROUP BY kmer ORDER BY n DESC, kmer LIMIT 5")
def top_digrams(spark, sf_dir):
    return kmers.top(kmers.count_kmers(sequences(spark, sf_dir), 2), "kmer", 5)


@query(f"WITH {S}, {kmer_sql(2)} SELECT kmer, count(*) AS n FROM k2 GROUP BY kmer HAVING count(*) >= 2 ORDER BY n DESC, kmer LIMIT 1")
def most_frequent_digram(spark, sf_dir):
    return kmers.most_common(kmers.count_kmers(sequences(spark, sf_dir), 2), "kmer", least=2)


@query(f"WITH {S}, {kmer_sql(4)}, p AS (SELECT page_id AS seq_id, upper(regexp_replace(coalesce(html, ''), '[^ACGTacgt]', '', 'g')) AS dna FROM pages), {kmer_sql(4, 'p').replace('k4', 'q4', 1)} SELECT kmer, count(*) AS n FROM (SELECT kmer FROM k4 UNION ALL SELECT kmer FROM q4) GROUP BY kmer")
def merged_kmer_counts(spark, sf_dir):
    pages = fasta.from_table(table(spark, sf_dir, "pages"), "page_id", "html")
    return kmers.merge_counts(kmers.count_kmers(sequences(spark, sf_dir), 4), kmers.count_kmers(pages, 4))


@query(f"WITH {S}, {kmer_sql(5)} SELECT seq_id, pos FROM k5 WHERE kmer = 'GATTA'")
def find_pattern(spark, sf_dir):
    return kmers.find_pattern(sequences(spark, sf_dir), "GATTA")


# Statistics.

BASES_SQL = ", ".join(f"(length(dna) - length(replace(dna, '{b}', '')))::BIGINT AS {b.lower()}" for b in "ACGT")


@query(f"WITH {S} SELECT seq_id, length(dna)::BIGINT AS length, {BASES_SQL}, CASE WHEN length(dna) > 0 THEN round(100 * length(regexp_replace(dna, '[AT]', '', 'g')) / length(dna), 6) ELSE 0.0 END AS gc FROM s")
def base_counts(spark, sf_dir):
    return stats.sequence_stats(sequences(spark, sf_dir)).select("seq_id", "length", "a", "c", "g", "t", "gc")


@query("SELECT doc_id AS seq_id, (length(text) - length(regexp_replace(text, '[^ACGT]', '', 'g')))::BIGINT AS ambiguous FROM documents WHERE text IS NOT NULL")
def ambiguous_count(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select(F.col("doc_id").alias("seq_id"), "text")
    return stats.sequence_stats(docs, "text").select("seq_id", "ambiguous")


@query(f"WITH {S} SELECT seq_id, coalesce(list_max(list_transform(regexp_extract_all(dna, 'A+|C+|G+|T+'), lambda x: length(x))), 0)::BIGINT AS longest_run FROM s")
def max_homopolymer(spark, sf_dir):
    return stats.sequence_stats(sequences(spark, sf_dir)).select("seq_id", "longest_run")


ENTROPY_SQL = "WITH {cte}, c AS (SELECT seq_id, kmer, count(*) AS n FROM {k} GROUP BY ALL), t AS (SELECT seq_id, sum(n)::BIGINT AS total FROM c GROUP BY seq_id), e AS (SELECT seq_id, total, sum(-(n / total) * log2(n / total)) AS entropy, round(coalesce(sum(n) FILTER (WHERE n > total / 16 * 1.5), 0) / total, 6) AS repetitiveness FROM c JOIN t USING (seq_id) GROUP BY seq_id, total)"


@query(ENTROPY_SQL.format(cte=f"{S}, {kmer_sql(2)}", k="k2") + " SELECT seq_id, total, round(entropy, 6) + 0.0 AS entropy, repetitiveness FROM e")
def digram_entropy(spark, sf_dir):
    return stats.digram_entropy(sequences(spark, sf_dir)).withColumn("entropy", F.col("entropy") + 0.0)


SAMPLED = "z AS (SELECT seq_id, array_to_string(list_transform(list_slice(range(1, length(dna) + 1, greatest(length(dna) // greatest(least(1000, length(dna)), 1), 1)), 1, 1000), lambda i: substr(dna, i, 1)), '') AS dna FROM s)"


@query(ENTROPY_SQL.format(cte=f"{S}, {SAMPLED}, {kmer_sql(3, 'z')}", k="k3") + " SELECT s.seq_id, coalesce(round(entropy / 2, 6), 0.5) + 0.0 AS entropy FROM s LEFT JOIN e USING (seq_id)")
def trimer_entropy_sampled(spark, sf_dir):
    return stats.trimer_entropy(sequences(spark, sf_dir)).select("seq_id", "entropy")


@query(
    ENTROPY_SQL.format(cte=f"{S}, f AS (SELECT seq_id, substr(dna, 1, 10000) AS dna FROM s), {kmer_sql(2, 'f')}", k="k2")
    + """ SELECT s.seq_id,
      (CASE WHEN length(dna) < 100 THEN 8 WHEN repetitiveness > 0.3 THEN 4 WHEN round(entropy, 6) > 1.8 THEN 16 ELSE 8 END)::INTEGER AS "window",
      (CASE WHEN length(dna) < 100 THEN 2 WHEN repetitiveness > 0.4 THEN 2 WHEN round(entropy, 6) > 1.9 THEN 3 ELSE 2 END)::INTEGER AS min_phrase,
      (CASE WHEN length(dna) < 100 THEN 256 WHEN length(dna) > 10000000 THEN 512 WHEN length(dna) > 1000000 THEN 256 ELSE 128 END)::INTEGER AS max_phrase,
      (CASE WHEN length(dna) < 100 THEN 2 WHEN repetitiveness > 0.3 THEN 2 WHEN round(entropy, 6) > 1.8 THEN 3 ELSE 2 END)::INTEGER AS min_occurrences
      FROM s LEFT JOIN e USING (seq_id)"""
)
def autotune_params(spark, sf_dir):
    return stats.auto_tune(sequences(spark, sf_dir))


# Chunks.

CHUNKED = f"""WITH {S}, n AS (SELECT seq_id, dna, length(dna) AS n, CASE WHEN length(dna) <= 300 THEN 1 ELSE ceil((length(dna) - 50) / 250)::BIGINT END AS m FROM s),
c AS (SELECT seq_id, dna, n, m, unnest(range(0, m)) AS i FROM n)
SELECT seq_id, i::INTEGER AS idx, i * 250 AS "start", CASE WHEN i = m - 1 THEN n ELSE least(i * 250 + 300, n) END AS "end", i = 0 AS is_first, i = m - 1 AS is_last,
substr(dna, i * 250 + 1, CASE WHEN i = m - 1 THEN n - i * 250 ELSE 300 END) AS dna FROM c"""


@query(CHUNKED)
def chunk_split(spark, sf_dir):
    return chunks.split_chunks(sequences(spark, sf_dir), 300, 50)


@query(f"WITH {S} SELECT seq_id, dna FROM s")
def chunk_overlap_join(spark, sf_dir):
    return chunks.join_chunks(chunks.split_chunks(sequences(spark, sf_dir), 300, 50), 50)


@query(f"WITH {S} SELECT seq_id, (SELECT max(i) FROM unnest(range(0, least(12, length(dna)) + 1)) AS r(i) WHERE right(dna, i) = left(dna, i))::INTEGER AS overlap FROM s")
def best_overlap(spark, sf_dir):
    return sequences(spark, sf_dir).select("seq_id", chunks.best_overlap(F.col("dna"), F.col("dna"), 12).cast("int").alias("overlap"))


@query(ENTROPY_SQL.format(cte=f"{S}, {SAMPLED}, {kmer_sql(3, 'z')}", k="k3") + " SELECT s.seq_id, least(greatest(floor(200000 * (0.5 + (1 - coalesce(round(entropy / 2, 6), 0.5)) * 0.5)), 50000), 100000000)::BIGINT AS size FROM s LEFT JOIN e USING (seq_id)")
def adaptive_chunk_size(spark, sf_dir):
    found = stats.trimer_entropy(sequences(spark, sf_dir))
    return found.select("seq_id", chunks.adaptive_size(F.col("entropy"), 1_600_000, 8).alias("size"))


# Sketches and repeats.


@query(f"WITH {S}, {kmer_sql(K)} SELECT {hash_sql('kmer', K)} AS h, count(*) AS n FROM k{K} GROUP BY 1 HAVING count(*) >= 2")
def rolling_hash_counts(spark, sf_dir):
    return sketch.rolling_hash_counts(sequences(spark, sf_dir), K)


@query(f"WITH {S}, {kmer_sql(12)} SELECT kmer, count(*) AS n FROM k12 GROUP BY kmer HAVING count(*) >= 2")
def repeats_fixed_len(spark, sf_dir):
    return sketch.repeats(sequences(spark, sf_dir), 12)


#: Common prefixes are measured by powers of two, from the greatest down; intervals lie between smaller ones of the same stretch of neighbours.
REPEATS_SQL = f"""WITH {S},
x AS (SELECT seq_id, i - 1 AS pos, substr(dna, i) AS t, row_number() OVER (PARTITION BY seq_id ORDER BY substr(dna, i)) AS r FROM (SELECT seq_id, dna, unnest(range(1, length(dna) + 1)) AS i FROM s)),
u AS (SELECT seq_id, r, pos, t, lag(t) OVER (PARTITION BY seq_id ORDER BY r) AS u FROM x),
h AS (SELECT seq_id, r, list_reduce(list_transform(range(20, -1, -1), lambda e: 1::BIGINT << e), lambda k, p: k + CASE WHEN k + p <= least(length(t), length(u)) AND substr(t, k + 1, p) = substr(u, k + 1, p) THEN p ELSE 0 END, 0::BIGINT) AS h FROM u WHERE length(u) >= 12 AND substr(t, 1, 12) = substr(u, 1, 12)),
g AS (SELECT *, r - row_number() OVER (PARTITION BY seq_id ORDER BY r) AS island FROM h),
b AS (SELECT DISTINCT a.seq_id, a.h, coalesce(max(b.r) FILTER (WHERE b.r < a.r AND b.h < a.h), min(b.r) - 1) AS low, coalesce(min(b.r) FILTER (WHERE b.r > a.r AND b.h < a.h), max(b.r) + 1) AS high
  FROM g a JOIN g b USING (seq_id, island) GROUP BY a.seq_id, a.r, a.h)
SELECT b.seq_id, b.h AS length, high - low AS n, min(x.pos) AS pos FROM b JOIN x ON x.seq_id = b.seq_id AND x.r >= low AND x.r < high GROUP BY b.seq_id, b.h, low, high"""


@query(REPEATS_SQL)
def repeats_any_len(spark, sf_dir):
    return suffixes.repeats_from(sequences(spark, sf_dir), 12)


MINIMIZERS = f"""{S}, {kmer_sql(K)}, h AS (SELECT seq_id, pos, {hash_sql('kmer', K)} * 4294967296 - pos AS x FROM k{K}),
w AS (SELECT seq_id, min(x) OVER q AS x, count(*) OVER q AS n FROM h WINDOW q AS (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {W - 1} FOLLOWING)),
m AS (SELECT DISTINCT seq_id, (x + 4294967295) // 4294967296 AS h, x FROM w WHERE n = {W})"""


@query(f"WITH {MINIMIZERS} SELECT seq_id, h * 4294967296 - x AS pos, h FROM m")
def minimizers(spark, sf_dir):
    found = sketch.minimizers(sequences(spark, sf_dir), K, W)
    return found.select("seq_id", F.col("pos").cast("long").alias("pos"), "h")


@query(f"WITH {MINIMIZERS} SELECT h, count(*) AS n FROM m GROUP BY h")
def minimizer_counts(spark, sf_dir):
    return sketch.minimizer_counts(sequences(spark, sf_dir), K, W)


SKETCHED = f"{S}, {kmer_sql(K)}, b AS (SELECT seq_id, list_slice(list_sort(list(DISTINCT {hash_sql('kmer', K)})), 1, {SKETCH}) AS sketch FROM k{K} GROUP BY seq_id)"


@query(f"WITH {SKETCHED} SELECT seq_id, array_to_string(sketch, ',') AS sketch FROM b")
def minhash_sketch(spark, sf_dir):
    found = sketch.bottom_sketch(sequences(spark, sf_dir), K, SKETCH)
    return found.withColumn("sketch", F.array_join(F.col("sketch").cast("array<string>"), ","))


@query(f"WITH {SKETCHED}, p AS (SELECT x.seq_id AS pair, x.seq_id AS a, y.seq_id AS b, x.sketch AS sa, list_slice(list_sort(list_distinct(list_concat(x.sketch, y.sketch))), 1, {SKETCH}) AS u, y.sketch AS sb FROM b x JOIN b y ON y.seq_id = x.seq_id + 1) SELECT pair, a, b, round(len(list_filter(u, lambda v: list_contains(sa, v) AND list_contains(sb, v))) / len(u), 6) AS similarity FROM p")
def sketch_similarity(spark, sf_dir):
    found = keep(sketch.bottom_sketch(sequences(spark, sf_dir), K, SKETCH))
    left = found.select(F.col("seq_id").alias("pair"), F.col("seq_id").alias("a"), F.col("sketch").alias("sa"))
    right = found.select((F.col("seq_id") - 1).alias("pair"), F.col("seq_id").alias("b"), F.col("sketch").alias("sb"))
    return sketch.sketch_similarity(left, right, SKETCH)


@query(f"WITH {S} SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY substr(dna, i)) - 1 AS rank, i - 1 AS pos FROM (SELECT seq_id, dna, unnest(range(1, length(dna) + 1)) AS i FROM s)")
def suffix_arrays(spark, sf_dir):
    return suffixes.suffix_arrays(sequences(spark, sf_dir))


@query(G.window_fingerprints_sql(8))
def window_fingerprints(spark, sf_dir):
    return sketch.window_fingerprints(sequences(spark, sf_dir), 8)


# Grammars by pair replacement.


def rounds_sql(n: int) -> str:
    parts = [S, "q0 AS (SELECT seq_id, i - 1 AS pos, (instr('ACGT', substr(dna, i, 1)) - 1)::BIGINT AS sym FROM (SELECT seq_id, dna, unnest(range(1, length(dna) + 1)) AS i FROM s))"]
    for r in range(n):
        parts += [
            f"p{r} AS (SELECT *, lead(sym) OVER (PARTITION BY seq_id ORDER BY pos) AS nx FROM q{r})",
            f"b{r} AS (SELECT seq_id, sym AS a, nx AS b, count(*) AS n FROM p{r} WHERE nx IS NOT NULL GROUP BY seq_id, sym, nx HAVING count(*) >= 2 QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY n DESC, a, b) = 1)",
            f"h{r} AS (SELECT p.seq_id, p.pos, p.sym, coalesce(p.sym = a AND p.nx = b, false) AS hit FROM p{r} p LEFT JOIN b{r} USING (seq_id))",
            f"i{r} AS (SELECT *, pos - row_number() OVER (PARTITION BY seq_id, hit ORDER BY pos) AS island FROM h{r})",
            f"o{r} AS (SELECT *, hit AND row_number() OVER (PARTITION BY seq_id, hit, island ORDER BY pos) % 2 = 1 AS begins FROM i{r})",
            f"g{r} AS (SELECT *, coalesce(lag(begins) OVER (PARTITION BY seq_id ORDER BY pos), false) AS gone FROM o{r})",
            f"q{r + 1} AS (SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY pos) - 1 AS pos, CASE WHEN begins THEN {4 + r} ELSE sym END AS sym FROM g{r} WHERE NOT gone)",
        ]
    return "WITH " + ",\n".join(parts)


@query(rounds_sql(ROUNDS) + "\n" + " UNION ALL ".join(f"SELECT seq_id, {r}::BIGINT AS rule_id, a, b, n FROM b{r}" for r in range(ROUNDS)))
def repair_rounds_rules(spark, sf_dir):
    return repair.pair_rounds(sequences(spark, sf_dir), ROUNDS)[1]


@query(rounds_sql(ROUNDS) + f"\nSELECT seq_id, pos, sym::BIGINT AS sym FROM q{ROUNDS}")
def repair_rounds_symbols(spark, sf_dir):
    return repair.pair_rounds(sequences(spark, sf_dir), ROUNDS)[0]


@query(rounds_sql(ROUNDS) + f"\nSELECT s.seq_id, coalesce(n, 0) AS n_symbols FROM s LEFT JOIN (SELECT seq_id, count(*) AS n FROM q{ROUNDS} GROUP BY seq_id) USING (seq_id)")
def repair_first_rules(spark, sf_dir):
    """The grouped form stopped after as many rules as the relational one has rounds."""
    built = repair.build(sequences(spark, sf_dir), most_rules=ROUNDS)
    return built.select("seq_id", F.size("symbols").cast("long").alias("n_symbols"))


SETS, SHARE = 3, 4


def sets_sql(n: int) -> str:
    """Rounds that replace a set of pairs: in order of count, each that shares no symbol as end and begin with one taken before."""
    parts = [S, "q0 AS (SELECT seq_id, i - 1 AS pos, (instr('ACGT', substr(dna, i, 1)) - 1)::BIGINT AS sym FROM (SELECT seq_id, dna, unnest(range(1, length(dna) + 1)) AS i FROM s))", "made0 AS (SELECT seq_id, 0 AS made FROM s)"]
    none = "{'s': []::BIGINT[], 'e': []::BIGINT[], 'n': []::BIGINT[]}"
    for r in range(n):
        parts += [
            f"p{r} AS (SELECT *, lead(sym) OVER (PARTITION BY seq_id ORDER BY pos) AS nx FROM q{r})",
            f"c{r} AS (SELECT seq_id, sym AS a, nx AS b, count(*) AS n FROM p{r} WHERE nx IS NOT NULL GROUP BY seq_id, sym, nx HAVING count(*) >= 2)",
            f"f{r} AS (SELECT seq_id, list({{'a': a, 'b': b, 'n': n}} ORDER BY n DESC, a, b) AS l FROM (SELECT *, max(n) OVER (PARTITION BY seq_id) AS top FROM c{r}) WHERE n * {SHARE} >= top GROUP BY seq_id)",
            f"x{r} AS (SELECT seq_id, list_reduce(l, lambda t, x: CASE WHEN list_contains(t.e, x.a) OR list_contains(t.s, x.b) THEN t ELSE {{'s': list_append(t.s, x.a), 'e': list_append(t.e, x.b), 'n': list_append(t.n, x.n)}} END, {none}) AS t FROM f{r})",
            f"b{r} AS (SELECT seq_id, made + i - 1 AS rule_id, t.s[i] AS a, t.e[i] AS b, t.n[i] AS n FROM (SELECT seq_id, t, made, unnest(range(1, len(t.s) + 1)) AS i FROM x{r} JOIN made{r} USING (seq_id)))",
            f"made{r + 1} AS (SELECT seq_id, made + coalesce(len(t.s), 0) AS made FROM made{r} LEFT JOIN x{r} USING (seq_id))",
            f"h{r} AS (SELECT p.seq_id, p.pos, p.sym, b.rule_id, b.rule_id IS NOT NULL AS hit FROM p{r} p LEFT JOIN b{r} b ON b.seq_id = p.seq_id AND b.a = p.sym AND b.b = p.nx)",
            f"i{r} AS (SELECT *, pos - row_number() OVER (PARTITION BY seq_id, hit ORDER BY pos) AS island FROM h{r})",
            f"o{r} AS (SELECT *, hit AND row_number() OVER (PARTITION BY seq_id, hit, island ORDER BY pos) % 2 = 1 AS begins FROM i{r})",
            f"g{r} AS (SELECT *, coalesce(lag(begins) OVER (PARTITION BY seq_id ORDER BY pos), false) AS gone FROM o{r})",
            f"q{r + 1} AS (SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY pos) - 1 AS pos, CASE WHEN begins THEN 4 + rule_id ELSE sym END AS sym FROM g{r} WHERE NOT gone)",
        ]
    return "WITH " + ",\n".join(parts)


USED = " UNION ALL ".join(f"SELECT b.seq_id, b.rule_id, a, b, n, used FROM b{r} b JOIN (SELECT seq_id, rule_id, count(*) AS used FROM g{r} WHERE begins AND NOT gone GROUP BY seq_id, rule_id) USING (seq_id, rule_id)" for r in range(SETS))


@query(sets_sql(SETS) + "\n" + USED)
def pair_sets_rules(spark, sf_dir):
    return rounds.build_spread(sequences(spark, sf_dir), share=SHARE, rounds=SETS)[1]


@query(sets_sql(SETS) + f"\nSELECT seq_id, pos, sym::BIGINT AS sym FROM q{SETS}")
def pair_sets_symbols(spark, sf_dir):
    return rounds.placed_symbols(rounds.build_spread(sequences(spark, sf_dir), share=SHARE, rounds=SETS)[0])


@query(f"WITH {S} SELECT seq_id, dna, true AS finished FROM s WHERE length(dna) > 0")
def pair_sets_grammar(spark, sf_dir):
    """Built to the end: what it stands for, and whether no pair is left twice."""
    held, rules = rounds.build_spread(sequences(spark, sf_dir), share=SHARE)
    built = keep(rounds.grammar_rows(held, rules))
    pair = F.transform(F.sequence(F.lit(1), F.greatest(F.size("symbols") - 1, F.lit(1))), lambda i: F.slice("symbols", i, 2))
    left = built.select("seq_id", F.explode(pair).alias("pair")).where(F.size("pair") == 2).groupBy("seq_id", "pair").count().groupBy("seq_id").agg((F.max("count") < 2).alias("finished"))
    return grammar.expand(built).join(left, "seq_id", "left").select("seq_id", "dna", F.coalesce("finished", F.lit(True)).alias("finished"))


@query(f"WITH {S} SELECT seq_id, dna FROM s")
def repair_roundtrip(spark, sf_dir):
    return grammar.expand(repair.build(sequences(spark, sf_dir)))


@query(f"WITH {S} SELECT seq_id, dna FROM s")
def repair_either_strand_roundtrip(spark, sf_dir):
    return grammar.expand(repair.build(sequences(spark, sf_dir), either_strand=True))


@query(f"WITH {S} SELECT seq_id, dna FROM s")
def kmer_grammar_roundtrip(spark, sf_dir):
    return grammar.expand(repair.build(sequences(spark, sf_dir), kmer=4))


@query(G.KMER_RULES_SQL)
def kmer_rules(spark, sf_dir):
    return spelled(grammar.explode_rules(repair.build(sequences(spark, sf_dir), kmer=4)))


@query(f"WITH {S} SELECT seq_id, dna FROM s")
def kmer_either_strand_roundtrip(spark, sf_dir):
    return grammar.expand(repair.build(sequences(spark, sf_dir), kmer=4, either_strand=True))


@query(f"WITH {S} SELECT seq_id, dna FROM s")
def simplified_roundtrip(spark, sf_dir):
    built = repair.build(sequences(spark, sf_dir))
    return grammar.expand(grammar.simplify(built, most_rules=8))


@query(f"WITH {S} SELECT seq_id, dna FROM s")
def lcg_roundtrip(spark, sf_dir):
    return grammar.expand(lcg.build(sequences(spark, sf_dir)))


@query(f"WITH {S} SELECT seq_id, dna FROM s")
def lcg_tuned_roundtrip(spark, sf_dir):
    return grammar.expand(lcg.build_tuned(sequences(spark, sf_dir)))


@query(f"WITH {S} SELECT seq_id, dna FROM s WHERE length(dna) > 0")
def lcg_phrases_joined(spark, sf_dir):
    """Phrases cover a sequence without gaps."""
    found = parsing.phrases(sequences(spark, sf_dir))
    part = F.array_sort(F.collect_list(F.struct("start", "content")))
    return found.groupBy("seq_id").agg(F.array_join(F.transform(part, lambda p: p["content"]), "").alias("dna"))


PRINTS = {a + b: D.fx_hash(w for x in a + b for w in D.symbol_words("ACGT".index(x))) for a in "ACGT" for b in ("A", "C", "G", "T", "")}


@query(G.phrases(PRINTS) + "SELECT seq_id, start, len, content FROM p")
def lcg_phrases(spark, sf_dir):
    return parsing.phrases(sequences(spark, sf_dir)).where(F.col("len") > 0)


@query(G.phrases(PRINTS) + "SELECT content, count(*) AS n FROM p WHERE len >= 2 GROUP BY content HAVING count(*) >= 2")
def lcg_phrase_rules(spark, sf_dir):
    return parsing.phrase_rules(sequences(spark, sf_dir))


@query(G.phrases(PRINTS) + "SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY min(start)) - 1 AS rule_id, content, count(*) AS n FROM p WHERE len >= 2 GROUP BY seq_id, content HAVING count(*) >= 2")
def lcg_first_rules(spark, sf_dir):
    """The rules of the first level, in order of first place; later levels use them."""
    rules = parsing.build_spread(sequences(spark, sf_dir), levels=1)[1]
    return rules.select("seq_id", "rule_id", F.translate(F.array_join(F.col("symbols").cast("array<string>"), ""), "0123", "ACGT").alias("content"), F.col("used").alias("n"))


@query(f"WITH {S} SELECT seq_id, dna FROM s WHERE length(dna) > 0")
def lcg_spread_roundtrip(spark, sf_dir):
    """All levels over pieces, expanded again; tests hold the rules against those built in a task."""
    held, rules = parsing.build_spread(sequences(spark, sf_dir))
    return grammar.expand(parsing.grammar_rows(held, rules))


@query(G.SYMBOL_DIGRAMS_SQL)
def symbol_digram_counts(spark, sf_dir):
    """Pairs of final symbols, those of bases on either strand."""
    found = kmers.symbol_kmers(grammars(spark, sf_dir).select("seq_id", "symbols"), 2)
    return spelled(found.select(kmers.canonical_symbols(F.col("kmer")).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n")), "kmer")


@query(G.RULE_PRINTS_SQL)
def rule_fingerprints(spark, sf_dir):
    return grammar.explode_rules(grammars(spark, sf_dir)).select("seq_id", "rule_id", D.fingerprint_symbols("symbols").alias("fingerprint"))


@query(G.RULES_SQL)
def repair_rules(spark, sf_dir):
    return spelled(grammar.explode_rules(repair.build(sequences(spark, sf_dir))))


@query(G.EVICTED_SQL)
def evicted_rules(spark, sf_dir):
    built = repair.build(sequences(spark, sf_dir))
    return spelled(grammar.explode_rules(grammar.simplify(built, most_rules=8)))


# Analysis.


@query(G.ANALYSIS_SQL)
def rule_analysis(spark, sf_dir):
    return spelled(grammar.analyze(grammars(spark, sf_dir)))


@query(G.LEVELS_SQL)
def rule_levels(spark, sf_dir):
    """The same figures by rounds of joins."""
    return grammar.rule_levels(grammar.explode_rules(grammars(spark, sf_dir)))


@query(G.EDGES_SQL)
def rule_edges(spark, sf_dir):
    return export.edges(grammars(spark, sf_dir))


@query(f"WITH {S} SELECT seq_id, length(dna)::BIGINT AS total FROM s")
def sequence_assembly_index(spark, sf_dir):
    """The assembly index and one for each final symbol add up to the bases."""
    built = grammars(spark, sf_dir)
    found = grammar.sequence_assembly_index(built).join(built.select("seq_id", F.size("symbols").alias("n")), "seq_id")
    return found.select("seq_id", (F.col("assembly_index") + F.col("n")).cast("long").alias("total"))


@query(G.STATS_SQL)
def compression_stats(spark, sf_dir):
    return grammar.compression_stats(grammars(spark, sf_dir))


@query(f"WITH {S} SELECT seq_id, length(dna)::BIGINT AS original_size FROM s")
def original_sizes(spark, sf_dir):
    return grammar.compression_stats(grammars(spark, sf_dir)).select("seq_id", "original_size")


@query(G.DEDUPLICATED_SQL)
def deduplicated_rules(spark, sf_dir):
    return spelled(grammar.deduplicate_rules(grammar.explode_rules(grammars(spark, sf_dir))), "body")


# Parts of grammars.


STEP, WIDTH = 200, 40


@query(f"WITH {S} SELECT seq_id, i * {STEP} AS start, i * {STEP} + {WIDTH} AS stop, substr(dna, i * {STEP} + 1, {WIDTH}) AS dna, repeat('+', length(substr(dna, i * {STEP} + 1, {WIDTH}))::BIGINT) AS strands FROM (SELECT *, unnest(range(0, length(dna) // {STEP} + 1)) AS i FROM s)")
def expanded_ranges(spark, sf_dir):
    """Every 200 bases, the next 40, read from the grammars."""
    places = F.transform(F.sequence(F.lit(0), F.floor(F.length("dna") / STEP)), lambda i: (i * STEP).cast("long"))
    ranges = sequences(spark, sf_dir).select("seq_id", F.explode(places).alias("start")).withColumn("stop", F.col("start") + WIDTH)
    return access.expand_ranges(grammars(spark, sf_dir), ranges)


@query(G.TO_DEPTH_SQL)
def symbols_to_depth(spark, sf_dir):
    return spelled(access.expand_to_depth(grammars(spark, sf_dir), 2))


# Merging.


@query(G.MERGED_SQL)
def merged_rules(spark, sf_dir):
    return grammar.merge_grammars(grammars(spark, sf_dir))[0]


@query(G.ORIGINS_SQL)
def rule_origins(spark, sf_dir):
    return grammar.merge_grammars(grammars(spark, sf_dir))[1].drop("flipped")


@query(f"WITH {S} SELECT seq_id, dna FROM s WHERE length(dna) > 0")
def merged_roundtrip(spark, sf_dir):
    built = grammars(spark, sf_dir)
    rules, origins = grammar.merge_grammars(built)
    rows = grammar.merged_sequences(built, origins).withColumn("rule_id", D.rule_of("sym"))
    text = rows.join(rules.select("rule_id", F.col("dna").alias("rule_dna")), "rule_id", "left")
    part = F.struct("pos", F.coalesce("rule_dna", D.code_base("sym")).alias("dna"))
    return text.groupBy("seq_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["dna"]), "").alias("dna"))


@query(f"WITH {S} SELECT seq_id, dna FROM s")
def chunked_roundtrip(spark, sf_dir):
    seqs = sequences(spark, sf_dir)
    built = keep(repair.build_chunked(seqs, 1000).withColumn("key", F.xxhash64("seq_id", "idx")))
    texts = grammar.expand(built.select(F.col("key").alias("seq_id"), "symbols", "rules")).withColumnRenamed("seq_id", "key")
    part = built.select("key", "seq_id", "idx").join(texts, "key")
    return part.groupBy("seq_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "dna"))), lambda p: p["dna"]), "").alias("dna"))


@query(f"WITH {S} SELECT seq_id, dna FROM s")
def merged_chunks_roundtrip(spark, sf_dir):
    """Chunks' grammars made one for each sequence, rules of both strands as one."""
    return grammar.expand(grammar.merge_chunks(repair.build_chunked(sequences(spark, sf_dir), 1000, either_strand=True), either_strand=True))


# Exports and sources.


@query(G.SUMMARY_SQL)
def repeat_summary(spark, sf_dir):
    return export.repeat_summary(grammars(spark, sf_dir))


@query(G.LONGEST_SQL)
def top_n_longest_rules(spark, sf_dir):
    return spelled(export.top_rules(grammars(spark, sf_dir), 20))


def _export(kind: str, name: str, **options):
    def run(spark, sf_dir):
        return export.lines_for(grammars(spark, sf_dir), kind, **options)

    run.__name__ = name
    query(G.LINES_SQL.get(name))(run)


for _kind in ("text", "fasta", "gfa", "dot", "graphml", "repeats", "stats"):
    _export(_kind, f"{_kind}_lines")
_export("text", "text_lines_full", dialect="full")
_export("text", "text_lines_wrapped", dialect="wrapped")
_export("fasta", "fasta_lines_full", dialect="full")
_export("gfa", "gfa_lines_rules", dialect="rules")
_export("dot", "dot_lines_graph", dialect="graph")
_export("json", "json_object_lines", dialect="object")


@query(G.LINES_SQL["gfa_top_lines"])
def gfa_top_lines(spark, sf_dir):
    return export.gfa_top_lines(grammars(spark, sf_dir), 5)


@query(f"WITH {S} SELECT seq_id, dna FROM s")
def json_roundtrip(spark, sf_dir):
    """Grammars written as JSON files, read back and expanded."""
    path = new_path(spark)
    export.grammar_json(grammars(spark, sf_dir)).select(F.regexp_replace("json", r"^\{", F.concat(F.lit('{"seq_id":'), F.col("seq_id"), F.lit(","))).alias("value")).write.text(path)
    found = spark.read.schema("seq_id long, " + fasta.GRAMMAR_JSON).json(path)
    rules = F.transform("rules", lambda r: F.struct(r["id"].alias("rule_id"), F.transform(r["symbols"], fasta.symbol_code).alias("symbols")))
    return grammar.expand(found.select("seq_id", F.transform("final_sequence", fasta.symbol_code).alias("symbols"), rules.alias("rules")))


@query(f"WITH {S} SELECT seq_id::VARCHAR AS record_id, dna FROM s WHERE length(dna) > 0")
def fasta_roundtrip(spark, sf_dir):
    path = new_path(spark)
    sequences(spark, sf_dir).select(F.concat(F.lit(">"), F.col("seq_id"), F.lit(" document\n"), export.wrap(F.col("dna"))).alias("value")).write.text(path)
    return fasta.read_fasta(spark, path).select("record_id", "dna")


@query(f"WITH {S} SELECT seq_id::VARCHAR AS record, true AS named, dna FROM s WHERE length(dna) > 0")
def fasta_files_roundtrip(spark, sf_dir):
    """Several files read together; a record is known by its file's name and its own."""
    path = new_path(spark)
    sequences(spark, sf_dir).select(F.concat(F.lit(">"), F.col("seq_id"), F.lit("\n"), export.wrap(F.col("dna"))).alias("value")).repartition(5).write.text(path)
    parts = F.split("record_id", ":")
    found = fasta.read_fasta(spark, path, prefix_file=True)
    return found.select(F.get(parts, F.lit(1)).alias("record"), (F.length(F.get(parts, F.lit(0))) > 0).alias("named"), "dna")


@query(G.DNA_FASTA_SQL)
def dna_fasta_lines(spark, sf_dir):
    return export.dna_fasta_lines(sequences(spark, sf_dir), "Sequence")


@query(f"WITH {S}, {kmer_sql(40)} SELECT h, sum(n)::BIGINT AS n FROM (SELECT list_reduce(list_transform(string_split(kmer, ''), lambda c: ascii(c)::BIGINT), lambda a, b: (a * 101 + b) % 1000000007) AS h, count(*) AS n FROM k40 GROUP BY kmer) GROUP BY h HAVING sum(n) >= 2")
def long_rolling_hash_counts(spark, sf_dir):
    return sketch.rolling_hash_counts(sequences(spark, sf_dir), 40)


ORB_SQL = f"""WITH {S}, d AS (SELECT doc_id AS seq_id, source FROM documents), w AS (SELECT source, count(*)::BIGINT AS n_sequences, string_agg(dna, '' ORDER BY seq_id) AS dna FROM s JOIN d USING (seq_id) GROUP BY source)
SELECT source, n_sequences, block, substr(dna, block * 1000 + 1, 1000) AS dna FROM (SELECT *, unnest(range(0, (length(dna) + 999) // 1000)) AS block FROM w)"""


@query(ORB_SQL)
def orb_roundtrip(spark, sf_dir):
    """Containers of several parts, read back in blocks of 1,000 bases."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), "source", D.normalize(F.coalesce("text", F.lit(""))).alias("raw"))
    return fasta.read_orb_parts(keep(fasta.to_orb(docs, part_bytes=1 << 16)), 1000)


@query(f"WITH {S}, o AS (SELECT seq_id, dna, row_number() OVER (ORDER BY seq_id) - 1 AS k FROM s), c AS (SELECT unnest([5, 0, 5, 17]) AS k, unnest([0, 1, 2, 3])::BIGINT AS ordinal) SELECT ordinal, seq_id, dna FROM c JOIN o USING (k)")
def select_sequences(spark, sf_dir):
    return fasta.select_sequences(sequences(spark, sf_dir), [5, 0, 5, 17])


@query("WITH s AS (SELECT conv_id, turn, upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g')) AS dna FROM conversations) SELECT conv_id, turn, length(dna)::BIGINT AS n_bases FROM s")
def conversation_lengths(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", D.normalize(F.coalesce("text", F.lit(""))).alias("dna"))
    return turns.select("conv_id", "turn", F.length("dna").cast("long").alias("n_bases"))


# Streaming.


@query(f"WITH {S}, {kmer_sql(K)} SELECT kmer, count(*) AS n FROM k{K} GROUP BY kmer")
def streaming_kmer_counts(spark, sf_dir):
    source, target, marks = new_path(spark), new_path(spark), new_path(spark)
    streaming.write_chunks(sequences(spark, sf_dir), source, 1000, K - 1)
    streaming.run_to_table(streaming.stream_kmer_counts(streaming.read_chunks(spark, source), K), target, marks)
    return spark.read.parquet(target)


@query(f"WITH {S} SELECT seq_id, dna FROM s WHERE length(dna) > 0")
def streaming_grammar_roundtrip(spark, sf_dir):
    source, target, marks = new_path(spark), new_path(spark), new_path(spark)
    streaming.write_chunks(sequences(spark, sf_dir), source, 1000, 0)
    streaming.run_to_table(streaming.stream_grammars(streaming.read_chunks(spark, source)), target, marks, "update")
    return grammar.expand(streaming.finalize(spark.read.parquet(target)))
