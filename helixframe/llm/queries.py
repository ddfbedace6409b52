"""The queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import digests
from .chat import link_tool_calls
from .common import Scratch, documents
from .convtrie import prefix_trie, shared_openings, turn_arrays
from .langid import identify
from .linededup import dedup_lines
from .media import media_digests, store_avi
from .mixing import mix_sources
from .multiindex import nearest_vectors
from .neardup import near_duplicates
from .periodic import periodic_runs, run_digests, with_repeats
from .perplexity import quality
from .secretscan import scan_secrets
from .tokenfile import read_shards, write_shards


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    with Scratch(spark) as scratch:
        return read_shards(write_shards(documents(spark, sf_dir), tokenizers.path("byte_bpe_50k.json"), scratch))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return digests(documents(spark, sf_dir), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


#: Tools that conversations may call: (tool, param, type, required).
TOOLS = [("search", "query", "string", True), ("search", "limit", "integer", False), ("fetch", "url", "string", True), ("calculate", "expression", "string", True)]


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    schemas = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{t}', '{p}', '{k}', {str(r).lower()})" for t, p, k, r in TOOLS) + " AS t(tool, param, type, required)")
    linked = link_tool_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet"), schemas)
    return linked.select("conv_id", "turn", "kind", "level", "ordinal", "call_id", F.col("linked_turn").cast("string").alias("linked_turn"), F.array_join("problems", ", ").alias("problems"), F.sha2("json", 256).alias("json_sha256"))


def op5_ngram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op7_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=3, percent=85)


def op8_motion_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(store_avi(documents(spark, sf_dir)))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = dedup_lines(documents(spark, sf_dir))
    return cleaned.select("row.doc_id", "n_lines", "n_dropped", F.sha2("text_kept", 256).alias("kept_sha256"))


def op11_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        return nearest_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0, scratch)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(with_repeats(documents(spark, sf_dir))))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = turn_arrays(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    with Scratch(spark) as scratch:
        return prefix_trie(shared_openings(scratch.keep(arrays)), scratch).drop("last_key")


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_mix_sources": op3_mix_sources,
    "op4_tool_calls": op4_tool_calls,
    "op5_ngram_perplexity": op5_ngram_perplexity,
    "op6_language_id": op6_language_id,
    "op7_setsketch": op7_setsketch,
    "op8_motion_jpeg": op8_motion_jpeg,
    "op9_line_dedup": op9_line_dedup,
    "op10_secret_scan": op10_secret_scan,
    "op11_multi_index": op11_multi_index,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_prefix_trie": op13_prefix_trie,
}

OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT doc_id, pos, line, common.k IS NOT NULL AND doc_id <> last AS gone FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

#: The table's turns hold no calls or results, which the query's WHERE makes sure of.
OP4_SQL = r"""
SELECT conv_id, turn, 'message' AS kind, 0::INTEGER AS level, 0::INTEGER AS ordinal, NULL::VARCHAR AS call_id, NULL::VARCHAR AS linked_turn, '' AS problems,
       sha256(concat('{"content":', coalesce(to_json(text)::VARCHAR, 'null'), ',"role":', coalesce(to_json(role)::VARCHAR, 'null'), ',"turn":', coalesce(turn::VARCHAR, 'null'), '}')) AS json_sha256
FROM conversations
WHERE NOT coalesce(role IN ('assistant', 'tool') AND starts_with(ltrim(text), '{') AND (contains(text, '"tool_calls"') OR contains(text, '"tool_call_id"')), false)
"""

OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2]))) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS id, doc_id AS root FROM documents
  UNION
  SELECT y, root FROM reach JOIN both_ways ON x = id WHERE root < y),
least_root AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN least_root ON id = doc_id
"""

#: The checksum is worked out bit by bit: its polynomial is a fixed value.
OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
crc AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
         lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) AS crc
  FROM sizes),
c AS (
  SELECT crc.conv_id, crc % 6 AS h, crc.conv_id - crc.conv_id % 100 AS base, least(crc % 6, coalesce(n, 0)) AS lead
  FROM crc LEFT JOIN sizes ON sizes.conv_id = crc.conv_id - crc.conv_id % 100),
rebuilt AS (
  SELECT c.conv_id, t.i AS pos, role, text FROM c JOIN t ON t.conv_id = c.base AND t.i < c.h
  UNION ALL
  SELECT c.conv_id, c.lead + t.i - c.h, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i >= c.h),
chained AS (
  SELECT conv_id, pos + 1 AS depth, length(text) AS size,
         md5(string_agg(md5(concat(strlen(role), ':', role, text)), ',') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS node
  FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
linked AS (
  SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS up, lead(node) OVER (PARTITION BY conv_id ORDER BY depth) AS down FROM chained),
nodes AS (
  SELECT node, depth, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, count(DISTINCT down) AS n_children, (count(*) - 1) * min(size) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE down IS NULL), '')) AS ends_sha256
  FROM linked GROUP BY node, depth),
below AS (SELECT DISTINCT a.node, b.node AS inner_node FROM linked a JOIN linked b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
sums AS (
  SELECT below.node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM below JOIN nodes ON nodes.node = below.inner_node GROUP BY below.node)
SELECT nodes.conv_id, nodes.depth, parents.conv_id AS parent_conv_id, nodes.n_convs, nodes.n_children, n_leaves, saved_tokens, nodes.ends_sha256
FROM nodes JOIN sums USING (node) LEFT JOIN nodes parents ON parents.node = nodes.up
"""

ORACLE_SQL = {"op4_tool_calls": OP4_SQL, "op7_setsketch": OP7_SQL, "op9_line_dedup": OP9_SQL, "op13_prefix_trie": OP13_SQL}
