"""Sequence sources: FASTA, .orb containers, grammar JSON, tables."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.batches import bounded
from ..functions.dna import normalize


def read_fasta(spark: SparkSession, paths, skip_ns: bool = True, keep_empty: bool = False, prefix_file: bool = False) -> DataFrame:
    """seq_id, source, record_id, raw, dna of all records of one or more FASTA files.

    A record is one row of Spark's text source, split at ``>`` after a line end, so
    files are read in parallel.  record_id is the header's first word; with
    ``prefix_file`` it is ``stem:word``.  raw has no white space, and no N if
    ``skip_ns``; dna holds its A, C, G and T in upper case.  Records without bases are
    dropped unless ``keep_empty``.  seq_id numbers records uniquely, in the order of places in a file.
    """
    text = spark.read.text(paths, lineSep="\n>").select("value", F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_name").alias("file"))
    record = F.regexp_replace("value", r"^\s*>", "")
    head = F.substring_index(record, "\n", 1)
    body = F.regexp_replace(F.substring(record, F.length(head) + 2, F.length(record)), r"\s", "")
    raw = F.regexp_replace(body, "[Nn]", "") if skip_ns else body
    word = F.regexp_extract(head, r"^\s*(\S+)", 1)
    name = F.concat_ws(":", F.regexp_replace("file", r"\.[^.]*$", ""), word) if prefix_file else word
    rows = text.where(F.trim("value") != "").select("source", name.alias("record_id"), raw.alias("raw"), F.monotonically_increasing_id().alias("seq_id"))
    rows = rows if keep_empty else rows.where(F.length("raw") > 0)
    return rows.select("seq_id", "source", "record_id", "raw", normalize("raw").alias("dna"))


def from_table(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """seq_id, dna: the A, C, G and T of a text column; null is empty. Each text is gone through once, by bytes, whatever is made of it."""

    def run(batches):
        for batch in bounded(batches, 1 << 22):
            yield pa.RecordBatch.from_arrays([batch.column("seq_id"), bases_of(batch.column("raw"))], ["seq_id", "dna"])

    kind = df.select(key).schema[0].dataType.simpleString()
    return df.select(F.col(key).alias("seq_id"), F.col(text).alias("raw")).mapInArrow(run, f"seq_id {kind}, dna string")


UPPER_BASE = np.zeros(256, np.uint8)
for _base in b"ACGT":
    UPPER_BASE[[_base, _base + 32]] = _base


def bases_of(texts) -> pa.Array:
    """What ``dna.normalize`` gives of each text of an Arrow array; of a character beyond ASCII no byte is a base."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    bases = UPPER_BASE[raw]
    places = np.flatnonzero(bases)
    cuts = np.searchsorted(places, edges - edges[0])
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(bases[places])).cast(pa.string())


def from_lists(spark: SparkSession, records) -> DataFrame:
    """seq_id, record_id, dna of (id, bases) pairs in memory."""
    rows = [(k, name, bases) for k, (name, bases) in enumerate(records)]
    df = spark.createDataFrame(rows, "seq_id long, record_id string, raw string")
    return df.select("seq_id", "record_id", normalize("raw").alias("dna"))


def select_sequences(seqs: DataFrame, indices: list[int], order: str = "seq_id") -> DataFrame:
    """The sequences at 0-based places in the order of a column; places may repeat and their order is kept in ``ordinal``."""
    if not indices:
        raise ValueError("no sequence is chosen")
    from ..operators.grammar import numbered

    spark = seqs.sparkSession
    chosen = spark.createDataFrame([(i, int(k)) for i, k in enumerate(indices)], "ordinal long, number long")
    return numbered(seqs, order).join(F.broadcast(chosen), "number").drop("number")


def read_range(seqs: DataFrame, start: int, length: int) -> DataFrame:
    """seq_id, dna: bases from a 0-based start."""
    return seqs.select("seq_id", F.substring("dna", start + 1, length).alias("dna"))


def lengths(seqs: DataFrame) -> DataFrame:
    return seqs.select("seq_id", F.length("dna").cast("long").alias("n_bases"))


def total_orb(content: bytes) -> tuple[int, bytes]:
    """(number of sequences, bases) of an .orb container: two little-endian 64-bit counts, then the bases."""
    n, length = struct.unpack_from("<QQ", content, 0)
    return n, content[16 : 16 + length]


def read_orb(spark: SparkSession, paths) -> DataFrame:
    """source, n_sequences, dna of .orb files; records' borders are not in the format."""

    def run(batches):
        for batch in batches:
            found = [total_orb(c) for c in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([n for n, _ in found], pa.int64()), pa.array([b.decode() for _, b in found])], ["source", "n_sequences", "dna"])

    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", "content").mapInArrow(run, "source string, n_sequences long, dna string")


PART_BYTES = 1 << 24


def to_orb(seqs: DataFrame, by: str = "source", part_bytes: int = PART_BYTES) -> DataFrame:
    """by, part, start, content: one container for each ``by`` as rows of bytes, to be put together in order of part.

    Records come in order of seq_id, other characters than ACGT written as A.  Part 0 is the
    header; the others hold ``part_bytes`` at most and begin at ``start``.  They are made by
    ranges of (by, seq_id), so a container of any size is spread over tasks.
    """
    from ..shared import keep

    clean = seqs.select(F.col(by).alias("by"), "seq_id", normalize("raw", "replace_a").alias("dna"))
    ranged = clean.repartitionByRange("by", "seq_id").sortWithinPartitions("by", "seq_id")
    schema = "by string, place long, n long, size long, content binary"

    def run(batches):
        place, name, n, held, size = TaskContext.get().partitionId() << 32, None, 0, [], 0

        def part():
            nonlocal place, n, held, size
            place += 1
            row = [[name], [place], [n], [size], [b"".join(held)]]
            n, held, size = 0, [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], [f.split()[0] for f in schema.split(", ")])

        for batch in batches:
            for key, dna in zip(batch.column("by").to_pylist(), batch.column("dna").to_pylist()):
                if (n or size) and key != name:
                    yield part()
                name, n, raw = key, n + 1, (dna or "").encode()
                for k in range(0, len(raw), part_bytes):
                    piece = raw[k : k + part_bytes]
                    if size + len(piece) > part_bytes:
                        yield part()
                    held.append(piece)
                    size += len(piece)
        if n or size:
            yield part()

    parts = keep(ranged.select("by", "dna").mapInArrow(run, schema))
    in_order = Window.partitionBy("by").orderBy("place")
    number = F.row_number().over(in_order).cast("long")
    start = 16 + F.coalesce(F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = parts.select(F.col("place").alias("of"), number.alias("part"), start.alias("start"), "by", "place", "size").select("of", "part", "start")
    little = lambda x: F.unhex(F.concat(*[F.substring(F.lpad(F.hex(x), 16, "0"), k, 2) for k in range(15, 0, -2)]))
    totals = parts.groupBy("by").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    head = totals.select("by", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("start"), F.concat(little(F.col("n")), little(F.col("size"))).alias("content"))
    body = parts.join(places, F.col("place") == F.col("of")).select("by", "part", "start", "content")
    return head.unionByName(body).withColumnRenamed("by", by)


def read_orb_parts(parts: DataFrame, block: int, by: str = "source") -> DataFrame:
    """by, n_sequences, block, dna: a container's bases in blocks of a fixed size, each put together from the parts that it lies in."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for name, start, content in zip(*(batch.column(c).to_pylist() for c in ("by", "start", "content"))):
                first, text = start - 16, content.decode()
                at = 0
                while at < len(text):
                    k, inside = divmod(first + at, block)
                    out.append((name, k, inside, text[at : at + block - inside]))
                    at += block - inside
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, kinds)], ["by", "block", "at", "dna"])

    rows = parts.withColumnRenamed(by, "by")
    number = F.aggregate(F.sequence(F.lit(8), F.lit(1), F.lit(-1)), F.lit(0).cast("long"), lambda acc, k: acc * 256 + F.conv(F.hex(F.substring(F.col("content"), k, F.lit(1))), 16, 10).cast("long"))
    heads = rows.where("part = 0").select(F.col("by").alias("of"), number.alias("n_sequences"))
    pieces = rows.where("part > 0").select("by", "start", "content").mapInArrow(run, "by string, block long, at long, dna string")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "dna"))), lambda p: p["dna"]), "")
    blocks = pieces.groupBy("by", "block").agg(text.alias("dna"))
    return blocks.join(heads, F.col("by").eqNullSafe(F.col("of"))).select(F.col("by").alias(by), "n_sequences", "block", "dna")


SYMBOL_JSON = "struct<id:long,type:string,value:string,strand:string>"
GRAMMAR_JSON = f"final_sequence array<{SYMBOL_JSON}>, rules array<struct<id:long,symbols:array<{SYMBOL_JSON}>,usage_count:long,depth:int>>"


def symbol_code(s) -> Column:
    """A JSON symbol's number; on the other strand a base is its complement."""
    forward = F.when(s["type"] == "terminal", (F.instr(F.lit("ACGT"), s["value"]) - 1).cast("long")).otherwise(4 + s["value"].cast("long"))
    return F.when(s["strand"] != "-", forward).when(s["type"] == "terminal", 3 - forward).otherwise(-1 - forward)


def read_grammar_json(spark: SparkSession, paths) -> DataFrame:
    """Grammar rows (source, symbols, rules) of JSON files in the array dialect."""
    found = spark.read.schema(GRAMMAR_JSON).json(paths, multiLine=True).withColumn("source", F.input_file_name())
    rules = F.transform("rules", lambda r: F.struct(r["id"].alias("rule_id"), F.transform(r["symbols"], symbol_code).alias("symbols"), r["usage_count"].alias("usage_count"), r["usage_count"].alias("pair_count")))
    return found.select("source", F.transform("final_sequence", symbol_code).alias("symbols"), rules.alias("rules"))
