"""Running a whole analysis: read, build, merge, export, with checkpoints and metadata; and the command line.

``python -m helixframe.plans.run genome.fa --output run1 --stats --output-gfa``

Each input file's grammars are a checkpoint of their own, under a name that is made of the
file's path, size and time and of the options that matter to it.  A run takes up
those that are complete, and builds the others; other inputs or options never meet an
old table.
"""

from __future__ import annotations

import argparse
import datetime
import hashlib
import json
import os
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks, grammar, lcg, repair, stats
from ..ship import ship
from ..shared import keep, new_path
from ..sources import export, fasta
from ..streaming import counts as streaming

GRAPHS = ("dot", "graphml")


@dataclass
class Options:
    """What a run does; the limits are checked when it is made."""

    inputs: list[str] = field(default_factory=list)
    output: str = "run"
    kmer_size: int = 2
    min_rule_usage: int = 2
    max_rule_count: int | None = None
    reverse_aware: bool = False
    skip_ns: bool = True
    chunk_size: int = 0
    adaptive_chunking: bool = False
    max_memory_mb: int = 1024
    streaming: bool = False
    use_lcg: bool = False
    auto_tune_lcg: bool = False
    sequence_indices: list[int] | None = None
    simplify: bool = True
    outputs: list[str] = field(default_factory=lambda: ["json"])
    graph_terminals: bool = True
    graph_usage: bool = True
    graph_depth_colors: bool = True
    graph_max_depth: int | None = None
    force_rerun: bool = False

    def __post_init__(self):
        if not 1 <= self.kmer_size <= 255:
            raise ValueError("kmer_size must be from 1 to 255")
        if self.min_rule_usage < 2:
            raise ValueError("min_rule_usage must be 2 at least")
        if self.chunk_size and self.chunk_size < 1000:
            raise ValueError("chunk_size must be 1000 at least, or 0 for none")
        if self.streaming and (self.kmer_size > 2 or self.reverse_aware or self.use_lcg or self.auto_tune_lcg):
            raise ValueError("streamed grammars are made of pairs on one strand")

    def for_graph(self, kind: str) -> dict:
        if kind == "dot":
            return {"terminals": self.graph_terminals, "usage": self.graph_usage, "by_depth": self.graph_depth_colors}
        return {"terminals": self.graph_terminals, "deepest": self.graph_max_depth}


#: Options that say what is built; the others only what is done with it.
BUILDING = ("kmer_size", "min_rule_usage", "max_rule_count", "reverse_aware", "skip_ns", "chunk_size", "adaptive_chunking", "max_memory_mb", "streaming", "use_lcg", "auto_tune_lcg", "sequence_indices", "simplify")


def build(seqs: DataFrame, options: Options) -> DataFrame:
    """Grammar rows, one for each sequence; chunks are built on their own and merged."""
    if options.streaming:
        return stream(seqs, options)
    if options.auto_tune_lcg:
        return lcg.build_tuned(seqs)
    if options.use_lcg:
        return lcg.build(seqs, least=options.min_rule_usage)
    made = {"least": options.min_rule_usage, "most_rules": options.max_rule_count, "either_strand": options.reverse_aware, "kmer": max(2, options.kmer_size)}
    if options.adaptive_chunking:
        workers = seqs.sparkSession.sparkContext.defaultParallelism
        size = chunks.adaptive_size(F.col("entropy"), options.max_memory_mb << 20, workers, options.chunk_size or None)
        return grammar.merge_chunks(repair.build_chunked(stats.trimer_entropy(seqs), size, **made), options.reverse_aware)
    if options.chunk_size:
        return grammar.merge_chunks(repair.build_chunked(seqs, options.chunk_size, **made), options.reverse_aware)
    return repair.build(seqs, **made)


def stream(seqs: DataFrame, options: Options) -> DataFrame:
    """Grammars that grow chunk by chunk in a stream, finished at its end."""
    spark = seqs.sparkSession
    source, target, marks = (new_path(spark) for _ in range(3))
    streaming.write_chunks(seqs.select("seq_id", "dna"), source, options.chunk_size or 100_000, 0)
    streaming.run_to_table(streaming.stream_grammars(streaming.read_chunks(spark, source), options.min_rule_usage), target, marks, "update")
    return streaming.finalize(spark.read.parquet(target), options.min_rule_usage, options.max_rule_count)


def files_of(spark: SparkSession, inputs: list[str]) -> list[tuple[str, str]]:
    """(path, its size and time) of all files that the inputs name, patterns too, in order of path."""
    found = {}
    for name in inputs:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        listed = system.globStatus(path)
        if not listed:
            raise FileNotFoundError(name)
        for status in listed:
            found[status.getPath().toString()] = f"{status.getLen()}:{status.getModificationTime()}"
    return sorted(found.items())


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def run(spark: SparkSession, options: Options) -> DataFrame:
    """Grammar rows of all files' sequences, numbered in order of file and place.

    A sequence's grammar is kept by its content and the options that build it, in one table for each set of options:
    one job over all files builds what isn't there yet, equal sequences once; a forced run builds all.
    """
    ship(spark)
    os.makedirs(options.output, exist_ok=True)
    began = datetime.datetime.now(datetime.timezone.utc).isoformat()
    chosen = {k: v for k, v in asdict(options).items() if k in BUILDING and k != "sequence_indices"}
    mark = hashlib.sha1(json.dumps(chosen, sort_keys=True).encode()).hexdigest()[:20]
    store = os.path.join(os.path.abspath(options.output), "grammars", mark)
    files = [path for path, _ in files_of(spark, options.inputs)]
    read = grammar.numbered(fasta.read_fasta(spark, files, options.skip_ns).select("source", "seq_id", "dna"), "source", "seq_id")
    seqs = read.select(F.col("number").alias("seq_id"), "source", "dna", F.sha2("dna", 256).alias("content"))
    if options.sequence_indices is not None:
        seqs = fasta.select_sequences(seqs, options.sequence_indices).withColumn("seq_id", F.col("ordinal")).drop("ordinal")
    seqs = keep(seqs)
    one = seqs.groupBy("content").agg(F.min("seq_id").alias("seq_id"), F.min_by("dna", "seq_id").alias("dna"), F.min_by("source", "seq_id").alias("source"))
    known = exists(spark, os.path.join(store, "_SUCCESS")) and not options.force_rerun
    todo = keep(one.join(spark.read.parquet(store).select("content"), "content", "left_anti") if known else one)
    built_now = sorted(r.source for r in todo.select("source").distinct().collect())
    if built_now or not known:
        made = build(todo.select("seq_id", "dna"), options)
        made = grammar.simplify(made) if options.simplify else made
        made = made.join(todo.select("seq_id", "content"), "seq_id").select("content", "symbols", "rules")
        made.write.mode("append" if known else "overwrite").parquet(store)
    grammars = seqs.select("seq_id", "content").join(spark.read.parquet(store), "content").select("seq_id", "symbols", "rules")
    for kind in options.outputs:
        extension = {"text": "txt", "repeats": "tsv", "stats": "stats.txt"}.get(kind, kind)
        lines = export.lines_for(grammars, kind, **(options.for_graph(kind) if kind in GRAPHS else {}))
        export.write_lines(lines, os.path.join(options.output, f"grammar.{extension}"))
    with open(os.path.join(options.output, "metadata.json"), "w", encoding="utf-8") as out:
        json.dump({"options": asdict(options), "started": began, "ended": datetime.datetime.now(datetime.timezone.utc).isoformat(), "status": "completed", "inputs": files, "checkpoint": store, "built": built_now}, out, indent=2)
    return grammars


def load_metadata(output: str) -> dict:
    with open(os.path.join(output, "metadata.json"), encoding="utf-8") as f:
        return json.load(f)


def info(grammars: DataFrame) -> DataFrame:
    """A row for each grammar: sizes, rules, depth, assembly index."""
    return grammar.compression_stats(grammars).join(grammar.sequence_assembly_index(grammars), "seq_id")


def convert(spark: SparkSession, source: str, path: str) -> None:
    """A JSON grammar in another format, chosen by the path's extension."""
    ship(spark)
    grammars = fasta.read_grammar_json(spark, source).select(F.lit(0).cast("long").alias("seq_id"), "symbols", "rules")
    export.export_grammar(grammars, path)


def top_gfa(spark: SparkSession, source: str, path: str, n: int) -> None:
    """The n longest rules of a JSON grammar, with what they use, as GFA."""
    ship(spark)
    grammars = fasta.read_grammar_json(spark, source).select(F.lit(0).cast("long").alias("seq_id"), "symbols", "rules")
    export.write_lines(export.gfa_top_lines(grammars, n), path)


FORMATS = ("text", "gfa", "dot", "fasta", "graphml", "repeats")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Builds and exports grammars of DNA sequences.")
    p.add_argument("inputs", nargs="+")
    p.add_argument("--output", default="run")
    for name, default in (("kmer-size", 2), ("min-rule-usage", 2), ("max-rule-count", None), ("chunk-size", 0), ("max-memory-mb", 1024), ("graph-max-depth", None)):
        p.add_argument(f"--{name}", type=int, default=default)
    for name in ("reverse-aware", "adaptive-chunking", "streaming", "use-lcg", "auto-tune-lcg", "force-rerun", *(f"output-{k}" for k in FORMATS), "stats"):
        p.add_argument(f"--{name}", action="store_true")
    for name, target in (("keep-ns", "skip_ns"), ("graph-no-terminals", "graph_terminals"), ("graph-no-usage", "graph_usage"), ("graph-no-depth-colors", "graph_depth_colors")):
        p.add_argument(f"--{name}", dest=target, action="store_false")
    p.add_argument("--sequence-indices", type=lambda s: [int(x) for x in s.split(",")])
    return p


def main(argv: list[str] | None = None) -> None:
    given = vars(parser().parse_args(argv))
    wanted = [k for k in FORMATS if given.pop(f"output_{k}")]
    outputs = ["json", *wanted, *["stats"] * given.pop("stats")]
    run(SparkSession.builder.getOrCreate(), Options(**given, outputs=outputs))


if __name__ == "__main__":
    main()
