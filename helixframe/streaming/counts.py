"""Structured Streaming: additive k-mer counts, and grammars that grow chunk by chunk."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import bounded
from ..functions.dna import _codes
from ..operators.repair import GRAMMAR, RULES, repair

CHUNK = "seq_id long, idx int, start long, owned int, dna string"


def write_chunks(seqs: DataFrame, path: str, size: int, right: int) -> None:
    """Files of chunks for a stream: ``size`` owned bases and ``right`` of context after them."""
    from ..operators.kmers import pieces

    part = pieces(seqs, right, size=size)
    part.select("seq_id", F.floor(F.col("start") / size).cast("int").alias("idx"), "start", F.col("owned").cast("int").alias("owned"), F.col("dna").cast("string").alias("dna")).write.parquet(path)


def read_chunks(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(CHUNK)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def stream_kmer_counts(chunks: DataFrame, k: int) -> DataFrame:
    """kmer, n over a stream of chunks; a k-mer belongs to the chunk it starts in, so chunks add up."""
    last = F.least(F.col("owned"), F.length("dna") - k + 1)
    kmers = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(F.col("dna"), i, F.lit(k)))
    return chunks.where(last > 0).select(F.explode(kmers).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> None:
    """Reads all that is there; each batch replaces the table (complete) or is added to it, once even after a restart."""

    def sink(batch: DataFrame, number: int) -> None:
        target = path if mode == "complete" else f"{path}/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()


GROWN = "seq_id long, chunks int, symbols array<long>, rules array<struct<rule_id:long,symbols:array<long>,usage_count:long,pair_count:long>>"
STATE = "chunks int, symbols array<long>, left array<long>, right array<long>, used array<long>, counted array<long>, waiting array<struct<idx:int,dna:string>>"


def apply_rules(symbols: list[int], rules: list[tuple[int, int]], used: list[int]) -> list[int]:
    """Replaces the pairs of known rules, in order of their making."""
    for r, (a, b) in enumerate(rules):
        out, i = [], 0
        while i < len(symbols):
            if i + 1 < len(symbols) and symbols[i] == a and symbols[i + 1] == b:
                out.append(4 + r)
                used[r] += 1
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols = out
    return symbols


def grow(state: tuple, dna: str, least: int, budget: int | None) -> tuple:
    """A grammar (chunks, symbols, left, right, used, counted) with one more chunk; at most ``budget`` new rules, by default a hundredth of the symbols and 20 at least."""
    chunks, symbols, left, right, used, counted = (list(x) if isinstance(x, (list, tuple)) else x for x in state)
    symbols = list(symbols) + apply_rules(_codes(dna).tolist(), list(zip(left, right)), used)
    most = max(len(symbols) // 100, 20) + 1 if budget is None else budget
    symbols, rules = repair(symbols, least, most, first=len(left))
    for a, b, n, c in rules:
        left.append(a)
        right.append(b)
        used.append(n)
        counted.append(c)
    return chunks + 1, symbols, left, right, used, counted


def stream_grammars(chunks: DataFrame, least: int = 2, budget: int | None = None) -> DataFrame:
    """Grammar rows of each sequence so far, after every batch; chunks have no context.

    Chunks are appended in order of idx: one that comes before an earlier one waits in the state for it, and one that
    comes again is left out.
    """

    def step(key, frames, state):
        *now, waiting = state.get if state.exists else (0, [], [], [], [], [], [])
        held = {int(w[0]): w[1] for w in waiting}
        for frame in frames:
            held.update((int(i), dna[: int(owned)]) for i, dna, owned in zip(frame["idx"], frame["dna"], frame["owned"]))
        while now[0] in held:
            now = grow(tuple(now), held[now[0]], least, budget)
        state.update((*now, [(i, dna) for i, dna in sorted(held.items()) if i >= now[0]]))
        n, symbols, left, right, used, counted = now
        rules = [{"rule_id": r, "symbols": [int(a), int(b)], "usage_count": int(u), "pair_count": int(c)} for r, (a, b, u, c) in enumerate(zip(left, right, used, counted))]
        yield pd.DataFrame({"seq_id": [key[0]], "chunks": [n], "symbols": [[int(s) for s in symbols]], "rules": [rules]})

    return chunks.groupBy("seq_id").applyInPandasWithState(step, GROWN, STATE, "update", "NoTimeout")


def finish(symbols: list[int], rules: list[dict], least: int = 2) -> tuple[list[int], list[dict]]:
    """A grown grammar with pairs replaced, without a budget, until none of its final symbols is left ``least`` times."""
    symbols, new = repair(symbols, least, first=len(rules))
    return symbols, rules + [{"rule_id": len(rules) + r, "symbols": [a, b], "usage_count": n, "pair_count": c} for r, (a, b, n, c) in enumerate(new)]


def finalize(grown: DataFrame, least: int = 2, most_rules: int | None = None) -> DataFrame:
    """Grammar rows from the table of a finished stream: each sequence's last state, finished; single uses put in place, and the least used rules beyond ``most_rules``."""
    from ..operators.grammar import simplify

    def run(batches):
        for batch in bounded(batches):
            found = [finish(s or [], r or [], least) for s, r in zip(batch.column("symbols").to_pylist(), batch.column("rules").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("seq_id"), pa.array([s for s, _ in found], pa.list_(pa.int64())), pa.array([r for _, r in found], RULES)], ["seq_id", "symbols", "rules"])

    last = grown.groupBy("seq_id").agg(F.max_by(F.struct("symbols", "rules"), "chunks").alias("x"))
    finished = last.select("seq_id", "x.symbols", "x.rules").mapInArrow(run, GRAMMAR)
    return simplify(finished, most_rules=most_rules)
