"""Mixing sources to target weights, with DataFrame functions only.

Capped water-filling: each source may be used at most ``max_epochs`` times.
Sources whose share would pass that are clamped there and the excess goes to
the others in proportion to their weights, round by round, until no share is
too large.  Each document is then taken a whole number of times and, by a
seeded choice, once more for the fraction that remains.

Null texts have size 0; a null source is a source of its own, last in order; texts of
any length count whole; an empty table gives an empty result.  Rows that repeat a
doc_id are documents of their own, with or without one: those of one size are one item
of the choice, which says how many of them get the extra copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.grammar import numbered
from .common import Scratch, n_words

#: Up to so many bytes of names and numbers the table of targets is broadcast; above, it is joined by shuffle.
MOST_BROADCAST = 8_000_000


def water_level(sources: DataFrame, total: float) -> float:
    """The level for which sum(min(cap, level * weight)) is ``total``; infinite if the caps sum to less.

    Only two sums and a count come to the driver in each round.
    """
    level, clamped = 0.0, -1
    while True:
        at_cap = F.col("cap") <= F.lit(level) * F.col("weight")
        row = sources.agg(
            F.coalesce(F.sum(F.when(at_cap, F.col("cap"))), F.lit(0.0)).alias("full"),
            F.coalesce(F.sum(F.when(~at_cap, F.col("weight"))), F.lit(0.0)).alias("weight"),
            F.count(F.when(at_cap, 1)).alias("n"),
        ).first()
        if row.n == clamped:
            return level
        if not row.weight:
            return float("inf")
        level, clamped = (total - row.full) / row.weight, row.n


def cycled_weights(sources: DataFrame, weights: tuple) -> DataFrame:
    """Adds the weight of each source: ``weights`` in turn, by the code points of the source, null last; sources are numbered by ranges."""
    placed = numbered(sources.withColumn("last", F.col("source").isNull()), "last", "source")
    return placed.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("number") % len(weights) + 1).cast("int"))).drop("last", "number")


def mix_sources(docs: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, seed: int = 7, block_rows: int = 256) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies.

    Within a source, documents are dealt by a seeded hash to blocks of about
    ``block_rows``, so a source of any size is spread over tasks.  A block is
    walked from its largest document to its smallest; a document gets its extra
    copy if the words still owed exceed a seeded part of its size, so each
    block, and the source, ends near its target.
    """
    with Scratch(docs.sparkSession) as scratch:
        sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
        sized = scratch.keep(sized.groupBy("source", "doc_id", "size").agg(F.count("*").alias("rows")))
        sources = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("items"))
        sources = scratch.keep(cycled_weights(sources, weights).withColumn("cap", F.col("source_size") * float(max_epochs)))
        all_words, n_bytes = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64), F.lit(0))).first()
        level = water_level(sources, share * all_words)
        target = F.least(F.col("cap"), F.lit(level) * F.col("weight"))
        rate = F.when(F.col("target") >= F.col("cap"), F.lit(float(max_epochs))).otherwise(F.col("target") / F.col("source_size"))
        plan = sources.withColumn("target", target).withColumn("rate", rate).select(F.col("source").alias("of"), "source_size", "target", "rate", F.ceil(F.col("items") / block_rows).alias("blocks"))
        plan = F.broadcast(plan) if n_bytes <= MOST_BROADCAST else plan
        chance = (F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "size"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        dealt = sized.join(plan, F.col("source").eqNullSafe(F.col("of"))).withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.col("blocks")))
        item = F.struct((-F.col("size")).alias("less"), chance.alias("chance"), F.col("doc_id").alias("doc_id"), F.col("rows").alias("rows"))
        blocks = dealt.groupBy("source", "block").agg(F.array_sort(F.collect_list(item)).alias("items"), *(F.first(c).alias(c) for c in ("source_size", "target", "rate")))
        whole, part = F.floor("rate"), F.col("rate") - F.floor("rate")

        def step(acc, x):
            size = -x["less"]
            owed = acc["owed"] + size * x["rows"] * part
            due = F.ceil((owed - x["chance"] * size) / size)
            more = F.when((size > 0) & (due > 0), F.least(due, x["rows"])).otherwise(0).cast("long")
            return F.struct((owed - more * size).cast("double").alias("owed"), F.concat(acc["more"], F.array(more)).alias("more"))

        more = F.aggregate("items", F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<long>").alias("more")), step, lambda acc: acc["more"])
        rows = blocks.withColumn("x", F.explode(F.arrays_zip("items", more.alias("more"))))
        each = rows.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("x.items.rows"))))
        copies = (whole + F.when(F.col("k") <= F.col("x.more"), 1).otherwise(0)).cast("long").alias("copies")
        return scratch.result(each.select(F.col("x.items.doc_id").alias("doc_id"), "source", (-F.col("x.items.less")).alias("size"), "source_size", "target", copies))
