"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without blanks at both ends and with A-Z in lower
case.  A run is a table of key hashes, bucketed and sorted by them, with the number
of documents that hold the key and the last of them.  A new batch is merge-anti-joined
with the runs, bucket by bucket and without an exchange: its fresh keys become a run of
level 0, so a key is in one run only.  Its known keys are kept as changes to
the runs.  ``fan_in`` runs of a level are put together to one of the next.

Null and empty texts are one empty line.  Rows that repeat a doc_id are one
document when documents are counted, and each is cleaned.  A null doc_id is
smaller than any other.  Lines and texts of any length are taken whole; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, LOWER, UPPER, Scratch

HASHES = ["h1", "h2"]


def line_key(line) -> F.Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def lines_of(text) -> F.Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_hash(key) -> F.Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


class LineRuns:
    """The runs of one corpus, in a scratch folder."""

    def __init__(self, scratch: Scratch, fan_in: int = 3):
        self.scratch, self.fan_in, self.levels, self.changes = scratch, fan_in, [[]], []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _known(self, mine: DataFrame, how: str) -> list[DataFrame]:
        """The rows of a bucketed batch that are in a run, by run (left_semi), or in none (left_anti)."""
        if how == "left_semi":
            return [mine.join(run.select(*HASHES).hint("merge"), HASHES, how) for run in self.runs()]
        for run in self.runs():
            mine = mine.join(run.select(*HASHES).hint("merge"), HASHES, how)
        return [mine]

    def add(self, batch: DataFrame) -> None:
        """Adds a batch of (doc_id, h1, h2): its fresh keys as a run, and its known ones as changes."""
        mine = batch.groupBy(*HASHES).agg(F.count_distinct("doc_id").alias("docs"), F.max("doc_id").alias("last"))
        mine = self.scratch.keep_sorted(mine, *HASHES)
        if self.runs():
            self.changes += [self.scratch.keep(known) for known in self._known(mine, "left_semi")]
            mine = self.scratch.keep_sorted(self._known(mine, "left_anti")[0], *HASHES)
        self.levels[0].append(mine)
        self.compact()

    def compact(self) -> None:
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fan_in:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self.scratch.keep_sorted(union(self.levels[k]), *HASHES))
                self.levels[k] = []

    def merged(self) -> DataFrame:
        """h1, h2, docs, last of every key: each run's rows, with the changes to them."""
        if not self.changes:
            return union(self.runs())
        changes = union(self.changes).groupBy(*HASHES).agg(F.sum("docs").alias("more"), F.max("last").alias("later"))
        changes = self.scratch.keep_sorted(changes, *HASHES)
        docs = (F.col("docs") + F.coalesce("more", F.lit(0))).alias("docs")
        return union([run.join(changes.hint("merge"), HASHES, "left").select(*HASHES, docs, F.greatest("last", "later").alias("last")) for run in self.runs()])


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fan_in: int = 3) -> DataFrame:
    """All columns of ``docs`` as a struct ``row``, with n_lines, n_dropped and text_kept.

    Keys of ``min_chars`` code points or more, found in ``min_docs`` documents
    or more, lose all their lines but those in the largest doc_id holding them.
    """
    spark: SparkSession = docs.sparkSession
    with Scratch(spark) as scratch:
        keys = F.filter(F.transform(lines_of(F.col("text")), line_key), lambda k: F.length(k) >= min_chars)
        held = docs.select("doc_id", F.explode(F.array_distinct(F.transform(keys, key_hash))).alias("h"))
        held = held.select("doc_id", "h.*", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"))
        held = scratch.keep(held, "batch")
        runs = LineRuns(scratch, fan_in)
        for b in range(batches):
            runs.add(held.where(F.col("batch") == b).drop("batch"))
        common = scratch.keep(runs.merged().where(F.col("docs") >= min_docs).select(*HASHES, "last"))
        drops = held.join(common, HASHES).where(~F.col("doc_id").eqNullSafe(F.col("last")))
        drops = drops.groupBy(F.col("doc_id").alias("of")).agg(F.collect_set(F.struct(*HASHES)).alias("gone"))
        drops = scratch.result(drops)
    whole = docs.select("doc_id", F.struct("*").alias("row"))
    joined = whole.join(drops.hint("merge"), F.col("doc_id").eqNullSafe(F.col("of")), "left")
    lines = lines_of(F.col("row.text"))
    # The keys that go are dealt by their hash, so that a text of very many lines looks at few for each.
    n = F.greatest(F.lit(1), F.least(F.lit(4096), F.size("gone") / 16)).cast("int")
    dealt = F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.filter("gone", lambda g: F.pmod(g["h2"], n) == b))

    def stays(line):
        key = line_key(line)
        place = F.pmod(F.xxhash64(F.lit(1), key), F.size("dealt")).cast("int")
        return (F.length(key) < min_chars) | ~F.array_contains(F.get("dealt", place), key_hash(key))

    kept = F.when(F.col("gone").isNull(), lines).otherwise(F.filter(lines, stays))
    counted = joined.withColumn("dealt", F.when(F.col("gone").isNotNull(), dealt)).select("row", lines.alias("lines"), kept.alias("kept"))
    return counted.select("row", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text_kept"))
