"""The corpus pipeline: five stages from documents to token digests.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but
the last return the columns of documents.  SQL can't express the first and the
third to fifth stages, so there is none; each is tested against brute force.

Further columns of any name go through the first four stages unchanged.  Rows without
a doc_id and rows that repeat are kept apart as each stage says; texts of any length
are taken whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm.bpe import digests
from helixframe.llm.common import Scratch, documents
from helixframe.llm.langid import UNKNOWN, predict, prototypes
from helixframe.llm.linededup import dedup_lines
from helixframe.llm.mixing import mix_sources
from helixframe.llm.neardup import near_duplicates
from helixframe.ship import ship

#: A document whose cosine with every language is below this is rejected; clean prose of a few words is above.
LEAST_SCORE = 0.05


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, null texts among them, or like no language; other rows stay as they are, repeated ones too."""
    ship(spark)
    languages, vectors = prototypes(docs)
    found = predict(docs, languages, vectors)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that many documents share, but for the last of them; n_chars follows the text.

    No row goes; null texts stay null, and rows that repeat a doc_id count as one document.
    """
    text = F.when(F.col("row.text").isNotNull(), F.col("text_kept"))
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(text).cast("long"))
    return dedup_lines(docs).select(row.alias("row")).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near duplicates; of rows with equal doc_id and text, one.

    Rows without words, or without a doc_id, are near no other and stay.
    """
    ship(spark)
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("of")).distinct()
    packed = docs.select("doc_id", F.struct("*").alias("row"))
    whole = packed.join(kept.hint("merge"), F.col("doc_id").eqNullSafe(F.col("of")), "left_semi")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("row.text"))
    before = F.lag("row.text").over(Window.partitionBy("doc_id").orderBy("row.text"))
    marked = whole.select("row", place.alias("place"), before.alias("before"))
    return marked.where((F.col("place") == 1) | ~F.col("before").eqNullSafe(F.col("row.text"))).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources meet their target weights; rows that repeat a doc_id get the copies of one, those without a doc_id too."""
    copies = mix_sources(docs).groupBy(F.col("doc_id").alias("of")).agg(F.max("copies").alias("copies"))
    packed = docs.select("doc_id", F.struct("*").alias("row"))
    joined = packed.join(copies.hint("merge"), F.col("doc_id").eqNullSafe(F.col("of"))).where("copies > 0")
    return joined.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of each row that is left, copies included; a null text is empty."""
    import public_tokenizers as tokenizers

    ship(spark)
    return digests(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("encode", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; a stage's table goes when the next is written."""
    docs, before = documents(spark, sf_dir), None
    for k, (_, stage) in enumerate(STAGES):
        scratch = Scratch(spark)
        found = stage(spark, docs, sf_dir)
        docs = scratch.keep(found) if k + 1 < len(STAGES) else scratch.result(found)
        if before:
            before.close()
        before = scratch
    return docs
