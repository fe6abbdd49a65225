"""From raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on every row that its
predecessor kept, and is written as parquet before the next one reads it.  All
stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import language_mixture, line_winnowing, packing, quality_ledger, simhash_bktree
from graphloom.llm.common import stage
from graphloom.llm.queries import held_out


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the latest policy of the quality ledger keeps."""
    text = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_gl_row"), F.col("text"))
    return quality_ledger.ledger(text).where(quality_ledger.passes()).select("_gl_row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose languages are determined; all, if none is labelled to learn from."""
    model = language_mixture.train(docs, ~F.coalesce(held_out(), F.lit(False)))
    return language_mixture.keep_determined(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that an earlier document has; those of which nothing is left go."""
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_gl_row"), "doc_id", "text")
    cut = line_winnowing.dedup_lines(row)
    some = cut.where((F.col("removed_chars") == 0) | (F.length(F.btrim("text", F.lit(" \t\n\x0b\f\r"))) > 0))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("removed_chars") > 0, F.length("text").cast("long")).otherwise(F.col("_gl_row.n_chars"))}
    return some.select(*(new.get(c, F.col(f"_gl_row.`{c}`")).alias(c) for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest doc_id, then of the smallest hash of its text.

    Rows are told apart by both, as an id may stand on several texts; rows without an id all stay.
    """
    has_id, mark = F.col("doc_id").isNotNull(), F.xxhash64("text")
    row = F.when(has_id, F.struct("doc_id", mark.alias("mark")))
    found = simhash_bktree.near_duplicates(docs.select(row.alias("row"), "text"), key="row")
    first = found.where(F.col("row") == F.col("component_id")).groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    keep = stage(first.select(F.col("row.doc_id").alias("_gl_id"), F.col("row.mark").alias("_gl_mark"), "n"), "near-keep")
    same = (F.col("doc_id") == F.col("_gl_id")) & (mark == F.col("_gl_mark"))
    kept = docs.where(has_id).join(keep.select("_gl_id", "_gl_mark").hint("shuffle_hash"), same, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
    if keep.where("n > 1").limit(1).count():  # repeated rows
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where(~has_id))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full token sequences with the sources in the proportions of the corpus."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), size=2048)


STAGES = [("quality", quality), ("language", language), ("lines", lines), ("near_copies", near_copies), ("pack", pack)]
#: Hashes and tokenizers of the last three stages are outside SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
