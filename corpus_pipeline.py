"""A training corpus from the documents table, in five stages.

Each stage works on everything its predecessor kept, and its decisions take effect: rejected documents go, repeated lines are
cut, one document of each group of near-duplicates stays, documents with benchmark items go, and the rest is packed.
All stages but the last return the columns of ``documents``.

A null text counts as empty where a stage reads it. Rows that repeat an id stay or go together, except that
contaminated rows are told apart by their text too. Further columns of the input are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floeframe.llm import decontaminate, line_dedup, ngram_join, packing, quality
from floeframe.llm.common import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
KEEP_FROM = 0.7


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good; the classifier learns from the labels outside the held-out remainder."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), model, name="_score").where(F.col("_score") >= KEEP_FROM).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated runs of lines; a document of which nothing is left goes."""
    out = line_dedup.dedup(docs.select(*COLUMNS))
    return (out.where((F.size("deleted_lines") == 0) | (F.col("text") != ""))
            .withColumn("n_chars", F.when(F.size("deleted_lines") == 0, F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*COLUMNS))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity of 0.8 or more; the smallest id stays."""
    groups = ngram_join.join(docs, size=5, num=80, den=100)
    others = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(others, "doc_id", "left_anti").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate.remove(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of permitted lengths, as token spans of documents."""
    counted = packing.token_counts(docs.select("doc_id", "text")).select("doc_id", "n_tokens")
    return packing.best_fit(Scratch(spark, "packing").store(counted, "tokens"))


STAGES = [("quality classifier", quality_stage), ("line dedup", line_stage), ("n-gram Jaccard join", near_duplicate_stage),
          ("benchmark decontamination", decontamination_stage), ("best-fit packing", packing_stage)]

#: The quality and packing stages cannot be put in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
