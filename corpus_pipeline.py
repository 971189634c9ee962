"""Cleaning pipeline over ``documents``; each stage applies one operator of ``bandwarden.llm``.

A stage takes (spark, docs, sf_dir), works on every row of ``docs`` and returns its result; ``run`` writes each result
as Parquet and reads it back as the next stage's ``docs``.  All stages but the last return the columns of ``docs``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwarden.llm import line_dedup, mixing, ngram_join, packing, quality_fm
from bandwarden.llm.tables import table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, trained on the labels of ``docs``, predicts to be good."""
    return quality_fm.accepted(docs, quality_fm.train(docs, table(spark, sf_dir, "labels")))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line matches; one that loses its last word goes."""
    return line_dedup.without_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near duplicates; documents without words stay.

    It is the row with the smallest id, ids that are null last, and then by text; one of the rows that repeat it stays.
    Texts of different groups stay even where they share an id or have none."""
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "node", "row")
    found = ngram_join.near_duplicate_groups(docs).where("node IS NOT NULL")
    first = found.groupBy("group").agg(F.min(order).alias("first")).select(F.col("first.row").alias("_row"))
    worded = F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = docs.where(worded).withColumn("_row", ngram_join.row_key()).join(first, "_row", "left_semi").dropDuplicates(["_row"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where(~worded))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document once for every pass over its source that takes it."""
    return mixing.mixed_documents(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and offset."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mixing),
    ("packing", sequence_packing),
]

#: The classifier is trained and the tokenizer is a file: SQL states neither; tests/llm restates every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
