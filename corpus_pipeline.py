"""The corpus pipeline: language, line dedup, near dedup, personal data, packing. Each stage is written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineproof.llm import langid, lines, neardup, packing, pii
from lineproof.llm.shared import marked, stored

LEAST_SCORE = 0.35
SHINGLE_WORDS, SIMILARITY = 5, 80


def with_text(df: DataFrame, columns: list[str], text) -> DataFrame:
    """The columns of documents with a new text and its length."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without a letter or without a clear language go."""
    told = langid.identify_rows(docs)
    return told.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= LEAST_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat over documents stay in one of them."""
    return with_text(lines.dedup_lines(docs), docs.columns, F.col("kept_text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group; documents without an id or a word stay."""
    found = neardup.near_duplicates(docs, SHINGLE_WORDS, SIMILARITY)
    gone = stored(found.filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct(), "pipeline-gone")
    told = marked(docs, "doc_id", gone, "lineproof_asked")
    asked = told.filter("lineproof_asked").join(gone, F.col("doc_id").cast("long") == F.col("gone_id"), "left_anti")
    return told.filter("not lineproof_asked").unionByName(asked).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates in place of personal data."""
    return with_text(pii.pseudonymise(docs, pii.key_of(spark)), docs.columns, F.col("text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' tokens in training sequences."""
    return packing.pack(docs)


STAGES = [("language_id", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("pii", personal_data), ("packing", pack)]
#: Neither a trained language model nor a tokenizer can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
