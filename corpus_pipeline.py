"""Training-corpus pipeline over ``documents``: five stages, each applying one of the operators of oddsforge.llm to all
that its predecessor kept. Every stage's result is written as Parquet in the cluster's shared checkpoint folder and read again.

1. language_id: documents without a recognisable language go (no letters, or no language with half the posterior).
2. line_dedup: lines that stand in three documents or more stay only in the document of the largest id.
3. near_dedup: of each group of documents linked by a similarity of 0.8 on five-word shingles the smallest id stays.
4. decontaminate: documents that hold a benchmark passage go.
5. bpe: the documents that are left, encoded: doc_id, n_tokens, ids_sha256, decoded_sha256.

Defined results: null texts go in the first stage; of repeated rows (same id and text) near dedup keeps one; columns that
``documents`` has besides its own five are passed on unchanged by the first four stages; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsforge.llm import bpe, decontaminate, language, line_dedup, near_dedup
from oddsforge.llm.common import table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    pred = language.identify(docs)
    return pred.filter((F.col("lang_pred") != language.UND) & (F.col("score") >= 0.5)).select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their repeated lines."""
    kept = line_dedup.apply_keep(docs, line_dedup.keep_bitmaps(docs))
    row = F.col("row").withField("text", F.col("kept"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.char_length("kept").cast("long"))
    return kept.select(row.alias("row")).select("row.*")


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.keep_one(docs, near_dedup.near_groups(docs))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.without_leaks(docs, decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus in token ids, as digests."""
    return bpe.encoding_digest(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontaminate", decontaminate_benchmark),
    ("bpe", encode),
]

#: Trained language models and byte-pair ids are beyond SQL; tests/llm holds the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
