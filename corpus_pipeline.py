"""A training-data pipeline over ``documents``: each stage calls one operator of ``lintlake.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm import bpe, jaccard_join, line_dedup, mixing, quality, queries
from lintlake.llm.common import shared_folder, table, unused

ORACLE_SQL = None  # trained scores, hash families and token ids have no SQL; tests hold them against brute force


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    weights = queries.quality_weights(spark, docs, sf_dir)
    (score,) = unused(docs, "score")
    return quality.score(docs, weights, out=score).where(F.col(score) >= queries.THRESHOLD).drop(score)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out lines that nearly repeat an earlier one; a document left without text goes."""
    return line_dedup.without_duplicates(docs)


def join_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return jaccard_join.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat, cut or drop documents so that the sources meet their target weights."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add each document's token ids (as bytes) and their number."""
    path, pattern = queries.tokenizer()
    return bpe.encode(docs, path, pattern).withColumn("n_tokens", (F.length("ids") / 4).cast("long"))


STAGES = [
    ("quality_classifier", classify),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", join_near),
    ("mixing_sources", mix_sources),
    ("byte_bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
