"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm import (
    bpe, clustering, debruijn, divergence, embedding_dedup, jaccard_join, language_id,
    line_dedup, lz_fingerprint, mixing, quality, suffix_index, token_counts,
)
from lintlake.llm.catalog import ORACLE, QUERIES, query
from lintlake.llm.common import table

RANKS = "byte_bpe_multi_50k.tiktoken"


def tokenizer() -> tuple[str, str]:
    """Path of the rank file and the splitting pattern."""
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


@query("op1_line_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.duplicate_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "removed_lines")


@query("op2_lz_fingerprints")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.edited_pairs(table(spark, sf_dir, "documents"))


@query("op3_embedding_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", "kept")


@query("op4_debruijn_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = debruijn.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.col("sha256").alias("kept_sha256"))


@query("op5_byte_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer()
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern)
    slim = encoded.select("doc_id", "ids")
    return bpe.decode(slim, path, pattern).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op6_jaccard_join")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_links", "component_id", "kept")


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits a document: a replacement, a deletion and an insertion at places its id decides."""
    path, pattern = tokenizer()
    n = F.coalesce(F.length("text"), F.lit(0))
    at = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), n + 1).cast("int")
    change = lambda start, stop, insert: F.struct(start.alias("start"), stop.alias("stop"), insert.alias("insert"))
    edits = F.array(
        change(at(1), at(1) + 40, F.substring("text", 1, 30)),
        change(at(2), at(2) + 25, F.lit("")),
        change(at(3), at(3), F.lit(" one more 42 words ")),
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", edits.alias("edits"))
    return token_counts.count_edits(docs, path, pattern).select(
        "doc_id", "n_tokens", "edited_tokens", F.length("edited_text").cast("long").alias("edited_chars"), "encoded_again"
    )


@query("op8_suffix_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_index.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("sha256").alias("kept_sha256"))


def quality_weights(spark: SparkSession, documents: DataFrame, sf_dir: str):
    """Weights learnt from labelled rows outside the held-out fold."""
    chosen = quality.sample(documents, table(spark, sf_dir, "labels"), ~held_out())
    return quality.train(chosen)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


THRESHOLD = 0.3


@query("op9_quality_scores")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    weights = quality_weights(spark, documents, sf_dir)
    scored = quality.score(documents.select("doc_id", "text"), weights)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@query("op10_mixed_sources")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shards")


@query("op11_centroid_clusters", clustering.cluster_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


@query("op12_source_divergence", divergence.DIVERGENCE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


@query("op13_language_id")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language_id.train(documents, ~held_out())
    found = language_id.predict(documents, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


__all__ = ["ORACLE", "QUERIES"]
