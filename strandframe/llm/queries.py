"""The registered queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm import bpe, chat, fingerprint, jaccard_join, langid, mixing, quality, sharding, sql, toxicity, url_filter
from strandframe.llm._shared import table


def bpe_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Token counts and digests of ids and decoded text, for each document."""
    return bpe_digests(table(spark, sf_dir, "documents"), vocabulary or bpe_vocabulary())


def bpe_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return bpe.round_trip(docs.select("doc_id", "text"), vocabulary).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and its edited text, and their likeness; null texts are empty, ties in doc_id follow the text."""
    return fingerprint.compare_with_edits(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of each document; rows of one doc_id with different texts are documents of their own."""
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of each document; null texts have no words, null sources are one host."""
    return quality.judged(table(spark, sf_dir, "documents")).drop("host_docs", "host_rate")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of each document; a null doc_id belongs to no fold, so its held_out is null."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    held_out = toxicity.fold(F.col("doc_id"), toxicity.FOLDS) == toxicity.HELD_OUT
    return toxicity.scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of each page; null URLs have an empty host and path and are allowed."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judged(pages).select("page_id", "host", "path", "rule", "verdict", "confidence")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document; a null doc_id belongs to no fold, so its held_out is null."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs)
    held_out = langid.fold(F.col("doc_id"), langid.FOLDS) == langid.HELD_OUT
    return langid.identified(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, target and words taken of each document; null texts have size 0, null sources are one source, the last."""
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document; null texts have the header's size and the crc of nothing."""
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op10_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks as text, ``start-end`` joined by commas."""
    pairs = chat.neighbours(chat.conversations(table(spark, sf_dir, "conversations")))
    out = chat.formatted(pairs)
    flat = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(c)
    return out.select(*[flat(c) if c.endswith("_mask") else c for c in out.columns])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe, op2_fingerprints, op3_jaccard_join, op4_quality_rules, op5_toxicity, op6_url_filter, op7_language, op8_source_mix, op9_sharding, op10_preference_format)
}
ORACLE_SQL: dict[str, str] = {"op3_jaccard_join": sql.OP3, "op4_quality_rules": sql.OP4, "op10_preference_format": sql.OP10}
