"""The registered queries of the operators, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillbridge.llm import (
    bpe,
    chat,
    decontam,
    filteraudit,
    importance,
    jaccard,
    langid,
    linededup,
    merkle,
    sharding,
    tokencounts,
    topk,
    toxicity,
)

NEAREST, QUERY_EVERY = 20, 20
SHARDS = [f"shard-{n:03d}" for n in range(64)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.resample(docs, importance.target_ids(_table(spark, sf_dir, "labels")))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.digests(bpe.decode(encoded, ranks))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = linededup.dedup_lines(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "text", "lines_removed")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return tokencounts.section_counts(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(_table(spark, sf_dir, "documents"), "doc_id", SHARDS)
    return placed.select("doc_id", "source", "n_chars", "shard")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = jaccard.similar(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "n_shingles", "component_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = langid.held_out(F.col("doc_id"))
    filters = langid.fit(docs.filter(~held_out).select("text", "lang"))
    out = langid.predict(docs.select("doc_id", "text"), filters)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("th")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), QUERY_EVERY, NEAREST)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = toxicity.label_categories(_table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, toxicity.fit_chain(docs, labels, toxicity.CATEGORIES))
    flag = F.col("p_toxic") >= toxicity.THRESHOLD
    return scored.select("doc_id", "p_poor", "p_toxic", flag.alias("toxic"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_test(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted_digests(_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_importance_resampling": op1_importance_resampling,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_line_dedup": op3_line_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_sharding": op5_sharding,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_language_id": op7_language_id,
    "op8_decontamination": op8_decontamination,
    "op9_exact_topk": op9_exact_topk,
    "op10_toxicity": op10_toxicity,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_filter_audit": op12_filter_audit,
    "op13_chat_format": op13_chat_format,
}


def _sharding_sql() -> str:
    slots = ", ".join(map(str, sharding.fill_table(SHARDS).tolist()))
    digest = "md5(coalesce(CAST(doc_id AS VARCHAR), ''))"
    slot = f"(CAST('0x' || substr({digest}, 1, 15) AS BIGINT) % {sharding.SLOTS} + 1)"
    return f"""
WITH filled AS (SELECT [{slots}] AS slots)
SELECT doc_id, source, n_chars, 'shard-' || lpad(CAST(slots[{slot}] AS VARCHAR), 3, '0') AS shard
FROM documents, filled"""


ORACLES = {
    "op3_line_dedup": linededup.oracle(),
    "op5_sharding": _sharding_sql(),
    "op6_jaccard_join": jaccard.oracle(),
    "op9_exact_topk": topk.oracle(QUERY_EVERY, NEAREST),
    "op11_merkle_manifest": merkle.oracle(),
    "op12_filter_audit": filteraudit.oracle(),
    "op13_chat_format": chat.oracle(),
}
