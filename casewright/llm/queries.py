"""Registered queries of the training-data operators, with the columns that their contracts name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.session import table

from . import decontam, divergence, hardneg, hmm, langid, linedup, mixing, neardup, pii, quality, secrets, simhash, urls


def _fold() -> Column:
    """crc32 of doc_id as text, modulo 5."""
    return F.crc32(F.col("doc_id").cast("string")) % 5


def _digest(spans: str, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of spans in their order, comma-joined; only of some kinds if named."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else F.col(spans)
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = secrets.KINDS[:3]
    return found.select("doc_id", *(_count(k).alias(f"n_{k}") for k in base), F.sha2(_digest("spans", base), 256).alias("base_sha256"), _digest("spans").alias("spans"), _count("model").alias("n_model"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(_fold() == 0, F.lit(False))
    found = langid.identify(docs, _fold() != 0)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = pii.BASE_KINDS
    return found.select("doc_id", *(_count(k).alias(f"n_{k}") for k in base), F.sha2(_digest("spans", base), 256).alias("base_sha256"), _digest("spans").alias("spans"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"), _fold() == 1)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linedup.dedup_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return hardneg.mine(rows, F.col("vec_id") % 100 == 0)


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_url_filter, op2_decontaminate, op3_quality_rules, op4_secret_scan, op5_mix_sources, op6_minhash_dedup, op7_language_id, op8_pii, op9_lm_score, op10_line_dedup, op11_source_divergence, op12_hard_negatives, op13_simhash_dedup)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_mix_sources": mixing.sql(), "op10_line_dedup": linedup.sql(), "op11_source_divergence": divergence.sql(), "op12_hard_negatives": hardneg.sql()}
