"""The numbered queries and the pipeline, with DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import digest, jaccard, langid, lmscore, merkle, mixing, oracles, packing, preference, quality, repair, topk, toxicity, urlrules
from .common import held_out, table


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(rows, rows.where(F.pmod("vec_id", F.lit(20)) == 0))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.assess(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", predicted)


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.fingerprint(table(spark, sf_dir, "documents"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(table(spark, sf_dir, "documents").select("doc_id", "text"), held_out(F.col("doc_id"), 5, 1))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_documents(table(spark, sf_dir, "documents"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_pairs(preference.pairs_of(table(spark, sf_dir, "conversations")), "conv_id")


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    predicted = (F.col("score") >= 0.3).cast("int").alias("predicted")
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", predicted)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_topk, op2_toxicity, op3_mix, op4_url_filter, op5_language, op6_fingerprint, op7_lm_score, op8_jaccard, op9_pack, op10_preferences, op11_manifest, op12_repair, op13_quality, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": oracles.TOPK, "op3_mix": oracles.MIX, "op4_url_filter": oracles.URL_FILTER, "op10_preferences": oracles.PREFERENCES, "op11_manifest": oracles.MERKLE, "op12_repair": oracles.REPAIR}
