"""Queries of the corpus operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.ship import ship
from . import ball_kmeans, decontaminate, hard_negatives, line_dedup, minhash_dedup, mixing, quality_classifier, quality_rules, secret_scan, substring_dedup, suffix_dedup, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.drop_repeated_strings(_read(spark, sf_dir, "documents"), length=50)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.drop_repeated_windows(_read(spark, sf_dir, "documents"), window=20)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), folds=5, out=0, threshold=0.3)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_read(spark, sf_dir, "documents"), scope=200)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), share=1.5, epochs=2.0, seed=6)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), tolerance=0.2)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), folds=3, out=1, threshold=0.7)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents"), window=2, long_words=51)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_dedup.near_duplicates(_read(spark, sf_dir, "documents"), shingle_words=3, percent=85)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op11_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(_read(spark, sf_dir, "pages"), shard_rows=8192, roll_bytes=256 << 20, revisit_from=1000)
    return found.select("page_id", "payload_bytes", F.col("payload_sha1").alias("payload_digest"), "record_type", "refers_to")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90, scale=256)


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.report(ball_kmeans.cluster(_read(spark, sf_dir, "embeddings"), size=8, rounds=10, dim=64, scale=1024, seed=3))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    forms = {"op2_suffix_dedup": suffix_dedup, "op3_substring_dedup": substring_dedup, "op6_mixing": mixing, "op9_line_dedup": line_dedup, "op10_minhash_dedup": minhash_dedup}
    found = {name: module.SQL.format(documents="documents") for name, module in forms.items()}
    found["op11_warc_writer"] = warc.SQL.format(pages="pages")
    found["op12_hard_negatives"] = hard_negatives.SQL.format(embeddings="embeddings")
    found["op13_ball_kmeans"] = ball_kmeans.sql().format(embeddings="embeddings")
    return found
