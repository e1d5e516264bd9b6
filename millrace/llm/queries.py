"""The registered query of each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, lm_score, mixing, packing, pii, quality_classifier, quality_rules, sharding, simhash, toxicity
from .common import documents, text_or_empty


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_quality(documents(spark, sf_dir), _labels(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(documents(spark, sf_dir).select("doc_id", "text"))
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words"]
    return judged.select("doc_id", *[f"__mr_rules.{m}" for m in measures])


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(documents(spark, sf_dir))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), with_ids=False)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(documents(spark, sf_dir)).drop("found")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(documents(spark, sf_dir), _labels(spark, sf_dir))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    laid = sharding.resharded(documents(spark, sf_dir))
    text = text_or_empty()
    return laid.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit(sharding.LAW).alias("law"),
        F.col("__mr_shard").alias("shard"),
        F.col("__mr_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        sharding.old_shard_of(F.col("source")).alias("old_shard"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir)).drop("rid")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_quality_rules, op3_simhash, op4_packing, op5_mixing, op6_pii, op7_toxicity, op8_sharding, op9_exact_dedup, op10_lm_score)}
