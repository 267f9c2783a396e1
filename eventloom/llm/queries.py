"""Driver-facing queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import chat, curve_packing, exact_dedup, hard_negatives, language, licenses, mixing, pieces, pii, quality, simhash, spelling, token_files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op1(spark, _table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op2(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.op3(spark, _table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op4(spark, _table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op5(spark, _table(spark, sf_dir, "conversations"))


def op6_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_packing.op6(spark, _table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op7(spark, _table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op8(spark, _table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.op9(spark, _table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.op10(spark, _table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.op11(spark, _table(spark, sf_dir, "embeddings"))


def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.op12(spark, _table(spark, sf_dir, "documents"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.op13(spark, _table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_quality_rules, op3_language_id, op4_pii, op5_chat_format,
        op6_curve_packing, op7_simhash_near_dedup, op8_license_scan, op9_exact_dedup, op10_token_files,
        op11_hard_negatives, op12_spelling_groups, op13_sentencepiece,
    )
}
ORACLES = {"op5_chat_format": chat.ORACLE, "op8_license_scan": licenses.ORACLE, "op9_exact_dedup": exact_dedup.ORACLE, "op11_hard_negatives": hard_negatives.ORACLE, "op12_spelling_groups": spelling.ORACLE}
