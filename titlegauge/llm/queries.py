"""The operators' queries over whole tables, with production parameters, and SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from titlegauge.llm import conversation_repair, decontaminate, fertility, fill_middle, hash_search, licenses, mixing_lm, near_dup, pii, repeats, secrets, source_mix, toxicity
from titlegauge.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_lm.contract_scores(table(spark, sf_dir, "documents"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.contract_spans(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.contract_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.contract_spans(table(spark, sf_dir, "documents"))


def op6_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality_by_fertility(table(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_sources(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.contract_digest(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_pairs(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.contract_digests(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.contract_reports(table(spark, sf_dir, "conversations"))


def op13_hash_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_search.contract_neighbours(table(spark, sf_dir, "embeddings"))


def all_queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_mixing_lm, op2_personal_data, op3_toxicity, op4_licenses, op5_secrets, op6_fertility, op7_source_mix, op8_near_duplicates, op9_repeated_passages, op10_decontamination, op11_fill_middle, op12_conversation_repair, op13_hash_search)}


def all_oracles() -> dict[str, str]:
    return {
        "op7_source_mix": source_mix.ORACLE,
        "op8_near_duplicates": near_dup.ORACLE,
        "op9_repeated_passages": repeats.ORACLE,
        "op10_decontamination": decontaminate.ORACLE,
        "op11_fill_middle": fill_middle.ORACLE,
        "op12_conversation_repair": conversation_repair.ORACLE,
    }
