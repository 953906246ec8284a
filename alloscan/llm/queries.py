"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from alloscan.llm import (decontaminate, interpolated_lm, jaccard_forest, language_id, main_text, personal_data, piece_codec,
                          quality_hosts, repeat_cutter, secret_markov, slot_negatives, spelling_variants, toxicity)
from alloscan.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_quality_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_hosts.verdicts(table(spark, sf_dir, "documents"))


def op3_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_forest.join(table(spark, sf_dir, "documents"))


def op4_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_lm.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_secret_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_markov.digest(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.scan(table(spark, sf_dir, "documents"))


def op11_repeat_cutter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_cutter.digest(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.group(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_slot_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slot_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_quality_hosts": op2_quality_hosts,
    "op3_jaccard_forest": op3_jaccard_forest,
    "op4_interpolated_lm": op4_interpolated_lm,
    "op5_secret_markov": op5_secret_markov,
    "op6_toxicity": op6_toxicity,
    "op7_decontaminate": op7_decontaminate,
    "op8_main_text": op8_main_text,
    "op9_piece_codec": op9_piece_codec,
    "op10_personal_data": op10_personal_data,
    "op11_repeat_cutter": op11_repeat_cutter,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_slot_negatives": op13_slot_negatives,
}

ORACLES: dict[str, str] = {
    "op2_quality_hosts": quality_hosts.ORACLE_SQL,
    "op7_decontaminate": decontaminate.ORACLE_SQL,
    "op13_slot_negatives": slot_negatives.ORACLE_SQL,
}
