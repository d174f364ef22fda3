"""The operators as registered queries over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, bwt, classifier, html, matroska, mixing, rules, simhash, substring, warc
from .common import table


def op1_substring_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removals(table(spark, sf_dir, "documents"))


def op2_bwt_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt.removals(table(spark, sf_dir, "documents"))


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(table(spark, sf_dir, "pages"))


def op4_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digests(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op7_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.decisions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digests(table(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op10_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.decisions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_substring_log, op2_bwt_merge, op3_warc_index, op4_matroska, op5_simhash, op6_byte_bpe, op7_ordinal_quality, op8_mixing, op9_main_text, op10_decision_list]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op8_mixing": mixing.SQL}
