"""The registered queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, langid, lm, metric_join, minhash, mixing, packing, rules, toxicity, warc
from .scratch import table

Query = Callable[[SparkSession, str], DataFrame]

#: The vocabulary file of op1; its folder is the installed package's.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(table(spark, sf_dir, "documents"))


def op3_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.digests(table(spark, sf_dir, "documents"))


def op4_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.digests(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_links(table(spark, sf_dir, "embeddings"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digests(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digests(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(table(spark, sf_dir, "pages"))


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = (op1_bpe, op2_packing, op3_line_rules, op4_recurrent_lm, op5_toxicity, op6_metric_join, op7_mixing, op8_language, op9_warc, op10_dart_minhash)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_rules": rules.ORACLE}
