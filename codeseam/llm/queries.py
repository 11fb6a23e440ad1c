"""The queries of this subpackage, by their registered names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeseam.llm import bpe, lm, media, mixing, pii, secrets, simhash, tokencount, topk, toxicity
from codeseam.llm.shared import documents


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op1(documents(spark, sf_dir))


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.op2(documents(spark, sf_dir))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op3(documents(spark, sf_dir))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op4(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.op5(documents(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op6(documents(spark, sf_dir))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.op7(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op8(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op9(documents(spark, sf_dir))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.op10(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_lm, op3_bpe, op4_simhash, op5_token_counts, op6_pii, op7_media, op8_toxicity, op9_mixing, op10_topk)}
ORACLE_SQL: dict[str, str] = {"op10_topk": topk.ORACLE}
