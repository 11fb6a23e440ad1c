"""A training-corpus pipeline of five stages, each an operator of codeseam.llm.

Every stage reads what the one before wrote: toxic documents go, one document of
each near-duplicate group stays, personal data is pseudonymised, the sources are
mixed to their target weights, and the mix is encoded (and decoded again).  All
but the last return the columns of ``documents``; columns of any name pass through.
Null and empty texts stay until the near-duplicate stage makes one group of them,
and are not in the mix; null ids and sources stay null; rows equal in id and text
are copies; empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeseam.llm import bpe, mixing, pii, simhash, toxicity
from codeseam.llm.shared import documents, materialise


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the model of the table's labels rejects."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.drop_near_duplicates(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced, n_chars made anew."""
    return pii.pseudonymise(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time a document is taken."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Document columns with the text as decoded from the ids, the ids and their number."""
    out = bpe.encode_documents(docs)
    return out.select(*[F.col("decoded").cast("string").alias("text") if c == "text" else c for c in docs.columns], "ids", "n_tokens")


STAGES = [
    ("toxicity", toxic_out),
    ("simhash_near_duplicates", near_duplicates_out),
    ("pii_pseudonyms", pseudonyms),
    ("mixing", mixed),
    ("byte_level_bpe", encoded),
]

#: The stages fit a model, hash with XXH64 and run a tokenizer: no SQL says them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table's documents, each written before the next one reads it."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
