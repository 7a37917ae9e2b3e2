"""A corpus pipeline over `documents`: quality, near copies, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm import bpe, mixing, quality, secrets, simhash
from mnemolake.llm.registry import small_batches
from mnemolake.session import materialize, ship_package

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of `documents`; whatever else came along is left behind."""
    ship_package(spark)
    small_batches(spark)
    return docs.select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant, fitted on their labels, does not reject."""
    return quality.keep_good(_documents(spark, docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.dedup(_documents(spark, docs))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in the text replaced."""
    return secrets.redact(_documents(spark, docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate and its draw say."""
    return mixing.mix(_documents(spark, docs))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, token ids (little-endian, 32 bits each), their number, and the SHA-256 of the decoded text."""
    encoded = _documents(spark, docs).select("doc_id", "source", bpe.tokens_udf()(F.col("text")).alias("e"))
    return encoded.select("doc_id", "source", "e.n_tokens", "e.ids", "e.decoded_sha256")


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", dedup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("tokens", tokens_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each over the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = materialize(docs, "stage")
    return docs
