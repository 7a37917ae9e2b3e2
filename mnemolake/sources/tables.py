"""JSON and Parquet in, Parquet snapshots out."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.schemas import CELL, INGEST_REQUEST


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Nested ingest requests as JSON lines, with a fixed schema."""
    return spark.read.schema(INGEST_REQUEST).json(path)


def read_request_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(INGEST_REQUEST).json(path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CELL).parquet(path)


def write_snapshot(df: DataFrame, root: str, version: int, partition: str | None = "tenant_id") -> str:
    """Plain Parquet has no row update, so a changed table is the next snapshot directory `v=N`."""
    path = f"{root}/v={version}"
    writer = df.write.mode("overwrite")
    if partition and partition in df.columns:
        writer = writer.partitionBy(partition)
    writer.parquet(path)
    return path


def latest_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The newest snapshot: only its directory is read, as `v` is a partition of the root."""
    every = spark.read.option("basePath", root).parquet(root)
    newest = every.agg(F.max("v")).first()[0]
    return every.filter(F.col("v") == newest).drop("v")


def spread(df: DataFrame) -> DataFrame:
    """On a single machine, where a test table is one file, its rows are dealt out to the cores once. On a cluster the scan
    is split by `spark.sql.files.maxPartitionBytes`, and no text is shuffled for it."""
    context = df.sparkSession.sparkContext
    return df.repartition(context.defaultParallelism) if re.fullmatch(r"local(\[.*\])?", context.master) else df
