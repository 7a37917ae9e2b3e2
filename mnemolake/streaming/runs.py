"""Running a stream to the end of its input, with sinks a replayed batch overwrites."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from mnemolake.session import ROCKSDB, scratch_path


def run_available(
    stream: DataFrame, write: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None,
) -> StreamingQuery:
    """Process all available input; `write(batch, id)` must overwrite what an earlier try of the same id wrote."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    running = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "stream"))
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    running.awaitTermination()
    return running


def to_table(stream: DataFrame, mode: str = "append", path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Write every micro-batch to its own directory `batch=N` and read the whole back."""
    spark = stream.sparkSession
    root = path or scratch_path(spark, "sink")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")

    run_available(stream, write, mode, checkpoint)
    return spark.read.parquet(root)
