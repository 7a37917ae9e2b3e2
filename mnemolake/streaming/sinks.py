"""Writing micro-batches to several sinks, with retries, dead letters and a ledger that a replay reads."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

LEDGER = "batch bigint, sink string, attempts int, state string, error string"


@dataclass(frozen=True)
class Retry:
    """How often a write is tried, and the seconds before the second try, which grow by `factor` up to `most`."""

    attempts: int = 3
    wait: float = 1.0
    factor: float = 2.0
    most: float = 60.0

    def pause(self, failed: int) -> float:
        return min(self.most, self.wait * self.factor ** (failed - 1))


class Ledger:
    """One row for each batch and sink that came to an end: `done`, or `dead` after the last try. Rows are written once."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _place(self, batch: int, sink: str) -> str:
        return f"{self.path}/batch={batch}/sink={sink}"

    def ended(self, batch: int, sink: str):
        """The row of a batch and sink, or None."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self._place(batch, sink) + "/_SUCCESS")
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return None
        return self.spark.read.schema("attempts int, state string, error string").parquet(self._place(batch, sink)).first()

    def end(self, batch: int, sink: str, attempts: int, state: str, error: str | None) -> None:
        row = self.spark.createDataFrame([(attempts, state, error)], "attempts int, state string, error string")
        row.coalesce(1).write.mode("overwrite").parquet(self._place(batch, sink))

    def rows(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.path)


def deliver(
    rows: DataFrame, number: int, sink: str, write: Callable[[DataFrame, int], None], ledger: Ledger, retry: Retry = Retry(),
    sleep: Callable[[float], None] = time.sleep,
) -> tuple[int, str | None]:
    """Write one sink's rows of a batch: (tries, error or None).

    A failing write is tried again after a pause. A batch and sink that ended before is not written again: a replay gets the
    same answer from the ledger. `write` must replace what an earlier try of the same batch has left."""
    before = ledger.ended(number, sink)
    if before is not None:
        return before["attempts"], before["error"]
    error = None
    for attempt in range(1, retry.attempts + 1):
        try:
            write(rows, number)
        except Exception as failure:  # noqa: BLE001  any failure of a sink counts as a try
            error = (str(failure).strip().splitlines() or [type(failure).__name__])[0][:500] or type(failure).__name__
            if attempt < retry.attempts:
                sleep(retry.pause(attempt))
        else:
            ledger.end(number, sink, attempt, "done", None)
            return attempt, None
    ledger.end(number, sink, retry.attempts, "dead", error)
    return retry.attempts, error


def to_folder(path: str) -> Callable[[DataFrame, int], None]:
    """A sink of one directory per batch, which a further try overwrites."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
