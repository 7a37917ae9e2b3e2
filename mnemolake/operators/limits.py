"""Moving-window rate limit over event logs."""

from __future__ import annotations

import pickle
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.operators.ordered import runs_in_key, sequential_fold


class Limiter:
    """At most n accepted events in any trailing window; a refused event does not count. Times in microseconds."""

    def __init__(self, n: int, seconds: float) -> None:
        self.n, self.width, self.taken = n, int(seconds * 1_000_000), deque()

    def hit(self, at: int) -> bool:
        while self.taken and self.taken[0] <= at - self.width:
            self.taken.popleft()
        free = len(self.taken) < self.n
        if free:
            self.taken.append(at)
        return free


def moving_window_limit(
    events: DataFrame, key: str, ts: str, n: int = 120, seconds: float = 60, rows_per_chunk: int = 500_000,
) -> DataFrame:
    """key, event_id, accepted. A pause of a full window empties the limiter, so such pauses cut a key into
    independent runs; inside a run the state is at most n times."""
    slim = events.select(
        F.col(key).cast("string").alias("key"), "event_id", F.unix_micros(F.col(ts).cast("timestamp")).alias("at")
    )
    width = int(seconds * 1_000_000)
    runs = runs_in_key(
        slim, ["key"], [F.col("at"), F.col("event_id")], F.col("at"), lambda before, now: (now - before) >= width, "run"
    )

    def step(keys, pdf: pd.DataFrame, state: bytes | None):
        limiter = pickle.loads(state) if state else Limiter(n, seconds)
        accepted = np.fromiter((limiter.hit(int(a)) for a in pdf["at"].to_numpy()), dtype=bool, count=len(pdf))
        return pdf[["key", "run", "event_id"]].assign(accepted=accepted), pickle.dumps(limiter)

    done = sequential_fold(
        runs, ["key", "run"], ["at", "event_id"], step, "key string, run bigint, event_id bigint, accepted boolean",
        rows_per_chunk,
    )
    return done.drop("run")


def trailing_counts(events: DataFrame, key: str, ts: str, seconds: int = 60) -> DataFrame:
    """Events of the key in the trailing window, itself included: an upper bound of the limiter's load.

    Computed per (key, window-wide bucket) as a running sum: events of this bucket and the one before add one, those of the one
    before take it back a window later. So no window holds a whole key, and work goes with the rows, however dense they are.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    width = seconds * 1_000_000
    slim = events.select(F.col(key).cast("string").alias("key"), "event_id", at.alias("at"))
    bucket = F.floor(F.col("at") / width)
    own = slim.select("key", "event_id", "at", bucket.alias("bucket"), F.lit(1).alias("d"), F.lit(True).alias("own"))
    before = slim.select("key", F.lit(None).cast(slim.schema["event_id"].dataType).alias("event_id"), "at", (bucket + 1).alias("bucket"))
    steps = F.explode(F.array(F.struct(F.col("at"), F.lit(1).alias("d")), F.struct((F.col("at") + width).alias("at"), F.lit(-1).alias("d"))))
    gone = before.select("key", "event_id", "bucket", steps.alias("_s")).select(
        "key", "event_id", "_s.at", "bucket", "_s.d", F.lit(False).alias("own")
    )
    frame = Window.partitionBy("key", "bucket").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return own.unionByName(gone).withColumn("n", F.sum("d").over(frame)).filter("own").select("key", "event_id", "n")
