"""Order-dependent work per key that survives a key holding a third of all rows.

A plain window or group sends one key to one task. Here every key above `rows_per_chunk` rows is cut into
ordered chunks by splitters taken from a hash sample of its own order values, so the chunk of a row is a
deterministic function of the row. Ranks, previous values and running sums are computed per chunk and corrected
by one small row per chunk. Keys below the limit keep the plain window: one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemolake.session import materialize, scratch_path

ROWS_PER_CHUNK = 1_000_000
MAX_CHUNKS = 256
MAX_LEVELS = 8  # of 256 chunks each, far beyond any table; more means that order values are not unique
SAMPLES_PER_CHUNK = 64


def _splitters(df: DataFrame, hot: DataFrame, keys: Sequence[str], spec: Column, min_rows: int, limit: int) -> DataFrame:
    """Per hot key at most MAX_CHUNKS - 1 evenly spaced order values out of a hash sample of its rows."""
    chunks = F.least(F.lit(MAX_CHUNKS), F.ceil(F.col("_o_n") / limit)).cast("int")
    wanted = chunks * max(SAMPLES_PER_CHUNK, min_rows)
    sized = hot.select(
        *keys, chunks.alias("_o_chunks"), F.greatest(F.lit(1), F.floor(F.col("_o_n") / wanted)).cast("bigint").alias("_o_step")
    )
    sample = (
        df.select(*keys, spec.alias("_o_at"))
        .join(sized, list(keys))
        .filter(F.pmod(F.xxhash64("_o_at"), F.col("_o_step")) == 0)
    )
    picked = sample.groupBy(*keys).agg(
        F.sort_array(F.collect_list("_o_at")).alias("_o_sorted"), F.first("_o_chunks").alias("_o_chunks")
    )
    return picked.select(
        *keys,
        F.transform(
            F.sequence(F.lit(1), F.col("_o_chunks") - 1),
            lambda i: F.get("_o_sorted", F.floor(i * F.size("_o_sorted") / F.col("_o_chunks")).cast("int")),
        ).alias("_o_cuts"),
    )


def split_hot_keys(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], rows_per_chunk: int = ROWS_PER_CHUNK,
    min_rows: int = 1,
) -> tuple[DataFrame, bool]:
    """Add `_chunk` (bigint, from 0 without holes per key) and tell whether any key was cut.

    `order` holds ascending value Columns and ends in a unique id. A chunk that is still too large is cut again,
    by MAX_CHUNKS each time, so no chunk grows with its key.
    """
    spec = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    level, at = 0, [*keys, "_chunk"]
    out = df.withColumn("_chunk", F.lit(0).cast("bigint"))
    while True:
        counts = out.groupBy(*(at if level else keys)).agg(F.count(F.lit(1)).alias("_o_n"))
        hot = counts.filter(F.col("_o_n") > rows_per_chunk)
        if hot.isEmpty():
            break
        if level == MAX_LEVELS:
            raise ValueError(f"a chunk of {list(keys)} stays above {rows_per_chunk} rows: its order values repeat")
        hot = hot if level else hot.withColumn("_chunk", F.lit(0).cast("bigint"))
        cuts = _splitters(out, hot, at, spec, min_rows, rows_per_chunk)
        inner = F.coalesce(F.size(F.filter("_o_cuts", lambda c: c <= F.col("_o_at"))), F.lit(0))
        out = (
            out.join(cuts, at, "left")
            .withColumn("_o_at", spec)
            .withColumn("_chunk", F.col("_chunk") * MAX_CHUNKS + F.greatest(inner, F.lit(0)))
            .drop("_o_cuts", "_o_at")
        )
        level += 1
    if not level:
        return out, False
    dense = F.row_number().over(Window.partitionBy(*keys).orderBy("_chunk")).cast("bigint") - 1
    numbers = out.select(*at).distinct().withColumn("_o_dense", dense)
    return out.join(numbers, at).withColumn("_chunk", F.col("_o_dense")).drop("_o_dense"), True


def _with_carry(df: DataFrame, keys: Sequence[str], carry: Column, name: str, over: Callable) -> DataFrame:
    """Join back one value per (key, chunk) derived from the chunks before it."""
    per_chunk = df.groupBy(*keys, "_chunk").agg(carry.alias("_o_v"))
    before = Window.partitionBy(*keys).orderBy("_chunk")
    per_chunk = per_chunk.select(*keys, "_chunk", over(F.col("_o_v"), before).alias(name))
    return df.join(per_chunk, [*keys, "_chunk"])


def _earlier_sum(value: Column, window) -> Column:
    return F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _last_known(value: Column, window) -> Column:
    return F.lag(value).over(window)


def rank_in_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str, rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """`row_number` per key, starting at 1."""
    cut_up, hot = split_hot_keys(df, keys, order, rows_per_chunk)
    if not hot:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    ranked = _with_carry(cut_up, keys, F.count(F.lit(1)), "_o_before", _earlier_sum)
    return ranked.withColumn(out, F.row_number().over(local) + F.col("_o_before")).drop("_chunk", "_o_before")


def previous_in_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, out: str,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """`lag(value)` per key."""
    cut_up, hot = split_hot_keys(df, keys, order, rows_per_chunk)
    if not hot:
        return df.withColumn(out, F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))
    return _chunked_lag(cut_up, keys, order, value, out).drop("_chunk")


def _chunked_lag(cut_up: DataFrame, keys, order, value: Column, out: str) -> DataFrame:
    spec = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    carried = _with_carry(cut_up, keys, F.max_by(value, spec), "_o_carry", _last_known)
    first = F.row_number().over(local) == 1
    return carried.withColumn(out, F.when(first, F.col("_o_carry")).otherwise(F.lag(value).over(local))).drop("_o_carry")


def runs_in_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column,
    starts: Callable[[Column, Column], Column], out: str, rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Number the runs of a key from 0; `starts(previous, current)` says where a new run begins."""
    cut_up, hot = split_hot_keys(df, keys, order, rows_per_chunk)
    if not hot:
        w = Window.partitionBy(*keys).orderBy(*order)
        flag = F.coalesce(starts(F.lag(value).over(w), value), F.lit(False)).cast("int")
        running = w.rowsBetween(Window.unboundedPreceding, 0)
        return (
            df.withColumn("_o_flag", flag)
            .withColumn(out, F.sum("_o_flag").over(running).cast("bigint"))
            .drop("_o_flag")
        )
    lagged = _chunked_lag(cut_up, keys, order, value, "_o_prev")
    flagged = lagged.withColumn("_o_flag", F.coalesce(starts(F.col("_o_prev"), value), F.lit(False)).cast("bigint"))
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    carried = _with_carry(flagged, keys, F.sum("_o_flag"), "_o_before", _earlier_sum)
    return carried.withColumn(out, F.sum("_o_flag").over(local) + F.col("_o_before")).drop(
        "_chunk", "_o_flag", "_o_prev", "_o_before"
    )


Step = Callable[[tuple, pd.DataFrame, "bytes | None"], "tuple[pd.DataFrame, bytes]"]


def _with_state(done: pd.DataFrame, key: dict, state: bytes, names: Sequence[str]) -> pd.DataFrame:
    """The rows of a chunk and one more with the state. That one is a copy of the last row, so that columns keep their types:
    as objects a number takes several times its memory."""
    if len(done):
        return pd.concat([done.assign(_state=None), done.iloc[[-1]].assign(**key, _state=[state])], ignore_index=True)
    return pd.DataFrame([{name: None for name in names} | key | {"_state": state}], columns=list(names), dtype=object)


def sequential_fold(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step, ddl: str,
    rows_per_chunk: int = 200_000,
) -> DataFrame:
    """Run an inherently sequential `step(key, ordered rows, state) -> (rows, state)` over every key.

    All keys run in parallel. A key above `rows_per_chunk` is fed chunk by chunk: one round per chunk number, the
    pickled state travelling in a small table between rounds, so no task ever holds more than one chunk of a key.
    """
    schema = T.StructType.fromDDL(ddl)
    names = list(order)
    chunks, hot = split_hot_keys(df, keys, [F.col(c) for c in names], rows_per_chunk)

    if not hot:

        def whole(key, pdf):
            return step(key, pdf.sort_values(names, kind="stable"), None)[0]

        return df.groupBy(*keys).applyInPandas(whole, schema)

    carrying = T.StructType([*schema.fields, T.StructField("_state", T.BinaryType())])
    key_fields = [schema[k] for k in keys]
    state_schema = T.StructType([*key_fields, T.StructField("_state", T.BinaryType())])

    def chunk_step(key, rows, states):
        if rows.empty:
            return pd.DataFrame(columns=carrying.names)
        before = states["_state"].iloc[0] if len(states) else None
        done, state = step(key, rows.sort_values(names, kind="stable").drop(columns="_chunk"), before)
        return _with_state(done, dict(zip(keys, key)), state, carrying.names)

    chunks = materialize(chunks, "chunks")
    spark, root = df.sparkSession, scratch_path(df.sparkSession, "rounds")
    states = spark.createDataFrame([], state_schema)
    for number in range(chunks.agg(F.max("_chunk")).first()[0] + 1):
        part = chunks.filter(F.col("_chunk") == number)
        both = part.groupBy(*keys).cogroup(states.groupBy(*keys)).applyInPandas(chunk_step, carrying)
        path = f"{root}/round={number}"
        both.write.mode("overwrite").parquet(path)
        states = spark.read.schema(carrying).parquet(path).filter("_state IS NOT NULL").select(*keys, "_state")
    done = spark.read.schema(carrying).parquet(root)
    return done.filter("_state IS NULL").select(*schema.names)
