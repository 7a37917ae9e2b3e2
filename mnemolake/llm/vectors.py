"""What the two vector operators share: valid vectors, bounded samples, matrices from Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, and no component null, NaN or infinite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def matrix(vectors: pd.Series, width: int, dtype=np.float64) -> np.ndarray:
    """Rows of a matrix; shorter vectors are filled with zeros, which changes no product or distance."""
    sizes = np.fromiter(map(len, vectors), np.int64, len(vectors))
    out = np.zeros((len(vectors), width), dtype)
    if len(vectors):
        out[np.arange(width)[None, :] < sizes[:, None]] = np.concatenate([np.asarray(v, dtype) for v in vectors])
    return out


def width_of(table: DataFrame, column: str = "embedding") -> int:
    return table.agg(F.max(F.size(column))).first()[0] or 0


def sample(table: DataFrame, rows: int, column: str = "embedding") -> np.ndarray:
    """At most `rows` vectors, those of smallest hash, for fitting an index on the driver."""
    width = width_of(table, column)
    some = table.select(column).orderBy(F.xxhash64(column)).limit(rows).toPandas()
    return matrix(some[column], width)


def in_blocks(left: DataFrame, right: DataFrame, keys: list[str], left_rows: int, right_rows: int, left_id: str, right_id: str):
    """Both tables with the columns l and r, so that rows with equal keys meet once in a group (keys, l, r) that holds at
    most about `left_rows` and `right_rows` of them. A hot key becomes many groups."""
    sizes = left.groupBy(*keys).agg(F.ceil(F.count("*") / left_rows).alias("ls")).join(
        right.groupBy(*keys).agg(F.ceil(F.count("*") / right_rows).alias("rs")), keys
    )
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    first = left.join(sizes, keys).withColumn("l", part(left_id, "ls")).withColumn("r", upto("rs")).drop("ls", "rs")
    second = right.join(sizes, keys).withColumn("r", part(right_id, "rs")).withColumn("l", upto("ls")).drop("ls", "rs")
    return first, second
