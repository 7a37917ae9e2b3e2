"""Exact best-of comparisons of two large sides inside a key, without emitting the pairs.

Both sides are split into blocks of bounded size inside each key (by a hash of the row id), every block of one
side meets every block of the other in one task as two matrices, and only the best rows per block pair leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.session import sized


def _blocks(df: DataFrame, keys: Sequence[str], size: int, name: str) -> DataFrame:
    """Per key the number of blocks its rows need."""
    n = F.ceil(F.count(F.lit(1)) / size).cast("bigint")
    return df.groupBy(*keys).agg(n.alias(name))


def blocked(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str,
    best: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, block: int = 4096,
) -> DataFrame:
    """Apply `best(left block, right block)` to all block pairs of a key."""
    keys = list(keys)
    # One slim row per key, counted first, so that neither side is gathered by key before it is split.
    shape = sized(_blocks(left, keys, block, "_ln").join(_blocks(right, keys, block, "_rn"), keys))

    def placed(df: DataFrame, own: str, other: str, row_id: str, mine: str, theirs: str) -> DataFrame:
        spread = F.explode_outer(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1))
        return (
            df.join(shape, keys)
            .withColumn(mine, F.pmod(F.xxhash64(row_id), F.col(own)))
            .withColumn(theirs, spread)
            .drop("_ln", "_rn")
        )

    group = [*keys, "_lb", "_rb"]
    a = placed(left, "_ln", "_rn", left_id, "_lb", "_rb").groupBy(*group)
    other = placed(right, "_rn", "_ln", right_id, "_rb", "_lb")
    # Fresh column identities: both sides may stem from the same table.
    b = other.select(*[F.col(c).alias(c) for c in other.columns]).groupBy(*group)
    return a.cogroup(b).applyInPandas(best, schema)
