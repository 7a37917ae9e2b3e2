"""Exact set-similarity join: pairs of sets of a key whose Jaccard similarity reaches a threshold, without comparing all.

Two sets of sizes n and m with similarity j or more differ in at most d = (n + m)(1 - j) / (1 + j) elements. Elements are
dealt into d + 1 groups, so at least one group holds the same elements in both sets. Every set offers its groups as join keys
for each d that its size allows; sizes then filter, and a pair that meets in several groups counts in the first one only. What
is left, the candidates, is verified by the caller.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLACK = 1e-9  # for thresholds and products in doubles


def differing(n: Column, m: Column, floor: float) -> Column:
    """How many elements two sets of these sizes may differ in."""
    return F.floor((n + m) * F.lit((1 - floor) / (1 + floor)) + SLACK)


def _offers(sets: DataFrame, floor: float) -> DataFrame:
    """Per set, number of differing elements and group: the elements of that group, with those of all groups."""
    low = F.floor(F.col("size") * F.lit(1 - floor) - SLACK)
    high = F.floor(F.col("size") * F.lit((1 - floor) / floor) + SLACK)
    spread = sets.withColumn("differ", F.explode(F.sequence(F.greatest(low, F.lit(0)), F.greatest(high, F.lit(0)))))

    def group(i: Column) -> Column:
        own = F.filter("elements", lambda e: F.pmod(F.xxhash64(e), F.col("differ") + 1) == i)
        return F.array_join(own, "\x1f")

    groups = spread.withColumn("groups", F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("differ")), group))
    return groups.select("*", F.posexplode("groups").alias("group", "part"))


def candidates(left: DataFrame, right: DataFrame, keys: Sequence[str], floor: float, carry: tuple[Sequence[str], Sequence[str]]) -> DataFrame:
    """Pairs of `left` and `right` rows with equal `keys` that may reach the Jaccard similarity `floor` (above 0).

    Both sides have an array `elements` of distinct strings, in one order; empty sets are like nothing. `carry` names the
    columns of either side to hand on, as l_ and r_. A pair comes once per pair of rows; no pair that reaches `floor` is lost.
    """
    a, b = (
        _offers(df.select(*keys, "elements", F.size("elements").alias("size"), *own).filter("size > 0"), floor).select(
            *[F.col(k).alias(f"{side}_{k}") for k in keys], *[F.col(c).alias(f"{side}_{c}") for c in own],
            *[F.col(c).alias(f"{side}_{c}") for c in ("elements", "size", "differ", "groups", "group", "part")],
        )
        for df, own, side in ((left, carry[0], "l"), (right, carry[1], "r"))
    )
    same = F.lit(True)
    for name in (*keys, "differ", "group", "part"):
        same = same & (F.col(f"l_{name}") == F.col(f"r_{name}"))
    n, m = F.col("l_size"), F.col("r_size")
    fits = (
        (differing(n, m, floor) == F.col("l_differ")) & (m >= n * F.lit(floor) - SLACK) & (n >= m * F.lit(floor) - SLACK)
        & (F.array_position(F.zip_with("l_groups", "r_groups", lambda x, y: x == y), True) == F.col("l_group") + 1)
    )
    rest = [c for side in ("l", "r") for c in ("differ", "groups", "group", "part")]
    return a.join(b, same).filter(fits).drop(*[f"{side}_{c}" for side in ("l", "r") for c in set(rest)])


def jaccard_of(pairs: DataFrame) -> Column:
    """The similarity of a candidate pair, from the columns that `candidates` gives."""
    both = F.size(F.array_intersect("l_elements", "r_elements"))
    return both / (F.col("l_size") + F.col("r_size") - both)
