"""Vector similarity as Column expressions, in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemolake.functions.core import let


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _usable(a: Column, b: Column) -> Column:
    return a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def ip(a: Column, b: Column) -> Column:
    return F.when(_usable(a, b), dot(a, b)).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    ratio = let(norm(a) * norm(b), lambda length: F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0)))
    return F.when(_usable(a, b), ratio).otherwise(F.lit(0.0))


def neg_l2(a: Column, b: Column) -> Column:
    gap = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.when(_usable(a, b), -F.sqrt(_sum(gap))).otherwise(F.lit(0.0))


def composite_sim(jaccard: Column, cos: Column, has: Column, w_jaccard: float = 0.4, w_cosine: float = 0.6) -> Column:
    mixed = (F.lit(w_jaccard) * jaccard + F.lit(w_cosine) * F.coalesce(cos, F.lit(0.0))) / (w_jaccard + w_cosine)
    return F.when(has, mixed).otherwise(jaccard)
