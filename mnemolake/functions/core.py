"""Small Column combinators shared by the other function modules."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and hand it to `body` (lambda bodies are not hoisted by Spark)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def same_as_previous(items: Column, i: Column, field: str) -> Column:
    return (i > 0) & (F.get(items, i - 1)[field] == F.get(items, i)[field])


def first_per_key(items: Column) -> Column:
    """Of an array of structs (key, pos, ...) keep the element with the lowest pos per key."""
    return let(
        F.sort_array(items),
        lambda s: F.filter(s, lambda _, i: ~same_as_previous(s, i, "key")),
    )


def unnest(df: DataFrame, keep: Sequence, items: Column, pos: str, item: str) -> DataFrame:
    """One row per array element. The outer form keeps Spark from repeating a costly array in an inferred filter."""
    return df.select(*keep, F.posexplode_outer(items).alias(pos, item)).filter(F.col(pos).isNotNull())


def significant(value: Column, digits: int = 12) -> Column:
    """The value at `digits` significant digits: what ranks compare, so that only the order of summation cannot show."""
    size = F.floor(F.log10(F.abs(value)))
    scaled = F.round(F.abs(value) * F.pow(F.lit(10.0), digits - 1 - size)) * F.pow(F.lit(10.0), size - digits + 1)
    return F.when(value == 0, F.lit(0.0)).when(F.isnan(value), value).otherwise(F.signum(value) * scaled)


def hash_bucket(value: Column, modulus: int = 100) -> Column:
    """First four bytes of the md5 digest, big-endian, modulo `modulus`."""
    word = F.conv(F.substring(F.md5(value.cast("binary")), 1, 8), 16, 10).cast("bigint")
    return (word % F.lit(modulus)).cast("int")
