"""Tolerant reading of model answers with VARIANT: no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemolake.functions.core import let, strip

# Fixed value: the wrapper some models put around JSON.
FENCE = r"(?s)^```(?:json|JSON)?\s*\n?(.*?)\n?```$"


def strip_fence(answer: Column) -> Column:
    text = strip(answer)
    return F.when(F.regexp_like(text, F.lit(FENCE)), strip(F.regexp_extract(text, FENCE, 1))).otherwise(text)


WIDEST = {"list": r"(?s)\[.*\]", "object": r"(?s)\{.*\}"}


def read_json(answer: Column, shapes: tuple[str, ...] = ("list", "object")) -> Column:
    """VARIANT of the whole text, else of the widest [...] or {...} inside it, in the order of `shapes`, else null."""
    return let(
        strip_fence(answer),
        lambda t: F.coalesce(
            F.try_parse_json(t), *[F.try_parse_json(F.regexp_extract(t, WIDEST[shape], 0)) for shape in shapes]
        ),
    )


def is_object(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))


def parse_items(answer: Column) -> Column:
    """array<variant> of the objects in an answer; a lone object becomes one element; empty when none."""
    none = F.expr("CAST(array() AS array<variant>)")

    def items(v: Column) -> Column:
        many = F.try_variant_get(v, "$", "array<variant>")
        return F.coalesce(F.when(is_object(v), F.array(v)).otherwise(F.filter(many, is_object)), none)

    return F.coalesce(let(read_json(answer), items), none)


def text_field(item: Column, name: str) -> Column:
    """The field as stripped text; null when absent, null or blank."""
    return F.nullif(strip(F.try_variant_get(item, f"$.{name}", "string")), F.lit(""))


def number_field(item: Column, name: str, default: float | None, lo: float, hi: float) -> Column:
    got = F.coalesce(F.try_variant_get(item, f"$.{name}", "double"), F.lit(default).cast("double"))
    return F.when(got.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), got)))


def list_field(item: Column, name: str) -> Column:
    """A JSON list, or a comma-separated string, as stripped non-empty strings."""
    many = F.try_variant_get(item, f"$.{name}", "array<string>")
    joined = F.split(F.try_variant_get(item, f"$.{name}", "string"), ",")
    clean = F.filter(F.transform(F.coalesce(many, joined), strip), lambda x: x != "")
    return F.coalesce(clean, F.array().cast("array<string>"))
