"""Scores, lifecycle states and decisions as Column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemolake.functions.core import let

# Signal of a feedback event that carries none of its own.
FEEDBACK_SIGNAL = {
    "explicit_confirm": 1.0,
    "positive": 0.3,
    "negative": -0.5,
    "correction": -2.0,
    "deletion_request": -10.0,
}


@dataclass(frozen=True)
class ScoreWeights:
    cqa: float = 0.25
    bve: float = 0.30
    trs: float = 0.25
    src: float = 0.20
    half_life_days: float = 30.0


@dataclass(frozen=True)
class FactThresholds:
    update: float = 0.85
    supersede: float = 0.93
    noop: float = 0.97


def age_days(moment: Column, now: Column) -> Column:
    gap = F.unix_micros(now.cast("timestamp")) - F.unix_micros(moment.cast("timestamp"))
    return F.greatest(F.lit(0.0), gap / F.lit(86_400_000_000.0))


def recency(age: Column, half_life_days: float = 30.0) -> Column:
    return F.exp(-math.log(2.0) * age / half_life_days) if half_life_days > 0 else F.lit(1.0)


def score_parts(
    age: Column, access: Column, strength: Column, n_sources: Column, text: Column | None = None,
    weights: ScoreWeights = ScoreWeights(),
) -> dict[str, Column]:
    """Content quality, behaviour, recency, sources and their weighted sum (6 places)."""
    length = F.length(F.coalesce(text, F.lit(""))) if text is not None else F.lit(0)
    cqa = F.least(length / 500.0, F.lit(1.0))
    bve = F.least(0.2 * F.coalesce(access, F.lit(0)) + 0.1 * F.coalesce(strength, F.lit(0.0)), F.lit(1.0))
    src = F.least(0.3 * F.coalesce(n_sources, F.lit(0)), F.lit(1.0))
    trs = recency(age, weights.half_life_days)
    total = weights.cqa * cqa + weights.bve * bve + weights.trs * trs + weights.src * src
    return {"cqa": cqa, "bve": bve, "trs": trs, "src": src, "composite": F.round(total, 6)}


def fsfm_score(age, access, strength, n_sources, text=None, weights: ScoreWeights = ScoreWeights()) -> Column:
    return score_parts(age, access, strength, n_sources, text, weights)["composite"]


def retention(age: Column, strength: Column, access: Column, s_base: float = 4.0) -> Column:
    scale = F.greatest(F.lit(0.1), s_base * F.greatest(F.lit(0.1), strength))
    used = F.least(F.lit(1.0), F.greatest(F.lit(0.0), access / 10.0))
    return F.exp(-F.greatest(F.lit(0.0), age) / scale) * (0.6 + 0.4 * used)


def compute_state(access: Column, age: Column) -> Column:
    return (
        F.when((access >= 5) | (age < 1.0), "ACTIVE")
        .when((access >= 2) | (age < 7.0), "WARM")
        .when(age < 90.0, "COLD")
        .otherwise("ARCHIVED")
    )


def signal_map(feedback_type: Column, value: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in FEEDBACK_SIGNAL.items() for x in pair))
    default = F.coalesce(F.try_element_at(table, feedback_type), F.lit(0.0))
    return F.when(F.coalesce(value, F.lit(0.0)) == 0.0, default).otherwise(value)


def decide(sim: Column, thresholds: FactThresholds = FactThresholds()) -> Column:
    return let(
        sim,
        lambda s: F.when(s >= thresholds.noop, "NOOP")
        .when(s >= thresholds.supersede, "SUPERSEDE")
        .when(s >= thresholds.update, "UPDATE")
        .otherwise("ADD"),
    )


def pick_phase(scope: Column, at: Column) -> Column:
    hour = F.hour(at)
    timed = (
        F.when((F.dayofweek(at) == 1) & hour.isin(5, 6), "rem")
        .when(hour.isin(3, 4), "deep")
        .otherwise("light")
    )
    return F.when(scope == "all", timed).otherwise(scope)
