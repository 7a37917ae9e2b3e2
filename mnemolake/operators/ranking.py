"""Fusing, boosting, cutting and re-ranking of recalled memories."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.functions.core import significant
from mnemolake.schemas import QUERY, SCOPE
from mnemolake.session import sized

# Channel weights and rank constant of the fusion.
RRF_WEIGHTS = {"bm25": 0.30, "vector": 0.40, "entity": 0.15, "graph": 0.15}
RRF_K = 60
OVER_FETCH = 4


def overfetch(top_k: int, recall: int = OVER_FETCH, channel: int = OVER_FETCH) -> dict[str, int]:
    """Rows each channel recalls: text and vector multiply twice, graph looks at twice the ids it returns."""
    wide = top_k * recall
    return {"bm25": wide * channel, "vector": wide * channel, "entity": wide, "graph": wide}


def _by_score(*partition: str) -> Window:
    return Window.partitionBy(*partition).orderBy(significant(F.col("score")).desc(), "memory_id")


def channel_rank(hits: DataFrame) -> DataFrame:
    """Rank from 0 inside each channel of each query."""
    return hits.withColumn("rank", F.row_number().over(_by_score(*QUERY, "channel")) - 1)


def _weight(weights: Mapping[str, float]) -> Column:
    table = F.create_map(*(F.lit(x) for name, w in weights.items() for x in (name, float(w))))
    return F.coalesce(F.try_element_at(table, F.col("channel")), F.lit(0.0))


def rrf_fuse(
    ranked: DataFrame, weights: Mapping[str, float] | None = None, k: int = RRF_K, requests: DataFrame | None = None,
) -> DataFrame:
    """Weighted reciprocal-rank fusion: sum of w / (k + rank + 1) over the channels that found a memory.

    `requests` (query_id, scope) may carry `weights` (map<string,double>) overriding single channels of a query.
    """
    table = {**RRF_WEIGHTS, **(weights or {})}
    channels = F.array(*[F.lit(c) for c in table])
    rows = ranked.filter(F.coalesce(F.col("memory_id"), F.lit("")) != "").withColumn("_w", _weight(table))
    if requests is not None:
        own = requests.select(*QUERY, F.col("weights").alias("_own"))
        rows = rows.join(own, QUERY, "left").withColumn(
            "_w", F.coalesce(F.try_element_at("_own", F.col("channel")), F.col("_w"))
        )
    place = F.array_position(channels, F.col("channel"))
    return (
        rows.filter(F.col("_w") > 0)
        .groupBy("query_id", *SCOPE, "memory_id")
        .agg(
            F.sum(F.col("_w") / (k + F.col("rank") + 1)).alias("score"),
            F.min_by("channel", place).alias("source_channel"),
            F.sort_array(F.collect_set("channel")).alias("channels"),
        )
    )


def concat_fuse(ranked: DataFrame) -> DataFrame:
    """Without a fuser: best score per memory and the channel it came from."""
    best = F.struct(significant(F.col("score")).alias("s"), F.col("rank") * -1, F.col("channel"))
    return ranked.groupBy("query_id", *SCOPE, "memory_id").agg(
        F.max("score").alias("score"), F.max_by("channel", best).alias("source_channel")
    )


def union_fuse(outputs: list[DataFrame]) -> DataFrame:
    out = outputs[0]
    for more in outputs[1:]:
        out = out.unionByName(more)
    return out


def _only(table: DataFrame, ranked: DataFrame) -> DataFrame:
    """Rows of a per-memory table that the ranked list names: few of many, found without shuffling the table."""
    named = sized(ranked.select(*SCOPE, "memory_id").distinct())
    return table.join(named, [*SCOPE, "memory_id"], "left_semi")


def signal_boost(ranked: DataFrame, signals: DataFrame) -> DataFrame:
    """score x time decay x (1 + importance); a missing signal counts as 1 and 0."""
    given = _only(
        signals.select(*SCOPE, "memory_id", F.col("decay").alias("_d"), F.col("importance").alias("_i")), ranked
    )
    factor = F.coalesce("_d", F.lit(1.0)) * (1 + F.coalesce("_i", F.lit(0.0)))
    joined = ranked.join(given, [*SCOPE, "memory_id"], "left")
    return joined.withColumn("score", F.col("score") * factor).drop("_d", "_i")


def rerank(hits: DataFrame) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(_by_score(*QUERY)) - 1)


def checked_topk(k: int) -> int:
    """A request asks for 1 to 100 memories; anything else is refused, never cut."""
    if not 1 <= k <= 100:
        raise ValueError(f"top_k must be from 1 to 100, not {k}")
    return k


def final_topk(ranked: DataFrame, k: int = 10) -> DataFrame:
    return rerank(ranked).filter(F.col("rank") < checked_topk(k))


def cross_rerank(ranked: DataFrame, scores: DataFrame, k: int | None = None) -> DataFrame:
    """Re-sort by an external pair score (query_id, scope, memory_id, pair_score); without one the own score stays."""
    joined = ranked.join(scores.select(*QUERY, "memory_id", "pair_score"), [*QUERY, "memory_id"], "left")
    out = rerank(joined.withColumn("score", F.coalesce("pair_score", "score")).drop("pair_score"))
    return out if k is None else out.filter(F.col("rank") < k)


def pair_scores(pairs: DataFrame, model) -> DataFrame:
    """Score (query, text) pairs with `model(queries, texts) -> scores`, batch by batch."""

    @F.pandas_udf("double")
    def score(query: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(model(query.tolist(), text.tolist()), dtype="float64"))

    return pairs.select(*QUERY, "memory_id", score("query", "text").alias("pair_score"))


def mmr_order(relevance: np.ndarray, vectors: list, k: int, lam: float) -> list[tuple[int, float]]:
    """Greedy choice of at most k rows: relevance against the highest similarity to what is already chosen."""
    n = len(relevance)
    width = next((len(v) for v in vectors if v is not None and len(v)), 0)
    unit = np.zeros((n, max(width, 1)))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == width and width:
            unit[i] = v
    length = np.linalg.norm(unit, axis=1, keepdims=True)
    unit = np.divide(unit, length, out=np.zeros_like(unit), where=length > 0)
    nearest = np.full(n, -np.inf)  # highest similarity to the chosen rows, sign kept
    free = np.ones(n, dtype=bool)
    out: list[tuple[int, float]] = []
    while len(out) < min(k, n):
        penalty = np.maximum(nearest, 0.0)  # a negative similarity does not help a candidate
        gain = np.where(free, np.round(lam * relevance - (1 - lam) * penalty, 12), -np.inf)
        i = int(np.argmax(gain))
        shown = lam * relevance[i] - (1 - lam) * nearest[i] if out else lam * relevance[i]
        out.append((i, float(shown)))
        free[i] = False
        nearest = np.maximum(nearest, unit @ unit[i])
    return out


def mmr_rerank(hits: DataFrame, vectors: DataFrame, k: int | None = None, lam: float = 0.7) -> DataFrame:
    """Diversity re-ranking. Hits per query are already cut to a top list, so a group is small by construction.

    The input order (score down, id) settles ties; the score stays, `mmr_score` and the new rank are added.
    """
    have = _only(vectors.select(*SCOPE, F.col("mem_cell_id").alias("memory_id"), "embedding"), hits)
    joined = rerank(hits).select("query_id", *SCOPE, "memory_id", "score", "rank").join(
        have, [*SCOPE, "memory_id"], "left"
    )

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", kind="stable").reset_index(drop=True)
        picked = mmr_order(pdf["score"].to_numpy(float), list(pdf["embedding"]), len(pdf) if k is None else k, lam)
        out = pdf.iloc[[i for i, _ in picked]].drop(columns="embedding")
        return out.assign(mmr_score=[s for _, s in picked], rank=range(len(picked)))

    schema = (
        "query_id string, tenant_id string, user_id string, memory_id string, score double, rank int,"
        "mmr_score double"
    )
    columns = ["query_id", *SCOPE, "memory_id", "score", "rank", "embedding"]
    return joined.select(*columns).groupBy(*QUERY).applyInPandas(choose, schema)
