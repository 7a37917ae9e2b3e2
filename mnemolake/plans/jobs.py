"""The five composite jobs: tables in, tables out."""

from __future__ import annotations

import pickle
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.functions.scoring import FactThresholds, compute_state, fsfm_score, retention
from mnemolake.functions.text import extract_entities
from mnemolake.operators import extraction, facts, graph, ingest, lifecycle, ranking, recall, reports, scenes, store
from mnemolake.operators.ordered import sequential_fold
from mnemolake.schemas import QUERY, SCOPE
from mnemolake.session import materialize


# --- ingest -------------------------------------------------------------------------------------------------------


def first_claim(rows: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """The first row per key wins; a row with a null in its key claims nothing and stays."""
    rest = [c for c in rows.columns if c not in key]
    absent = F.lit(False)
    for name in key:
        absent = absent | F.col(name).isNull()
    won = rows.filter(~absent).groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return won.select(*key, "_r.*").select(*rows.columns).unionByName(rows.filter(absent))


CLAIM = [*SCOPE, "idempotency_key"]
CLAIMED = "tenant_id string, user_id string, idempotency_key string, request_id string, claimed_at bigint, holder string"


def claims(requests: DataFrame, held: DataFrame | None = None, hours: float = 24, rows_per_chunk: int = 200_000) -> DataFrame:
    """Idempotency claims of requests with a key: scope, idempotency_key, request_id, claimed_at, holder.

    In order of event_time and request_id, a request holds its key for `hours`; one that comes meanwhile repeats the
    holder's request, a later one claims anew. `held`: claims of earlier runs (scope, idempotency_key, holder,
    claimed_at in microseconds). Requests without a key claim nothing and are not in the result.
    """
    life = hours * 3_600_000_000
    at = F.coalesce(F.unix_micros(F.col("event_time").cast("timestamp")), F.lit(0)).alias("at")
    given = requests.filter(F.col("idempotency_key").isNotNull()).select(*CLAIM, "request_id", at, F.lit(1).alias("now"))
    if held is not None:
        given = given.unionByName(
            held.select(*CLAIM, F.col("holder").alias("request_id"), F.col("claimed_at").alias("at"), F.lit(0).alias("now")).distinct()
        )
    given = given.na.fill("", SCOPE)

    def step(key, pdf, state):
        holder, since = pickle.loads(state) if state else (None, None)
        out = []
        for row in pdf.itertuples(index=False):
            if since is None or row.at - since >= life:
                holder, since = row.request_id, row.at
            if row.now:
                out.append((*key, row.request_id, since, holder))
        return pd.DataFrame(out, columns=[c.split()[0] for c in CLAIMED.split(", ")]), pickle.dumps((holder, since))

    return sequential_fold(given, CLAIM, ["at", "now", "request_id"], step, CLAIMED, rows_per_chunk)


@dataclass(frozen=True)
class Ingested:
    cells: DataFrame
    text_docs: DataFrame
    vectors: DataFrame
    dead_letters: DataFrame
    claims: DataFrame


def job_ingest(
    requests: DataFrame, existing: DataFrame, at: Column, per_turn: bool = False, gap_min: float = 30,
    max_turns: int = 20, max_tokens: int = 512, held: DataFrame | None = None,
) -> Ingested:
    """Claim, raw records, segments, new cells, and the two derived indexes with their dead letters.

    `held`: the claims of earlier runs, as this job returns them; a repeat is not stored again, and its row in the claims
    names the request (`holder`) whose cells answer it.
    """
    taken = materialize(claims(requests, held), "claims")
    own = F.coalesce("tenant_id", F.lit("")).alias("_t"), F.coalesce("user_id", F.lit("")).alias("_u")
    repeated = taken.filter(F.col("holder") != F.col("request_id")).select(
        F.col("tenant_id").alias("_t"), F.col("user_id").alias("_u"), "request_id", "idempotency_key"
    )
    keyed = requests.select("*", *own).join(repeated, ["_t", "_u", "request_id", "idempotency_key"], "left_anti")
    claimed = keyed.select(*requests.columns)
    raws = (ingest.raw_per_turn if per_turn else ingest.raw_per_session)(claimed)
    timed = raws.withColumn("event_min", ingest.event_minutes(F.col("event_time")))
    cells = ingest.build_cells(ingest.segment(timed, gap_min, max_turns, max_tokens))
    fresh = store.insert_new(existing, cells, "mem_cell_id").withColumn(
        "embedding", F.lit(None).cast("array<float>")
    )
    docs, vectors, dead = store.index_fanout(fresh, at)
    return Ingested(fresh, docs, vectors, dead, taken)


# --- cold path ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Enriched:
    episodes: DataFrame
    facts: DataFrame
    scenes: DataFrame
    postings: DataFrame
    index: DataFrame
    nodes: DataFrame
    edges: DataFrame


def job_cold_path(
    cells: DataFrame, episode_answers: DataFrame, fact_answers: DataFrame, sim: float = 0.65, gap_days: float = 7,
) -> Enriched:
    """Cells and model answers to episodes, facts, scenes, entity index and graph.

    Every enrichment is an outer step: a cell without answers still gets an episode, a scene and its entities.
    """
    found = materialize(extraction.episodes(cells, episode_answers), "episodes")
    learned = extraction.semantics(found, fact_answers)
    assigned = materialize(scenes.cluster_scenes(cells, sim, gap_days), "scenes")
    named = materialize(graph.entity_source(cells, found), "entities")
    return Enriched(
        found, learned, assigned, graph.entity_postings(named), graph.entity_index(named),
        graph.graph_nodes(named, cells), graph.graph_edges(named),
    )


# --- retrieve -----------------------------------------------------------------------------------------------------

# The effective shipped retrieval settings (operator defaults differ).
SERVED_WEIGHTS = {"bm25": 0.40, "vector": 0.60, "entity": 0.15, "graph": 0.15}
SERVED_RRF_K = 90
SERVED_LAMBDA = 0.55
SERVED_CHANNELS = ("bm25", "vector")


def retrieval_signals(cells: DataFrame) -> DataFrame:
    """Time decay = retention, importance = composite score."""
    decay = retention(F.col("age_days"), F.col("strength"), F.col("access_count"))
    worth = fsfm_score(F.col("age_days"), F.col("access_count"), F.col("strength"), F.col("n_raw"), F.col("text"))
    return cells.select(*SCOPE, F.col("mem_cell_id").alias("memory_id"), decay.alias("decay"), worth.alias("importance"))


def recall_channels(
    queries: DataFrame, cells: DataFrame, top_k: int, channels: Sequence[str] = SERVED_CHANNELS,
    entities: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The enabled channels with their over-fetch. A channel whose input is missing is left out; none is an error.

    Queries may hold `filters` (see `store.request_filters`): the text channel takes every key, the vector channel memory_type
    and state only, the entity and graph channels none. They act before the cut to the over-fetch.
    """
    wide = ranking.overfetch(top_k)
    out: dict[str, DataFrame] = {}
    if "bm25" in channels:
        asked, names = store.request_filters(queries, cells)
        index = materialize(recall.text_index(cells, filters=names), "text-index")
        postings, stats = recall.postings_of(index), recall.stats_of(index)
        out["bm25"] = recall.bm25_topk(asked, postings, stats, wide["bm25"], filters=names)
    if "vector" in channels and "embedding" in cells.columns and "query_vec" in queries.columns:
        asked, names = store.request_filters(queries, cells, store.VECTOR_FILTERS)
        out["vector"] = recall.vector_topk(asked, cells, wide["vector"], filters=names)
    if entities is not None and {"entity", "graph"} & set(channels):
        entities = materialize(entities, "entities")
        asked = recall.query_entities(queries, extract_entities)
        if "entity" in channels:
            out["entity"] = recall.entity_topk(asked, graph.entity_postings(entities), cells, wide["entity"])
        if "graph" in channels:
            nodes, edges = graph.graph_nodes(entities, cells), graph.graph_edges(entities)
            out["graph"] = recall.graph_topk(asked, nodes, edges, cells, wide["graph"])
    if not out:
        raise ValueError("no recall channel is available")
    return out


def job_retrieve(
    queries: DataFrame, cells: DataFrame, top_k: int = 5, channels: Sequence[str] = SERVED_CHANNELS,
    entities: DataFrame | None = None, signals: DataFrame | None = None, threshold: float = 0.0,
    weights: Mapping[str, float] = SERVED_WEIGHTS, k: int = SERVED_RRF_K, lam: float | None = SERVED_LAMBDA,
) -> DataFrame:
    """Recall, fuse, boost, filter, diversify and cut, for all queries at once. `lam=None` skips diversity."""
    found = recall_channels(queries, cells, top_k, channels, entities)
    fused = materialize(ranking.rrf_fuse(ranking.union_fuse(list(found.values())), weights, k), "fused")
    boosted = ranking.signal_boost(fused, signals) if signals is not None else fused
    kept = store.threshold_filter(boosted, threshold)
    if lam is None:
        return ranking.final_topk(kept, top_k)
    return ranking.mmr_rerank(kept, cells, ranking.checked_topk(top_k), lam)


def job_retrieve_requests(
    requests: DataFrame, cells: DataFrame, signals: DataFrame | None = None, channels: Sequence[str] = SERVED_CHANNELS,
    entities: DataFrame | None = None, weights: Mapping[str, float] = SERVED_WEIGHTS, k: int = SERVED_RRF_K,
) -> tuple[DataFrame, DataFrame]:
    """Retrieval with the options of each request, and the hit log that `hit_update` reads.

    `requests`: the columns of queries with top_k (1 to 100), channels (empty or null: all), weights (map of overrides),
    threshold (null: 0) and, if wanted, filters (map of equalities, see `recall_channels`). Archived cells are left out where the cells have a `state`. The result holds content, type and
    channels of every memory; the log has one row per memory and request.
    """
    largest, least = requests.agg(F.max("top_k"), F.min("top_k")).first()
    for asked in (largest, least):
        if asked is not None:
            ranking.checked_topk(asked)
    if largest is None:
        largest = 1
    own = requests.select(*QUERY, F.col("top_k").alias("_k"), F.coalesce("threshold", F.lit(0.0)).alias("_least"))
    found = recall_channels(requests, cells, largest, channels, entities)
    deep = F.create_map(*(F.lit(x) for pair in ranking.overfetch(1).items() for x in pair))
    hits = ranking.union_fuse(list(found.values())).join(own, QUERY)
    hits = hits.filter(F.col("rank") < deep[F.col("channel")] * F.col("_k")).drop("_k", "_least")
    fused = ranking.rrf_fuse(store.channel_enable(hits, requests), weights, k, requests)
    fused = materialize(fused, "fused")
    boosted = ranking.signal_boost(fused, signals) if signals is not None else fused
    if "state" in cells.columns:
        boosted = store.lifecycle_filter(boosted, cells)
    kept = boosted.join(own, QUERY).filter(F.col("score") >= F.col("_least"))
    top = materialize(ranking.rerank(kept).filter(F.col("rank") < F.col("_k")).drop("_k", "_least"), "retrieved")
    kind = F.col("memory_type") if "memory_type" in cells.columns else F.lit("EPISODIC")
    texts = cells.select(*SCOPE, F.col("mem_cell_id").alias("memory_id"), F.col("text").alias("content"), kind.alias("memory_type"))
    log = top.select(*QUERY, F.col("memory_id").alias("mem_cell_id"), "rank")
    return top.join(texts, [*SCOPE, "memory_id"], "left"), log


# --- feedback -----------------------------------------------------------------------------------------------------


def job_feedback(cells: DataFrame, feedback: DataFrame, hits: DataFrame) -> DataFrame:
    """Feedback replay, then hits, then the state that follows; every cell is returned."""
    folded = lifecycle.feedback_fold(cells, feedback).select(
        *SCOPE, "mem_cell_id", F.col("new_strength").alias("strength"), "access_count"
    )
    merged = store.merge(cells, folded, [*SCOPE, "mem_cell_id"], ["strength", "access_count"])
    counted = lifecycle.hit_update(merged, hits)
    return counted.select(
        *SCOPE, "mem_cell_id", "strength", "access_count",
        compute_state(F.col("access_count"), F.col("age_days")).alias("state"),
        (F.col("changed") | (F.col("hits") > 0)).alias("changed"),
    )


# --- consolidate --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Consolidated:
    decisions: DataFrame
    facts: DataFrame | None
    archived: DataFrame
    report: DataFrame


def job_consolidate(
    phase: str, candidates: DataFrame, known: DataFrame, cells: DataFrame, max_per_user: int = 10_000,
    margin: float = 0.1, thresholds: FactThresholds = FactThresholds(),
) -> Consolidated:
    """light: decide and write facts; deep: also decay and capacity; rem: decay and capacity only."""
    if phase not in ("light", "deep", "rem"):
        raise ValueError(f"unknown phase {phase}")
    none = known.sparkSession.createDataFrame([], "tenant_id string, user_id string, decision string")
    decisions, stored = none, None
    if phase != "rem":
        decisions = facts.consolidate_facts(candidates, known, thresholds)
        stored = facts.apply_decisions(known, candidates, decisions)
    gone = cells.filter(F.lit(False)).select(*SCOPE, "mem_cell_id")
    if phase != "light":
        decayed = lifecycle.passive_decay(cells, F.col("age_days"))
        score = fsfm_score(F.col("age_days"), F.col("access_count"), F.col("strength"), F.col("n_raw"), F.col("text"))
        over = lifecycle.enforce_capacity(decayed, score, max_per_user, margin)
        gone = decayed.filter("archived").select(*SCOPE, "mem_cell_id").unionByName(
            over.select(*SCOPE, "mem_cell_id")
        )
    return Consolidated(decisions, stored, gone, reports.consolidation_report(decisions, gone, phase))


__all__ = [
    "first_claim", "claims", "job_ingest", "job_cold_path", "job_retrieve", "job_feedback", "job_consolidate",
    "retrieval_signals", "recall_channels",
]
