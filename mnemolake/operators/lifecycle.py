"""Strength, access and state of cells: hits, feedback, decay and capacity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.functions.core import significant
from mnemolake.functions.scoring import compute_state, recency, signal_map
from mnemolake.operators.ordered import previous_in_key, rank_in_key, split_hot_keys
from mnemolake.schemas import SCOPE

ACCESS_FEEDBACK = ("positive", "explicit_confirm")


def hit_update(cells: DataFrame, hits: DataFrame, delta: float = 0.1, s_max: float = 5.0) -> DataFrame:
    """Retrieval hits: each batch counts a cell once. State is left as it is."""
    key = [*(c for c in SCOPE if c in hits.columns), "mem_cell_id"]
    batches = hits.select(*key, "batch_day").distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    return (
        cells.join(batches, key, "left")
        .withColumn(
            "strength",
            F.when(
                F.col("_n").isNotNull(),
                F.least(F.coalesce("strength", F.lit(0.0)) + delta * F.col("_n"), F.lit(s_max)),
            ).otherwise(F.col("strength")),
        )
        .withColumn("access_count", (F.col("access_count") + F.coalesce("_n", F.lit(0))).cast("int"))
        .withColumn("hits", F.coalesce("_n", F.lit(0)))
        .drop("_n")
    )


def targeted(feedback: DataFrame) -> DataFrame:
    """Feedback with its target cell: `mem_cell_id`, else `memory_id` where the table has one."""
    if "memory_id" not in feedback.columns:
        return feedback
    return feedback.withColumn("mem_cell_id", F.coalesce("mem_cell_id", "memory_id"))


def touched_at(cells: DataFrame) -> Column:
    """Microseconds of the cell's last change, null where it is unknown."""
    if "updated_at" not in cells.columns:
        return F.lit(None).cast("bigint")
    return F.unix_micros(F.col("updated_at").cast("timestamp"))


def _bounded(value: Column, s_max: float) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(s_max))


def feedback_fold(
    cells: DataFrame, feedback: DataFrame, eta: float = 0.3, lam: float = 0.01, s_max: float = 5.0,
    rows_per_chunk: int = 20_000,
) -> DataFrame:
    """Replay feedback in time order: S = clip(S + eta * signal - lam * days since the last event, 0, s_max).

    The first event counts its days from the cell's `updated_at`, where that is known.

    One step is x -> clip(x + a, lo, hi), and such steps compose to one of the same form, so a cell with any
    number of events is folded chunk by chunk in parallel and the chunk results are chained.
    """
    key = [*SCOPE, "mem_cell_id"]
    order = [F.col("ts"), F.col("event_id")]
    known = targeted(feedback).join(cells.select(*key, touched_at(cells).alias("_touched")), key)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    timed = previous_in_key(known.withColumn("_at", micros), key, order, F.col("_at"), "_before", rows_per_chunk)
    days = F.greatest(F.lit(0.0), F.coalesce(F.col("_at") - F.coalesce("_before", "_touched"), F.lit(0)) / 86_400_000_000.0)
    step = eta * signal_map(F.col("feedback_type"), F.col("signal_value")) - lam * days
    slim = timed.select(
        *key, "ts", "event_id", step.alias("a"), F.col("feedback_type").isin(*ACCESS_FEEDBACK).cast("int").alias("used")
    )
    chunks, _ = split_hot_keys(slim, key, order, rows_per_chunk)
    parts = chunks.groupBy(*key, "_chunk").agg(
        F.sort_array(F.collect_list(F.struct("ts", "event_id", "a"))).alias("_e"),
        F.sum("used").alias("used"), F.count(F.lit(1)).alias("n"),
    )
    inf = float("inf")
    start = F.struct(F.lit(0.0).alias("a"), F.lit(-inf).alias("lo"), F.lit(inf).alias("hi"))
    whole = F.aggregate(
        "_e", start,
        lambda f, e: F.struct(
            (f["a"] + e["a"]).alias("a"), _bounded(f["lo"] + e["a"], s_max).alias("lo"),
            _bounded(f["hi"] + e["a"], s_max).alias("hi"),
        ),
    )
    per_cell = parts.select(*key, "_chunk", "used", "n", whole.alias("f")).groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("_chunk", "f"))).alias("_f"), F.sum("used").alias("used"),
        F.sum("n").alias("n_events"),
    )
    old = F.coalesce("strength", F.lit(0.0))
    new = F.aggregate(
        "_f", old,
        lambda s, c: F.least(F.greatest(s + c["f"]["a"], c["f"]["lo"]), c["f"]["hi"]),
    )
    return cells.join(per_cell, key).select(
        *key, old.alias("old_strength"), new.alias("new_strength"), (new - old).alias("delta"),
        (F.col("access_count") + F.col("used")).cast("int").alias("access_count"), "n_events",
    )


def passive_decay(
    cells: DataFrame, age: Column, days: float = 90, floor: float = 0.15, dry_run: bool = False,
) -> DataFrame:
    """COLD cells that are too old, or whose recency score is too low, become ARCHIVED."""
    due = (F.col("state") == "COLD") & ((age > days) | (recency(age) < floor))
    state = F.col("state") if dry_run else F.when(due, "ARCHIVED").otherwise(F.col("state"))
    return cells.withColumn("archived", due).withColumn("state", state)


def _share(total: Column, margin: float) -> Column:
    return F.greatest(F.lit(1), F.floor(total * max(0.0, min(1.0, margin)))).cast("bigint")


def enforce_capacity(
    cells: DataFrame, score: Column, max_per_user: int = 10_000, margin: float = 0.1, **chunking,
) -> DataFrame:
    """Cells to archive per user: the lowest scores among the not yet archived, at most a `margin` share a run."""
    total = cells.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("total")).filter(F.col("total") > max_per_user)
    quota = F.least(F.col("total") - max_per_user, _share(F.col("total"), margin))
    due = total.select(*SCOPE, "total", quota.alias("_quota"))
    live = cells.filter(F.col("state") != "ARCHIVED").join(due, SCOPE).select(
        *SCOPE, "mem_cell_id", score.alias("score"), "total", "_quota"
    )
    ranked = rank_in_key(live, SCOPE, [significant(F.col("score")), F.col("mem_cell_id")], "position", **chunking)
    return ranked.filter(F.col("position") <= F.col("_quota")).drop("_quota")


# Order in which states are forgotten.
STATE_RANK = {"ARCHIVED": 0, "COLD": 1, "WARM": 2, "ACTIVE": 3}


def select_to_forget(
    cells: DataFrame, capacity: int, margin: float = 0.1, danger: float = -10.0, order_by: Sequence[str] = ("mem_cell_id",),
    **chunking,
) -> DataFrame:
    """Per user: dangerous cells first (up to the excess), then by state, used strength and importance."""
    total = cells.groupBy(*SCOPE).agg(
        F.count(F.lit(1)).alias("_total"),
        F.count_if(F.col("importance_score") <= danger).alias("_danger"),
    ).filter(F.col("_total") > capacity)
    excess = F.col("_total") - capacity
    target = F.least(excess, _share(F.col("_total"), margin))
    taken = F.least(F.col("_danger"), excess)
    # Dangerous rows beyond the excess are not taken; the rest of the quota goes to the ordered others.
    due = total.select(
        *SCOPE, taken.alias("_first"), F.greatest(F.lit(0), target - taken).alias("_rest"), "_danger"
    )
    ranks = F.create_map(*(F.lit(x) for pair in STATE_RANK.items() for x in pair))
    is_danger = F.col("importance_score") <= danger
    used = F.col("strength") * F.greatest(F.lit(1.0), F.col("access_count") / 10.0)
    rows = cells.join(due, SCOPE).withColumn("reason", F.when(is_danger, "danger").otherwise("greedy"))
    order = [
        F.when(is_danger, 0).otherwise(1),
        F.when(is_danger, 0).otherwise(F.try_element_at(ranks, F.col("state"))),
        F.when(is_danger, 0.0).otherwise(F.round(used, 9)),
        F.when(is_danger, 0.0).otherwise(F.col("importance_score")),
        *[F.col(c) for c in order_by],
    ]
    ranked = rank_in_key(rows, SCOPE, order, "_position", **chunking)
    place = F.when(is_danger, F.col("_position")).otherwise(F.col("_position") - F.col("_danger"))
    limit = F.when(is_danger, F.col("_first")).otherwise(F.col("_rest"))
    return ranked.filter(place <= limit).select(*SCOPE, "mem_cell_id", "reason")


def keep_recent(df: DataFrame, keys: Sequence[str], newest: Sequence[Column], n: int, **chunking) -> DataFrame:
    """The newest n rows per key. `newest` sorts the newest row first and ends in a unique id."""
    ranked = rank_in_key(df, keys, newest, "_r", **chunking)
    return ranked.filter(F.col("_r") <= n).drop("_r")


def keep_recent_graph(
    nodes: DataFrame, edges: DataFrame, node_seq: Column, edge_seq: Column, max_nodes: int = 4096,
    max_edges: int = 8192,
) -> tuple[DataFrame, DataFrame]:
    """Newest nodes and edges per user; edges of dropped nodes go too."""
    kept = keep_recent(nodes, SCOPE, [node_seq, F.col("node_id")], max_nodes)
    ids = kept.select(*SCOPE, "node_id")
    ends = edges
    for end in ("source_node_id", "target_node_id"):
        ends = ends.join(ids.withColumnRenamed("node_id", end), [*SCOPE, end], "left_semi")
    return kept, keep_recent(ends, SCOPE, [edge_seq, F.col("edge_id")], max_edges)


def refresh_state(cells: DataFrame, age: Column) -> DataFrame:
    return cells.withColumn("state", compute_state(F.col("access_count"), age))
