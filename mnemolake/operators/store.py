"""Keyed tables: insert, merge, delete, derived indexes, dead letters, scoped reads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.schemas import QUERY, SCOPE
from mnemolake.operators.ordered import rank_in_key

# --- writes -------------------------------------------------------------------------------------------------------


def insert_new(existing: DataFrame, incoming: DataFrame, key: str, order: Sequence[str] = ()) -> DataFrame:
    """Rows of `incoming` that may be inserted: first per key, key not stored yet. Without `order` the rows of a key are
    compared as JSON text, which any column type has."""
    rest = [c for c in incoming.columns if c != key]
    by = F.struct(*order) if order else F.to_json(F.struct(*rest))
    first = incoming.groupBy(key).agg(F.min_by(F.struct(*rest), by).alias("_r")).select(key, "_r.*")
    return first.select(*incoming.columns).join(existing.select(key), key, "left_anti")


def merge(base: DataFrame, updates: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Partial update by key: non-null values of `cols` replace the stored ones; `changed` marks touched rows."""
    new = updates.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in cols], F.lit(True).alias("_hit"))
    joined = base.join(new, list(keys), "left")
    return joined.select(
        *[F.coalesce(f"_new_{c}", c).alias(c) if c in cols else F.col(c) for c in base.columns],
        F.coalesce("_hit", F.lit(False)).alias("changed"),
    )


def delete(base: DataFrame, ids: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows that existed and go)."""
    named = ids.select(*keys).distinct()
    return base.join(named, list(keys), "left_anti"), base.join(named, list(keys), "left_semi")


TEXT_DOC_FIELDS = ["mem_cell_id", "tenant_id", "user_id", "session_id", "state", "text", "created_at"]


def text_index_docs(cells: DataFrame, fields: Sequence[str] = TEXT_DOC_FIELDS) -> DataFrame:
    return cells.select(*fields)


def vector_upsert(base: DataFrame, incoming: DataFrame, key: str, seq: str, vector: str = "embedding") -> DataFrame:
    """Last write per id wins; empty vectors are skipped; mixed dimensions fail the job."""
    given = incoming.filter(F.col(vector).isNotNull() & (F.size(vector) > 0))
    sizes = given.agg(F.min(F.size(vector)).alias("lo"), F.max(F.size(vector)).alias("hi"))
    checked = sizes.select(
        F.assert_true(F.coalesce(F.col("lo") == F.col("hi"), F.lit(True)), F.lit("mixed vector dimensions")).isNull()
        .alias("ok")
    )
    rows = base.select(*incoming.columns).unionByName(given)
    rest = [c for c in incoming.columns if c != key]
    latest = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r")).select(key, "_r.*")
    return latest.filter(checked.scalar()).select(*incoming.columns)


def index_fanout(
    cells: DataFrame, at: Column, text_ok: Column | None = None, vector_ok: Column | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(text documents, vectors, dead letters). A cell without a vector is not a failure."""
    has_vector = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    text_ok = text_ok if text_ok is not None else F.col("text").isNotNull() & (F.trim("text") != "")
    vector_ok = vector_ok if vector_ok is not None else ~F.exists("embedding", lambda x: F.isnan(x) | x.isNull())
    # A rule that gives null has not accepted the row: it is a dead letter, never lost.
    text_ok, vector_ok = F.coalesce(text_ok, F.lit(False)), F.coalesce(vector_ok, F.lit(False))
    docs = cells.filter(text_ok)
    vectors = cells.filter(has_vector & vector_ok).select("mem_cell_id", *SCOPE, "embedding")
    failures = F.array_compact(
        F.array(
            F.when(~text_ok, F.struct(F.lit("es").alias("target"), F.lit("text rejected").alias("error"))),
            F.when(
                has_vector & ~vector_ok,
                F.struct(F.lit("milvus").alias("target"), F.lit("vector rejected").alias("error")),
            ),
        )
    )
    dead = cells.select("mem_cell_id", F.explode(failures).alias("_f")).select(
        F.col("_f.target"), "mem_cell_id", F.lit("index").alias("operation"), F.col("_f.error"),
        F.lit(0).alias("retry_count"), at.alias("ts"),
    )
    return docs, vectors, dead


# --- dead letters -------------------------------------------------------------------------------------------------


def dlq_stats(dlq: DataFrame) -> DataFrame:
    return dlq.rollup("target").agg(F.count(F.lit(1)).alias("n")).select(
        F.coalesce("target", F.lit("total")).alias("target"), "n"
    )


def _newest(dlq: DataFrame) -> list[Column]:
    return [F.col("ts").desc(), F.col("event_id").desc()]


def dlq_list(dlq: DataFrame, target: str | None = None, limit: int = 50) -> DataFrame:
    chosen = dlq.filter(F.col("target") == target) if target else dlq
    return chosen.orderBy(*_newest(dlq)).limit(limit)


def dlq_retain(dlq: DataFrame, n: int = 10_000) -> DataFrame:
    """The newest n rows of the backlog."""
    return dlq.orderBy(*_newest(dlq)).limit(n)


RECONCILE_TARGETS = ("es", "milvus")


def reconcile(
    dlq: DataFrame, cells: DataFrame, max_retries: int = 5, dry_run: bool = False, target: str | None = None,
    retry_ok: Column | None = None,
) -> DataFrame:
    """Verdict per dead letter, first match wins. `retry_ok`: did the repeated write succeed (default: yes)."""
    rows = dlq.filter(F.col("target") == target) if target else dlq
    source = cells.select(
        "mem_cell_id", F.lit(True).alias("_found"),
        F.coalesce(F.size("embedding") > 0, F.lit(False)).alias("_vec"),
    )
    ok = retry_ok if retry_ok is not None else F.lit(True)
    verdict = (
        F.when(F.col("retry_count") >= max_retries, "exhausted")
        .when(~F.col("target").isin(*RECONCILE_TARGETS), "skipped")
        .when(F.col("_found").isNull(), "skipped")
        .when(F.lit(dry_run), "dry_run")
        .when((F.col("target") == "milvus") & ~F.col("_vec"), "skipped")
        .when(ok, "ok")
        .otherwise("failed")
    )
    return rows.join(source, "mem_cell_id", "left").select(*dlq.columns, verdict.alias("status"))


def reconcile_summary(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def reconcile_remaining(verdicts: DataFrame) -> DataFrame:
    """The backlog after the run: repaired rows leave, failed ones count one more retry."""
    retried = F.col("retry_count") + (F.col("status") == "failed").cast("int")
    return verdicts.filter(F.col("status") != "ok").withColumn("retry_count", retried).drop("status")


def index_drift(cells: DataFrame, index: DataFrame, key: str) -> DataFrame:
    missing = cells.select(key).join(index.select(key), key, "left_anti")
    orphan = index.select(key).join(cells.select(key), key, "left_anti")
    return missing.withColumn("drift", F.lit("missing")).unionByName(orphan.withColumn("drift", F.lit("orphan")))


# --- reads --------------------------------------------------------------------------------------------------------


def scope_pred(tenant_id: str | None = None, user_id: str | None = None) -> Column:
    """Both given: filter on both. None given: everything. Exactly one: nothing."""
    if tenant_id and user_id:
        return (F.col("tenant_id") == tenant_id) & (F.col("user_id") == user_id)
    return F.lit(not tenant_id and not user_id)


def fetch_by_ids(cells: DataFrame, requests: DataFrame) -> DataFrame:
    """Cells of each request (query_id, scope, ids) in request order, repeated ids at their first place."""
    wanted = (
        requests.select("query_id", *SCOPE, F.posexplode("ids").alias("pos", "mem_cell_id"))
        .groupBy("query_id", *SCOPE, "mem_cell_id")
        .agg(F.min("pos").alias("pos"))
    )
    return wanted.join(cells, [*SCOPE, "mem_cell_id"])


def by_state(cells: DataFrame, state: str, limit: int | None = None) -> DataFrame:
    chosen = cells.filter(F.col("state") == state)
    if limit is None:
        return chosen
    return rank_in_key(chosen, SCOPE, [F.col("mem_cell_id")], "_r").filter(F.col("_r") <= limit).drop("_r")


def count_cells(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n"))


def user_memories(cells: DataFrame, limit: int = 20) -> DataFrame:
    """Most recent cells per user, 1 to 200; `created_at` may be any orderable type."""
    if not 1 <= limit <= 200:
        raise ValueError(f"limit must be from 1 to 200, not {limit}")
    newest = Window.partitionBy(*SCOPE).orderBy(F.col("created_at").desc(), "mem_cell_id")
    return cells.withColumn("pos", F.row_number().over(newest)).filter(F.col("pos") <= limit)


VECTOR_FILTERS = ("memory_type", "state")


def channel_filters(df: DataFrame, filters: Mapping[str, object], allow: Sequence[str] | None = None) -> DataFrame:
    """Equality on every given key; null values and keys outside `allow` are ignored."""
    for name, value in filters.items():
        if value is not None and (allow is None or name in allow):
            df = df.filter(F.col(name) == F.lit(value))
    return df


WANT, HELD = "_want_", "_held_"  # what a request asks of a cell's column, and what the column holds, both as strings


def request_filters(queries: DataFrame, cells: DataFrame, allow: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """The same for many requests at once: queries with one column `_want_<name>` per column that any of them filters by, and
    those names.

    `filters` (map<string,string>, null or missing: none) of a query holds equalities; null values and keys outside `allow` are
    ignored. A query that asks for a column which the cells lack, or one that is no plain value, can find nothing and is left out.
    Values are compared as strings; a null in a cell equals nothing. One row with a flag per column comes to the driver.
    """
    if "filters" not in queries.columns:
        return queries, []
    plain = [c for c, kind in cells.dtypes if kind.split("<")[0] not in ("array", "map", "struct", "binary", "variant")]
    usable = [c for c in plain if allow is None or c in allow]
    kept = F.map_filter("filters", lambda key, value: value.isNotNull() & (F.lit(True) if allow is None else key.isin(*allow)))
    asked = queries.withColumn("_set", F.coalesce(kept, F.create_map().cast("map<string,string>")))
    asked = asked.filter(F.forall(F.map_keys("_set"), lambda key: key.isin(*usable)))
    if not usable:
        return asked.drop("_set"), []
    flags = asked.agg(*(F.max(F.map_contains_key("_set", F.lit(c))).alias(c) for c in usable)).first()
    names = [c for c in usable if flags[c]]
    return asked.withColumns({WANT + c: F.try_element_at("_set", F.lit(c)) for c in names}).drop("_set"), names


def held_columns(names: Sequence[str]) -> list[Column]:
    return [F.col(c).cast("string").alias(HELD + c) for c in names]


def threshold_filter(hits: DataFrame, threshold: float = 0.55) -> DataFrame:
    return hits.filter(F.col("score") >= threshold)


def lifecycle_filter(hits: DataFrame, cells: DataFrame) -> DataFrame:
    """Drop candidates whose cell is archived."""
    archived = cells.filter(F.col("state") == "ARCHIVED").select(*SCOPE, F.col("mem_cell_id").alias("memory_id"))
    return hits.join(archived, [*SCOPE, "memory_id"], "left_anti")


def channel_enable(hits: DataFrame, requests: DataFrame) -> DataFrame:
    """Keep hits of the channels a request names; an empty or missing list keeps all."""
    wanted = requests.select(*QUERY, F.col("channels").alias("_wanted"))
    every = F.col("_wanted").isNull() | (F.size("_wanted") == 0)
    return (
        hits.join(wanted, QUERY)
        .filter(every | F.array_contains("_wanted", F.col("channel")))
        .drop("_wanted")
    )
