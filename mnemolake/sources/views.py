"""The memory tables as views over the given test tables. The SQL runs unchanged on Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from mnemolake.session import materialize
from mnemolake.sources.tables import spread

TEXT_HEAVY = ("documents",)

VIEWS = {
    # Conversations as an ingest stream; event_min = minutes since an epoch. A request id repeats in three tenants.
    "turns": """
SELECT conv_id, turn, role, text,
  concat('t', CAST(conv_id % 3 AS STRING)) AS tenant_id,
  concat('u', CAST(conv_id % 20 AS STRING)) AS user_id,
  concat('c', CAST(conv_id AS STRING)) AS session_id,
  concat('q', CAST(CAST(floor(conv_id / 3) AS BIGINT) AS STRING)) AS request_id,
  conv_id * 360 + turn * 20 + (conv_id * 7 + turn * 13) % 23 AS event_min
FROM conversations""",
    # One raw record per turn (pos = order inside the request).
    "raws": """
SELECT concat(session_id, ':', CAST(turn AS STRING)) AS raw_id, tenant_id, user_id, session_id, request_id,
  turn AS pos, concat(role, ': ', text) AS content, event_min
FROM turns""",
    # Documents as memory cells; embedding is null where no vector exists.
    "cells": """
SELECT concat('d', CAST(d.doc_id AS STRING)) AS mem_cell_id,
  concat('t', CAST(d.doc_id % 3 AS STRING)) AS tenant_id,
  concat('u', CAST(d.doc_id % 20 AS STRING)) AS user_id,
  concat('s', CAST(d.doc_id % 7 AS STRING)) AS session_id,
  d.doc_id, d.lang, d.text, e.embedding,
  (d.doc_id * 37 % 50) / CAST(10 AS DOUBLE) AS strength,
  CAST(CASE WHEN d.doc_id % 4 = 0 THEN d.doc_id * 13 % 12 ELSE 0 END AS INT) AS access_count,
  CASE WHEN d.doc_id % 97 = 5 THEN CAST(-10 AS DOUBLE) ELSE (d.doc_id * 11 % 100) / CAST(100 AS DOUBLE) END
    AS importance_score,
  CAST(1 + d.doc_id % 5 AS INT) AS n_raw,
  CAST(d.doc_id * 29 % 200 AS DOUBLE) + CAST(0.25 AS DOUBLE) AS age_days,
  CASE WHEN d.doc_id % 3 > 0 THEN CAST('2023-12-11 00:00:00' AS TIMESTAMP) END AS updated_at
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""",
    # Cells with their lifecycle state.
    "stated": """
SELECT *, CASE WHEN access_count >= 5 OR age_days < 1 THEN 'ACTIVE' WHEN access_count >= 2 OR age_days < 7 THEN 'WARM'
  WHEN age_days < 90 THEN 'COLD' ELSE 'ARCHIVED' END AS state
FROM cells""",
    # Benchmark passages as retrieval requests; two neighbours share a query id in different tenants.
    "queries": """
SELECT concat('i', CAST(CAST(floor(b.item_id / 2) AS BIGINT) AS STRING)) AS query_id, b.item_id,
  concat('t', CAST(b.item_id % 3 AS STRING)) AS tenant_id,
  concat('u', CAST(b.item_id % 20 AS STRING)) AS user_id,
  b.text AS query, e.embedding AS query_vec
FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id""",
    # Non-view events as feedback; signal 0 means "use the table default". Cells follow the event's user.
    "feedback": """
SELECT event_id, concat('d', CAST(user_id AS STRING)) AS mem_cell_id,
  concat('t', CAST(user_id % 3 AS STRING)) AS tenant_id, concat('u', CAST(user_id % 20 AS STRING)) AS user_id,
  CASE event_type WHEN 'purchase' THEN 'explicit_confirm' WHEN 'click' THEN 'positive'
    WHEN 'error' THEN 'negative' WHEN 'signup' THEN 'correction' END AS feedback_type,
  CASE WHEN event_id % 10 = 0 THEN CAST(0.8 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS signal_value, ts
FROM events WHERE event_type <> 'view'""",
    # View events as retrieval hits, one batch per day.
    "hits": """
SELECT event_id, concat('d', CAST(user_id AS STRING)) AS mem_cell_id,
  concat('t', CAST(user_id % 3 AS STRING)) AS tenant_id, concat('u', CAST(user_id % 20 AS STRING)) AS user_id,
  CAST(ts AS DATE) AS batch_day
FROM events WHERE event_type = 'view'""",
    # Texts as semantic facts, one user per language; odd ids are new, even ids exist.
    "facts": """
SELECT concat('f', CAST(doc_id AS STRING)) AS semantic_id, 't0' AS tenant_id, concat('u_', lang) AS user_id,
  text AS content, doc_id % 2 = 1 AS is_new, doc_id AS seq
FROM documents""",
    # The same facts with a vector where one exists.
    "vfacts": """
SELECT f.*, e.embedding FROM facts f LEFT JOIN embeddings e ON e.vec_id = f.seq""",
    # Error events as dead letters; some ids have no cell.
    "dlq": """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'milvus' WHEN 1 THEN 'cold_path' ELSE 'es' END AS target,
  concat('d', CAST(CAST(floor(event_id / 8) AS BIGINT) AS STRING)) AS mem_cell_id,
  CAST(event_id % 7 AS INT) AS retry_count, ts
FROM events WHERE event_type = 'error'""",
    # Events as a request log.
    "serving_log": """
SELECT event_id, ts, event_type AS path,
  CASE WHEN event_id % 17 = 0 THEN '500' WHEN event_id % 23 = 0 THEN '429' ELSE '200' END AS status,
  value / 1000 AS seconds
FROM events""",
    # Model answers per cell: plain list, fenced, prose around an object, garbage.
    "responses": """
SELECT mem_cell_id, CASE doc_id % 4
  WHEN 0 THEN concat('[{"summary":"s', CAST(doc_id AS STRING),
    '","key_entities":"alpha, beta","importance":"1.7"},{"summary":"x","key_entities":["gamma"],"emotional_valence":-3}]')
  WHEN 1 THEN concat('```json', chr(10), '[{"summary":"s', CAST(doc_id AS STRING), '","importance":0.4}]', chr(10), '```')
  WHEN 2 THEN concat('Here it is: {"summary":"s', CAST(doc_id AS STRING), '","key_entities":[]} Done.')
  ELSE 'no json here' END AS response
FROM cells""",
    # Events as versions of parameters: two names per event user, which share one version counter in event order.
    "params": """
SELECT concat('cat', CAST(user_id % 5 AS STRING)) AS category, 'user' AS scope,
  concat('u', CAST(user_id AS STRING)) AS scope_id, concat('p', CAST(event_id % 2 AS STRING)) AS name, CAST(value AS STRING) AS params,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS version,
  ts AS updated_at, event_type AS actor
FROM events""",
}

NEEDS = {
    "turns": ["conversations"], "raws": ["turns"], "cells": ["documents", "embeddings"], "stated": ["cells"],
    "queries": ["benchmark", "embeddings"], "feedback": ["events"], "hits": ["events"], "facts": ["documents"], "vfacts": ["facts", "embeddings"],
    "dlq": ["events"], "serving_log": ["events"], "responses": ["cells"], "params": ["events"],
}


class Tables:
    """Lazily built views over one directory of test tables: `Tables(spark, dir)["cells"]`."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self._made = spark, folder, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._view(name) if name in VIEWS else self._table(name)
        return self._made[name]

    def stored(self, name: str) -> DataFrame:
        """Write a view that several steps of a job read, so that its joins move the texts once; later views read it too."""
        self._made[name] = materialize(self[name], name)
        return self[name]

    def _table(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(table) if name in TEXT_HEAVY else table

    def _view(self, name: str) -> DataFrame:
        parts = {need: self[need] for need in NEEDS[name]}
        text = VIEWS[name].replace("{", "{{").replace("}", "}}")
        text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(parts)})\b", r"\1 {\2}", text)
        return self.spark.sql(text, **parts)


def _by_item(blocks: list[str], text: str) -> str:
    """The SQL works with one id per query of a scope, which is the item's; only its result has the shared ids."""
    shared = "concat('i', CAST(CAST(floor(b.item_id / 2) AS BIGINT) AS STRING)) AS query_id"
    own = [b.replace(shared, "concat('i', CAST(b.item_id AS STRING)) AS query_id") for b in blocks]
    more = text.upper().startswith("SELECT")
    inner = "WITH RECURSIVE " + ",\n".join(own) + ("\n" if more else ",\n") + text
    return f"SELECT * REPLACE (concat('i', CAST(substr(query_id, 2) AS BIGINT) // 2) AS query_id) FROM ({inner})"


def with_views(names: str, sql: str, query_ids: bool = True) -> str:
    """DuckDB text: the needed views (blank-separated names) as WITH blocks in front of `sql`.

    `sql` is a SELECT, or further WITH blocks followed by one.
    """
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name in VIEWS and name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    blocks = [f"{name} AS ({VIEWS[name].strip()})" for name in order]
    text = sql.strip()
    if "queries" in order and query_ids:
        return _by_item(blocks, text)
    if not text.upper().startswith("SELECT"):
        blocks.append(text)
        return "WITH RECURSIVE " + ",\n".join(blocks)
    return "WITH RECURSIVE " + ",\n".join(blocks) + "\n" + text if blocks else text
