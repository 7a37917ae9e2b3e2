"""Queries over ingest, stored tables and dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.functions.text import numbered_text
from mnemolake.operators import ingest, store
from mnemolake.plans import jobs
from mnemolake.plans.registry import query
from mnemolake.schemas import REQUEST, SCOPE
from mnemolake.sources.views import Tables


def nested_requests(t: Tables) -> DataFrame:
    """Conversations as nested ingest requests, two sessions each; a conversation is one session's turns.

    Request ids repeat in three tenants. A third of the requests has no idempotency key; the others repeat a key of their
    scope every ten hours, so some repeats come within its life of 24 hours and some after it.
    """
    at = lambda minutes: F.timestamp_seconds(minutes * 60)
    conv = F.col("conv_id")
    turn = F.struct(
        F.col("turn"), F.col("role"), F.col("text").alias("content"), F.col("turn").cast("int").alias("turn_index"),
        F.when(F.col("turn") % 2 == 0, at(F.col("event_min"))).alias("timestamp"),
        F.lit(None).cast("int").alias("token_count"),
        F.when(F.col("turn") % 2 == 1, F.concat(F.lit("D"), F.col("turn").cast("string"))).otherwise("").alias("dia_id"),
        F.when(F.col("turn") % 3 == 1, "ann").alias("speaker_name"), (F.col("turn") % 4 == 0).alias("has_answer"),
        F.lit(None).cast("string").alias("img_url"), F.lit(None).cast("string").alias("caption"),
        F.lit(None).cast("string").alias("extra"),
    )
    sessions = t["turns"].groupBy("conv_id", "session_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    session = F.struct(
        (conv % 2).alias("at"), F.col("session_id"), F.col("turns"),
        F.when(conv % 3 == 0, at(conv * 360)).alias("session_date"),
        F.when(conv % 3 == 1, at(conv * 360 + 1)).alias("session_start"),
        F.when(conv % 2 == 0, "ann").otherwise("").alias("speaker_a"), F.lit("bob").alias("speaker_b"),
        F.lit(None).cast("string").alias("session_summary"),
        F.lit(None).cast("string").alias("session_observation"), F.lit(None).cast("string").alias("extra"),
    )
    number = F.floor(conv / 2).cast("bigint")
    grouped = sessions.groupBy(number.alias("r")).agg(F.sort_array(F.collect_list(session)).alias("history_sessions"))
    name = lambda prefix, value: F.concat(F.lit(prefix), value.cast("string"))
    r = F.col("r")
    hours = F.floor(r / 15) * 10
    return grouped.select(
        name("r", F.floor(r / 3)).alias("request_id"), name("t", r % 3).alias("tenant_id"), name("u", r % 5).alias("user_id"),
        F.lit("CONVERSATION").alias("raw_data_type"), at(hours * 60 + 2).alias("event_time"),
        name("a", r % 2).alias("agent_id"), F.lit("").alias("agent_role"), F.lit(None).cast("string").alias("adiu"),
        F.lit(None).cast("string").alias("session_id"), F.when(r % 3 > 0, name("k", r % 2)).alias("idempotency_key"),
        F.lit(0).alias("min_read_consistency"),
        F.create_map(F.lit("src"), F.lit("test"), F.lit("agent_id"), F.lit("x")).alias("metadata"),
        "history_sessions",
    )


NESTED = """
base AS (SELECT *, CAST(floor(conv_id / 2) AS BIGINT) AS r, conv_id % 2 AS s FROM turns),
flat AS (SELECT *, concat('r', r // 3) AS rq, concat('t', r % 3) AS ten, concat('u', r % 5) AS usr,
  CASE WHEN conv_id % 3 = 0 THEN conv_id * 360 END AS sdate,
  CASE WHEN conv_id % 3 = 1 THEN conv_id * 360 + 1 END AS sstart, r // 15 * 600 + 2 AS rtime FROM base)
"""


def _minutes(column: str):
    return ingest.event_minutes(F.col(column)).cast("bigint").alias("event_minute")


@query("raw_per_turn", "turns", NESTED + """
SELECT concat(rq, ':', s, ':', turn) AS raw_id, ten AS tenant_id, usr AS user_id, session_id,
  concat(role, ': ', text) AS content,
  coalesce(CASE WHEN turn % 2 = 0 THEN event_min END, sdate, sstart, rtime) AS event_minute FROM flat""")
def _(t):
    raws = ingest.raw_per_turn(nested_requests(t))
    return raws.select("raw_id", *SCOPE, "session_id", "content", _minutes("event_time"))


SESSION_RAWS = NESTED + """, sess AS (
SELECT concat(rq, ':', s) AS raw_id, r, rq, s, ten AS tenant_id, usr AS user_id, session_id,
  string_agg(concat(CASE WHEN turn % 3 = 1 THEN 'ann' ELSE role END, ': ', text), chr(10) ORDER BY turn) AS content,
  any_value(coalesce(sdate, sstart, rtime)) AS event_minute FROM flat GROUP BY ALL)
"""


@query("raw_per_session", "turns", SESSION_RAWS + """
SELECT raw_id, tenant_id, user_id, session_id, content, event_minute FROM sess""")
def _(t):
    raws = ingest.raw_per_session(nested_requests(t))
    return raws.select("raw_id", *SCOPE, "session_id", "content", _minutes("event_time"))


@query("raw_metadata", "turns", NESTED + """
SELECT concat(rq, ':', s, ':', turn) AS raw_id, concat_ws(',', concat('agent_id=a', r % 2),
  CASE WHEN turn % 2 = 1 THEN concat('dia_id=D', turn) END, CASE WHEN turn % 4 = 0 THEN 'has_answer=true' END,
  CASE WHEN r % 3 > 0 THEN concat('idempotency_key=k', r % 2) END, 'min_read_consistency=0',
  CASE WHEN conv_id % 2 = 0 THEN 'speaker_a=ann' END, 'speaker_b=bob', 'src=test',
  concat('turn_index=', turn)) AS metadata FROM flat""")
def _(t):
    entries = F.transform(
        F.sort_array(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return ingest.raw_per_turn(nested_requests(t)).select("raw_id", F.array_join(entries, ",").alias("metadata"))


@query("cell_insert_new", "cells", """
incoming AS (SELECT mem_cell_id, 2 AS seq, length(text) AS n_chars FROM cells
  UNION ALL SELECT mem_cell_id, 1, n_raw FROM cells)
SELECT mem_cell_id, min(seq) AS seq, min_by(n_chars, seq) AS n_chars FROM incoming
WHERE mem_cell_id NOT IN (SELECT mem_cell_id FROM cells WHERE embedding IS NOT NULL) GROUP BY 1""")
def _(t):
    cells = t["cells"]
    incoming = cells.select("mem_cell_id", F.lit(2).alias("seq"), F.length("text").alias("n_chars")).unionAll(
        cells.select("mem_cell_id", F.lit(1), "n_raw")
    )
    return store.insert_new(cells.filter("embedding IS NOT NULL"), incoming, "mem_cell_id", ["seq"])


@query("cell_merge", "cells", """
u AS (SELECT concat('d', doc_id) AS mem_cell_id, CAST(max(quality) AS DOUBLE) AS strength FROM labels GROUP BY 1)
SELECT c.mem_cell_id, c.tenant_id, c.user_id, coalesce(u.strength, c.strength) AS strength, c.importance_score,
  u.mem_cell_id IS NOT NULL AS changed FROM cells c LEFT JOIN u USING (mem_cell_id)""")
def _(t):
    scope = [F.concat(F.lit(p), (F.col("doc_id") % n).cast("string")).alias(c) for p, n, c in
             (("t", 3, "tenant_id"), ("u", 20, "user_id"))]
    updates = t["labels"].groupBy(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("mem_cell_id"), *scope).agg(
        F.max("quality").cast("double").alias("strength"), F.lit(None).cast("double").alias("importance_score")
    )
    base = t["cells"].select("mem_cell_id", *SCOPE, "strength", "importance_score")
    return store.merge(base, updates, ["mem_cell_id", *SCOPE], ["strength", "importance_score"])


@query("cell_delete", "cells", """
gone AS (SELECT concat('d', doc_id) AS mem_cell_id FROM labels WHERE toxic = 1)
SELECT mem_cell_id, CASE WHEN mem_cell_id IN (SELECT mem_cell_id FROM gone) THEN 'deleted' ELSE 'kept' END AS outcome
FROM cells""")
def _(t):
    ids = t["labels"].filter("toxic = 1").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("mem_cell_id"))
    kept, gone = store.delete(t["cells"].select("mem_cell_id"), ids, ["mem_cell_id"])
    return kept.withColumn("outcome", F.lit("kept")).unionByName(gone.withColumn("outcome", F.lit("deleted")))


@query("text_index_docs", "stated", """
SELECT mem_cell_id, tenant_id, user_id, session_id, state, text, age_days AS created_at FROM stated""")
def _(t):
    return store.text_index_docs(t["stated"].withColumn("created_at", F.col("age_days")))


@query("vector_upsert", "", """
WITH r AS (SELECT vec_id AS id, 0 AS seq, label FROM embeddings
  UNION ALL SELECT vec_id * 2, 1, label + 100 FROM embeddings)
SELECT id, max(seq) AS seq, max_by(label, seq) AS label FROM r GROUP BY 1""".replace("WITH r", "r"))
def _(t):
    base = t["embeddings"].select(F.col("vec_id").alias("id"), F.lit(0).alias("seq"), "label", "embedding")
    incoming = t["embeddings"].select(
        (F.col("vec_id") * 2).alias("id"), F.lit(1).alias("seq"), (F.col("label") + 100).alias("label"), "embedding"
    )
    return store.vector_upsert(base, incoming, "id", "seq").select("id", "seq", "label")


@query("index_fanout", "cells", """
SELECT 'text' AS sink, mem_cell_id, NULL AS error FROM cells WHERE length(text) <= 20000
UNION ALL SELECT 'vector', mem_cell_id, NULL FROM cells WHERE embedding IS NOT NULL AND importance_score > -10
UNION ALL SELECT 'dlq:es', mem_cell_id, 'text rejected' FROM cells WHERE length(text) <= 20000 IS NOT TRUE
UNION ALL SELECT 'dlq:milvus', mem_cell_id, 'vector rejected' FROM cells
  WHERE embedding IS NOT NULL AND importance_score > -10 IS NOT TRUE""")
def _(t):
    docs, vectors, dead = store.index_fanout(
        t["cells"], F.lit(0), F.length("text") <= 20000, F.col("importance_score") > -10
    )
    none = F.lit(None).cast("string").alias("error")
    return (
        docs.select(F.lit("text").alias("sink"), "mem_cell_id", none)
        .unionAll(vectors.select(F.lit("vector"), "mem_cell_id", none))
        .unionAll(dead.select(F.concat(F.lit("dlq:"), F.col("target")), "mem_cell_id", "error"))
    )


@query("dlq_stats", "dlq", """
SELECT target, count(*) AS n FROM dlq GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM dlq""")
def _(t):
    return store.dlq_stats(t["dlq"])


@query("dlq_list", "dlq", "SELECT * FROM dlq WHERE target = 'es' ORDER BY ts DESC, event_id DESC LIMIT 50")
def _(t):
    return store.dlq_list(t["dlq"], "es", 50)


@query("dlq_retain", "dlq", """
SELECT target, count(*) AS n, min(event_id) AS oldest FROM
(SELECT * FROM dlq ORDER BY ts DESC, event_id DESC LIMIT 1000) GROUP BY 1""")
def _(t):
    return store.dlq_retain(t["dlq"], 1000).groupBy("target").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("oldest")
    )


VERDICTS = """
v AS (SELECT d.*, CASE WHEN retry_count >= 5 THEN 'exhausted' WHEN target NOT IN ('es', 'milvus') THEN 'skipped'
  WHEN c.mem_cell_id IS NULL THEN 'skipped' WHEN target = 'milvus' AND c.embedding IS NULL THEN 'skipped'
  WHEN event_id % 11 <> 0 THEN 'ok' ELSE 'failed' END AS status
  FROM dlq d LEFT JOIN cells c USING (mem_cell_id))
"""


def verdicts(t: Tables) -> DataFrame:
    return store.reconcile(t["dlq"], t["cells"], retry_ok=F.col("event_id") % 11 != 0)


@query("reconcile", "dlq cells", VERDICTS + "SELECT event_id, target, mem_cell_id, retry_count, status FROM v")
def _(t):
    return verdicts(t).select("event_id", "target", "mem_cell_id", "retry_count", "status")


@query("reconcile_summary", "dlq cells", VERDICTS + "SELECT status, count(*) AS n FROM v GROUP BY 1")
def _(t):
    return store.reconcile_summary(verdicts(t))


@query("reconcile_remaining", "dlq cells", VERDICTS + """
SELECT event_id, target, retry_count + CASE WHEN status = 'failed' THEN 1 ELSE 0 END AS retry_count
FROM v WHERE status <> 'ok'""")
def _(t):
    return store.reconcile_remaining(verdicts(t)).select("event_id", "target", "retry_count")


@query("index_drift", "cells", """
i AS (SELECT concat('d', vec_id * 2) AS mem_cell_id FROM embeddings)
SELECT mem_cell_id, 'missing' AS drift FROM cells WHERE mem_cell_id NOT IN (SELECT mem_cell_id FROM i)
UNION ALL SELECT mem_cell_id, 'orphan' FROM i WHERE mem_cell_id NOT IN (SELECT mem_cell_id FROM cells)""")
def _(t):
    index = t["embeddings"].select(F.concat(F.lit("d"), (F.col("vec_id") * 2).cast("string")).alias("mem_cell_id"))
    return store.index_drift(t["cells"], index, "mem_cell_id")


@query("scoped_read", "cells", """
SELECT 'both' AS mode, mem_cell_id FROM cells WHERE tenant_id = 't1' AND user_id = 'u1'
UNION ALL SELECT 'none', mem_cell_id FROM cells""")
def _(t):
    out = None
    for mode, scope in (("both", ("t1", "u1")), ("none", (None, None)), ("partial", ("t1", None))):
        rows = t["cells"].filter(store.scope_pred(*scope)).select(F.lit(mode).alias("mode"), "mem_cell_id")
        out = rows if out is None else out.unionAll(rows)
    return out


@query("fetch_by_ids", "queries cells", """
w AS (SELECT query_id, tenant_id, user_id, unnest(['gone', concat('d', CAST(substr(query_id, 2) AS BIGINT) + 60),
  concat('d', substr(query_id, 2)), concat('d', CAST(substr(query_id, 2) AS BIGINT) + 60)]) AS mem_cell_id,
  unnest([0, 1, 2, 3]) AS pos FROM queries)
SELECT query_id, mem_cell_id, min(pos) AS pos, any_value(length(text)) AS n_chars
FROM w JOIN cells USING (tenant_id, user_id, mem_cell_id) GROUP BY 1, 2""")
def _(t):
    item = F.col("item_id").cast("string")
    far = F.concat(F.lit("d"), (item.cast("bigint") + 60).cast("string"))
    ids = F.array(F.lit("gone"), far, F.concat(F.lit("d"), item), far)
    requests = t["queries"].select("query_id", *SCOPE, ids.alias("ids"))
    return store.fetch_by_ids(t["cells"], requests).select(
        "query_id", "mem_cell_id", "pos", F.length("text").alias("n_chars")
    )


@query("by_state", "stated", "SELECT tenant_id, user_id, mem_cell_id FROM stated WHERE state = 'COLD'")
def _(t):
    return store.by_state(t["stated"], "COLD").select(*SCOPE, "mem_cell_id")


@query("count_cells", "cells", "SELECT tenant_id, user_id, count(*) AS n FROM cells GROUP BY 1, 2")
def _(t):
    return store.count_cells(t["cells"])


@query("user_memories", "cells", """
SELECT * FROM (SELECT tenant_id, user_id, mem_cell_id,
  row_number() OVER (PARTITION BY tenant_id, user_id ORDER BY age_days, mem_cell_id) AS pos FROM cells)
WHERE pos <= 20""")
def _(t):
    cells = t["cells"].withColumn("created_at", -F.col("age_days"))
    return store.user_memories(cells, 20).select(*SCOPE, "mem_cell_id", "pos")


@query("channel_filters", "stated", """
SELECT 'bm25' AS channel, mem_cell_id FROM stated WHERE lang = 'en' AND session_id = 's3'
UNION ALL SELECT 'vector', mem_cell_id FROM stated WHERE state = 'COLD' AND embedding IS NOT NULL""")
def _(t):
    text = store.channel_filters(t["stated"], {"lang": "en", "session_id": "s3", "state": None})
    vector = store.channel_filters(
        t["stated"].filter("embedding IS NOT NULL"), {"lang": "en", "state": "COLD"}, store.VECTOR_FILTERS
    )
    return text.select(F.lit("bm25").alias("channel"), "mem_cell_id").unionAll(
        vector.select(F.lit("vector"), "mem_cell_id")
    )


# --- segmentation -------------------------------------------------------------------------------------------------


@query("gap_segments", "raws", """
g AS (SELECT *, event_min - lag(event_min) OVER (PARTITION BY tenant_id, user_id, request_id ORDER BY pos) > 30 AS cut FROM raws)
SELECT raw_id, request_id, CAST(sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER
  (PARTITION BY tenant_id, user_id, request_id ORDER BY pos) AS BIGINT) AS segment FROM g""")
def _(t):
    return ingest.gap_segments(t["raws"]).select("raw_id", "request_id", "segment")


SEGMENTS = """
ordered AS (SELECT * REPLACE (concat(tenant_id, '/', user_id, '/', request_id) AS request_id),
  row_number() OVER (PARTITION BY tenant_id, user_id, request_id ORDER BY pos, raw_id) AS i FROM raws),
walk AS (
  SELECT request_id, i, raw_id, event_min, CAST(0 AS BIGINT) AS segment, 1 AS turns, length(content) AS chars
  FROM ordered WHERE i = 1
  UNION ALL
  SELECT o.request_id, o.i, o.raw_id, o.event_min, w.segment + cut, CASE WHEN cut = 1 THEN 1 ELSE w.turns + 1 END,
    CASE WHEN cut = 1 THEN 0 ELSE w.chars END + length(o.content)
  FROM walk w JOIN ordered o ON o.request_id = w.request_id AND o.i = w.i + 1,
  LATERAL (SELECT CASE WHEN o.event_min - w.event_min > 30 OR w.turns >= 3 OR w.chars // 4 >= 256
    THEN 1 ELSE 0 END AS cut))
"""


def segmented(t: Tables) -> DataFrame:
    return ingest.segment(t["raws"], 30, 3, 256)


@query("segment", "raws", SEGMENTS + "SELECT raw_id, split_part(request_id, '/', 3) AS request_id, segment FROM walk")
def _(t):
    return segmented(t).select("raw_id", "request_id", "segment")


CELLS_BUILT = SEGMENTS + """, built AS (
SELECT concat(w.request_id, '#', w.segment) AS mem_cell_id, min_by(r.tenant_id, r.pos) AS tenant_id,
  min_by(r.user_id, r.pos) AS user_id, min_by(r.session_id, r.pos) AS session_id,
  string_agg(r.raw_id, ',' ORDER BY r.pos) AS raw_ids, string_agg(r.content, chr(10) ORDER BY r.pos) AS text,
  min_by(r.event_min, r.pos) AS event_min
FROM walk w JOIN raws r USING (raw_id) GROUP BY w.request_id, w.segment)
"""


@query("build_cells", "raws", CELLS_BUILT + "SELECT * FROM built")
def _(t):
    return ingest.build_cells(segmented(t)).select(
        "mem_cell_id", *SCOPE, "session_id", F.array_join("raw_data_ids", ",").alias("raw_ids"), "text", "event_min"
    )


@query("numbered_text", "raws", SEGMENTS + """,
p AS (SELECT w.request_id, w.segment, w.i, trim(replace(r.content, chr(10), ' ')) AS line,
  row_number() OVER (PARTITION BY w.request_id, w.segment ORDER BY w.i) - 1 AS n FROM walk w JOIN raws r USING (raw_id))
SELECT split_part(request_id, '/', 3) AS request_id, segment, string_agg(concat('[', n, '] ', line), chr(10) ORDER BY n) AS body
FROM p GROUP BY p.request_id, 2""")
def _(t):
    lines = F.transform(F.sort_array(F.collect_list(F.struct("pos", "content"))), lambda r: r["content"])
    return segmented(t).groupBy(*REQUEST, "segment").agg(numbered_text(lines).alias("body")).select("request_id", "segment", "body")


@query("split_at", "raws", SEGMENTS + """,
answer AS (SELECT request_id, segment, min(length(raw_id)) % 3 AS b FROM walk GROUP BY 1, 2),
placed AS (SELECT w.*, row_number() OVER (PARTITION BY request_id, segment ORDER BY i) - 1 AS p FROM walk w),
halves AS (SELECT p.*, CASE WHEN b > 0 AND p.p >= b THEN 1 ELSE 0 END AS half
  FROM placed p JOIN answer USING (request_id, segment))
SELECT raw_id, split_part(request_id, '/', 3) AS request_id, dense_rank() OVER (PARTITION BY h.request_id ORDER BY segment, half) - 1 AS segment
FROM halves h""")
def _(t):
    parts = segmented(t)
    answers = parts.groupBy(*REQUEST, "segment").agg((F.min(F.length("raw_id")) % 3).alias("boundary_index"))
    return ingest.split_at(parts, answers).select("raw_id", "request_id", "segment")


@query("stream_dedupe_batch", "turns", """
SELECT tenant_id, user_id, role, min(event_min) AS event_min, min_by(session_id, event_min) AS session_id
FROM turns GROUP BY 1, 2, 3""")
def _(t):
    first = jobs.first_claim(t["turns"], ["tenant_id", "user_id", "role"], F.struct("event_min", "conv_id"))
    return first.select("tenant_id", "user_id", "role", "event_min", "session_id")


INGEST_SQL = SESSION_RAWS + """,
asking AS (SELECT DISTINCT r, r % 30 AS c, r // 15 * 10 AS hour FROM base WHERE r % 3 > 0),
turn_of AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY hour, r) AS n FROM asking),
claim AS (SELECT r, c, n, hour AS since, r AS holder FROM turn_of WHERE n = 1
  UNION ALL SELECT t.r, t.c, t.n, CASE WHEN t.hour - p.since >= 24 THEN t.hour ELSE p.since END,
    CASE WHEN t.hour - p.since >= 24 THEN t.r ELSE p.holder END
  FROM claim p JOIN turn_of t ON t.c = p.c AND t.n = p.n + 1),
kept AS (SELECT * REPLACE (concat(tenant_id, '/', user_id, '/', rq) AS rq), row_number() OVER (PARTITION BY r ORDER BY s) AS i FROM sess
  WHERE r % 3 = 0 OR r IN (SELECT r FROM claim WHERE holder = r)),
walk AS (SELECT rq, i, raw_id, event_minute, content, tenant_id, user_id, CAST(0 AS BIGINT) AS segment, 1 AS turns,
    length(content) AS chars FROM kept WHERE i = 1
  UNION ALL SELECT o.rq, o.i, o.raw_id, o.event_minute, o.content, o.tenant_id, o.user_id, w.segment + cut,
    CASE WHEN cut = 1 THEN 1 ELSE w.turns + 1 END, CASE WHEN cut = 1 THEN 0 ELSE w.chars END + length(o.content)
  FROM walk w JOIN kept o ON o.rq = w.rq AND o.i = w.i + 1, LATERAL (SELECT CASE
    WHEN o.event_minute - w.event_minute > 30 OR w.turns >= 20 OR w.chars // 4 >= 512 THEN 1 ELSE 0 END AS cut)),
made AS (SELECT concat(rq, '#', segment) AS mem_cell_id, min(tenant_id) AS tenant_id, min(user_id) AS user_id,
  string_agg(raw_id, ',' ORDER BY i) AS raw_ids, string_agg(content, chr(10) ORDER BY i) AS text
  FROM walk GROUP BY rq, segment HAVING NOT (min(tenant_id) = 't1' AND segment = 0))
"""


def ingested(t: Tables) -> jobs.Ingested:
    """The first cell of every request of tenant t1 counts as stored already."""
    requests = nested_requests(t)
    first = F.concat_ws("/", "tenant_id", "user_id", "request_id")
    stored = requests.filter("tenant_id = 't1'").select(F.concat(first, F.lit("#0")).alias("mem_cell_id"))
    return jobs.job_ingest(requests, stored, F.lit(0))


@query("job_ingest", "turns", INGEST_SQL + "SELECT * FROM made")
def _(t):
    return ingested(t).cells.select("mem_cell_id", *SCOPE, F.array_join("raw_data_ids", ",").alias("raw_ids"), "text")


@query("job_ingest_tables", "turns", INGEST_SQL + """
SELECT 'text' AS "table", mem_cell_id AS id, md5(text) AS value FROM made
UNION ALL SELECT 'claim', concat(t.r // 3, '/', t.r % 3, '/', t.r % 5), concat('r', holder // 3) FROM claim t""")
def _(t):
    """Text documents and claims; no cell has a vector yet, and nothing is rejected."""
    done = ingested(t)
    held = F.concat_ws("/", F.substring("request_id", 2, 20), F.substring("tenant_id", 2, 20), F.substring("user_id", 2, 20))
    rows = lambda df, name, key, value: df.select(F.lit(name).alias("table"), key.alias("id"), value.alias("value"))
    out = rows(done.text_docs, "text", F.col("mem_cell_id"), F.md5(F.col("text").cast("binary")))
    out = out.unionByName(rows(done.claims, "claim", held, F.col("holder")))
    out = out.unionByName(rows(done.vectors, "vector", F.col("mem_cell_id"), F.lit("")))
    return out.unionByName(rows(done.dead_letters, "dead", F.col("mem_cell_id"), F.col("error")))
