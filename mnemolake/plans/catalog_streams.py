"""Stream queries, each run to the end of its input, and the rate limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.operators import limits, params
from mnemolake.plans.catalog_memory import FOLD_SQL, r6, scene_sql
from mnemolake.plans.catalog_store import SEGMENTS
from mnemolake.plans.registry import query
from mnemolake.schemas import SCOPE
from mnemolake.session import scratch_path
from mnemolake.sources.views import Tables
from mnemolake.streaming import operators as streams
from mnemolake.streaming.runs import to_table


LIMIT_SQL = """
o AS (SELECT event_type AS key, event_id, epoch_us(ts) AS t,
  row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
walk AS (SELECT key, event_id, i, [t] AS taken, true AS accepted FROM o WHERE i = 1
  UNION ALL SELECT key, event_id, i, CASE WHEN len(old) < 20 THEN list_append(old, t) ELSE old END, len(old) < 20
  FROM (SELECT o.*, list_filter(w.taken, lambda x: x > o.t - 3600000000) AS old
    FROM walk w JOIN o ON o.key = w.key AND o.i = w.i + 1))
SELECT key, event_id, accepted FROM walk"""


class StreamTables(Tables):
    """The same views, with some base tables read as file streams."""

    def __init__(self, spark, folder: str, *names: str) -> None:
        super().__init__(spark, folder)
        self.streamed = names

    def _table(self, name: str) -> DataFrame:
        if name not in self.streamed:
            return super()._table(name)
        schema = self.spark.read.parquet(f"{self.folder}/{name}.parquet").schema
        # A pattern finds the table whether it is one file, which a stream does not take by its name, or a folder of files.
        return self.spark.readStream.schema(schema).parquet(f"{self.folder}/{name}.parque[t]")


def live(t: Tables, *names: str) -> StreamTables:
    return StreamTables(t.spark, t.folder, *names)


@query("stream_dedupe", "", "x AS (SELECT 1) SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events")
def _(t):
    rows = live(t, "events")["events"].withColumn("day", F.to_date("ts"))
    return to_table(streams.stream_dedupe(rows, ["user_id", "event_type", "day"], "ts")).select(
        "user_id", "event_type", "day"
    )


@query("stream_segment", "raws", SEGMENTS + "SELECT raw_id, split_part(request_id, '/', 3) AS request_id, segment FROM walk")
def _(t):
    out = streams.stream_segment(live(t, "conversations")["raws"], 30, 3, 256)
    return to_table(out).select("raw_id", "request_id", "segment")


@query("stream_cluster", "cells", scene_sql("concat(tenant_id, '|', user_id, '|', session_id)", "''"))
def _(t):
    cells = live(t, "documents")["cells"].withColumn("at", -F.col("age_days"))
    out = to_table(streams.stream_cluster(cells, sim=0.2, gap_days=30))
    return out.select(*SCOPE, "mem_cell_id", "scene_id", r6(F.col("similarity"), "similarity"), "is_new")


@query("stream_feedback", "cells feedback", FOLD_SQL + """
SELECT mem_cell_id, tenant_id, user_id, round(old_strength, 6) AS old_strength, round(new_strength, 6) AS strength,
  access_count, n_events FROM fold""")
def _(t):
    events = streams.feedback_events(live(t, "events")["feedback"], t["cells"])
    rows = to_table(streams.stream_feedback(events), "update")
    rest = ["old_strength", "strength", "access_count", "n_events"]
    newest = rows.groupBy("mem_cell_id", *SCOPE).agg(F.max_by(F.struct(*rest), "n_events").alias("s"))
    return newest.select(
        "mem_cell_id", *SCOPE, r6(F.col("s.old_strength"), "old_strength"), r6(F.col("s.strength"), "strength"),
        "s.access_count", "s.n_events",
    )


@query("stream_fanout", "cells", """
SELECT 'text' AS sink, mem_cell_id FROM cells WHERE length(text) <= 20000
UNION ALL SELECT 'vector', mem_cell_id FROM cells WHERE embedding IS NOT NULL AND importance_score > -10
UNION ALL SELECT 'dlq', mem_cell_id FROM cells WHERE length(text) <= 20000 IS NOT TRUE
UNION ALL SELECT 'dlq', mem_cell_id FROM cells WHERE embedding IS NOT NULL AND importance_score > -10 IS NOT TRUE""")
def _(t):
    root = scratch_path(t.spark, "fanout")
    paths = {name: f"{root}/{name}" for name in ("text", "vector", "dlq")}
    streams.stream_fanout(
        live(t, "documents")["cells"], paths, F.lit(0), text_ok=F.length("text") <= 20000,
        vector_ok=F.col("importance_score") > -10,
    )
    out = None
    for name, path in paths.items():
        rows = t.spark.read.parquet(path).select(F.lit(name).alias("sink"), "mem_cell_id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("stream_limit", "", LIMIT_SQL)
def _(t):
    return to_table(streams.stream_limit(live(t, "events")["events"], "event_type", "ts", 20, 3600)).select(
        "key", "event_id", "accepted"
    )


@query("moving_window_limit", "", LIMIT_SQL)
def _(t):
    return limits.moving_window_limit(t["events"], "event_type", "ts", 20, 3600)


@query("trailing_counts", "", """
x AS (SELECT event_type AS key, event_id, epoch_us(ts) AS at_us FROM events)
SELECT key, event_id, count(*) OVER (PARTITION BY key ORDER BY at_us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n FROM x""")
def _(t):
    return limits.trailing_counts(t["events"], "event_type", "ts", 3600)


@query("change_events", "", """
x AS (SELECT CASE event_type WHEN 'view' THEN 'insert' WHEN 'click' THEN 'update' WHEN 'purchase' THEN 'replace' ELSE 'delete' END
  AS op, CASE WHEN user_id % 6 <> 5 THEN concat('cat', user_id % 6) END AS category, event_id FROM events)
SELECT category, 'global' AS scope, CAST(event_id AS STRING) AS name, 0 AS version, 'system' AS actor FROM x
WHERE op <> 'delete' AND category IS NOT NULL""")
def _(t):
    kind = F.create_map(*(F.lit(x) for x in ("view", "insert", "click", "update", "purchase", "replace")))
    six = F.col("user_id") % 6
    changes = live(t, "events")["events"].select(
        F.coalesce(F.try_element_at(kind, F.col("event_type")), F.lit("delete")).alias("operation_type"),
        F.when(six != 5, F.concat(F.lit("cat"), six.cast("string"))).alias("category"),
        F.lit(None).cast("string").alias("scope"), F.lit(None).cast("string").alias("scope_id"),
        F.col("event_id").cast("string").alias("name"), F.lit(None).cast("int").alias("version"),
        F.lit(None).cast("string").alias("actor"),
    )
    return to_table(params.change_events(changes)).select("category", "scope", "name", "version", "actor")
