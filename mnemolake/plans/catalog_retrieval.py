"""Queries over recall, fusion, ranking, entities and the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.functions import text as text_fn
from mnemolake.functions.core import unnest
from mnemolake.functions.vectors import cosine, ip, neg_l2
from mnemolake.operators import graph, ranking, recall, store
from mnemolake.plans import jobs
from mnemolake.plans.registry import query
from mnemolake.schemas import QUERY, SCOPE
from mnemolake.session import materialize
from mnemolake.sources.views import Tables

TOP = 20  # hits per channel in the ranking queries

# --- SQL pieces ---------------------------------------------------------------------------------------------------

BM25 = """
tok AS (SELECT tenant_id, user_id, mem_cell_id,
  unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM cells),
post AS (SELECT tenant_id, user_id, mem_cell_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT mem_cell_id, count(*) AS dl FROM tok GROUP BY 1),
st AS (SELECT (SELECT count(*) FROM cells) AS n, (SELECT count(*) FROM tok) / (SELECT count(*) FROM cells) AS al),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
asked AS (SELECT query_id, tenant_id, user_id, term, count(*) AS qtf FROM (SELECT query_id, tenant_id, user_id,
  unnest(regexp_extract_all(lower(query), '[\\p{L}\\p{N}]+')) AS term FROM queries) GROUP BY ALL),
bscore AS (SELECT query_id, tenant_id, user_id, mem_cell_id AS memory_id,
  sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf
    / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / al))) AS score
  FROM asked JOIN post USING (tenant_id, user_id, term) JOIN dfs USING (term) JOIN dl USING (mem_cell_id), st
  GROUP BY ALL),
brank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY SIGNIFICANT(score) DESC, memory_id) - 1 AS rank
  FROM bscore)
"""

COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def vector_sql(score: str) -> str:
    return f"""
vscore AS (SELECT query_id, q.tenant_id, q.user_id, mem_cell_id AS memory_id, {score} AS score
  FROM queries q JOIN cells c ON q.tenant_id = c.tenant_id AND q.user_id = c.user_id
  WHERE c.embedding IS NOT NULL AND q.query_vec IS NOT NULL),
vrank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY SIGNIFICANT(score) DESC, memory_id) - 1 AS rank
  FROM vscore)
"""


VECTOR = vector_sql(COS.format(a="query_vec", b="embedding"))


def hits_sql(n: int = TOP) -> str:
    return BM25 + "," + VECTOR + f""",
hits AS (SELECT query_id, tenant_id, user_id, 'bm25' AS channel, memory_id, score, rank FROM brank WHERE rank < {n}
  UNION ALL SELECT query_id, tenant_id, user_id, 'vector', memory_id, score, rank FROM vrank WHERE rank < {n})
"""


HITS = hits_sql()


def ents_sql(name: str, source: str, keys: str, column: str) -> str:
    """Entities of a text: four patterns, best kind per form, no parts of same-kind entities, 20 at most.

    Letters outside ASCII become `_` so that word borders agree with Unicode rules in an ASCII-border engine.
    """
    return f"""
{name}_raw AS (SELECT {keys}, {column} AS full_text, regexp_replace({column}, '[À-ɏ]', '_', 'g') AS plain
  FROM {source}),
{name}_all AS (
  SELECT {keys}, 0 AS kind, unnest(regexp_extract_all(full_text, '["「『“‘]([^"」』”’]{{2,40}})["」』”’]', 1)) AS t,
    generate_subscripts(regexp_extract_all(full_text, '["「『“‘]([^"」』”’]{{2,40}})["」』”’]', 1), 1) AS p FROM {name}_raw
  UNION ALL SELECT {keys}, 1, unnest(regexp_extract_all(plain, '\\b([A-Z][a-zA-Z]+(?:[\\s-][A-Z][a-zA-Z]+)*)\\b', 1)),
    generate_subscripts(regexp_extract_all(plain, '\\b([A-Z][a-zA-Z]+(?:[\\s-][A-Z][a-zA-Z]+)*)\\b', 1), 1) FROM {name}_raw
  UNION ALL SELECT {keys}, 3, unnest(regexp_extract_all(plain, '\\b([a-zA-Z]{{3,20}})\\b', 1)),
    generate_subscripts(regexp_extract_all(plain, '\\b([a-zA-Z]{{3,20}})\\b', 1), 1) FROM {name}_raw),
{name}_one AS (SELECT {keys}, kind, p, trim(t, ' ' || chr(10) || chr(9) || chr(13)) AS e FROM {name}_all),
{name}_form AS (SELECT *, lower(e) AS f FROM {name}_one WHERE length(e) >= 2 AND lower(e) NOT IN ({', '.join(
    "'" + w + "'" for w in text_fn.STOP_WORDS)})
  QUALIFY row_number() OVER (PARTITION BY {keys}, lower(e) ORDER BY kind, p) = 1),
{name}_kept AS (SELECT a.*, row_number() OVER (PARTITION BY {keys_of('a', keys)} ORDER BY kind, -length(e), p) AS r
  FROM {name}_form a WHERE NOT EXISTS (SELECT 1 FROM {name}_form b WHERE {same(keys)} AND b.kind = a.kind
    AND b.f <> a.f AND length(b.f) > length(a.f) AND contains(b.f, a.f))),
{name} AS (SELECT {keys}, e AS entity, r - 1 AS pos, kind FROM {name}_kept WHERE r <= 20)
"""


def keys_of(alias: str, keys: str) -> str:
    return ", ".join(f"{alias}.{k.strip()}" for k in keys.split(","))


def same(keys: str) -> str:
    return " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))


CELL_ENTS = ents_sql("ce", "cells", "tenant_id, user_id, mem_cell_id", "text")
QUERY_ENTS = ents_sql("qe", "queries", "query_id, tenant_id, user_id", "query")

# --- Spark pieces -------------------------------------------------------------------------------------------------


def score6():
    return F.round("score", 6).alias("score")


def bm25_hits(t: Tables, k: int = TOP) -> DataFrame:
    index = materialize(recall.text_index(t["cells"]), "text-index")
    return recall.bm25_topk(t["queries"], recall.postings_of(index), recall.stats_of(index), k)


def vector_hits(t: Tables, k: int = TOP, metric: str = "COSINE") -> DataFrame:
    return recall.vector_topk(t["queries"], t["cells"], k, metric)


def channel_hits(t: Tables) -> DataFrame:
    return ranking.union_fuse([bm25_hits(t), vector_hits(t)])


def cell_ents(t: Tables) -> DataFrame:
    return graph.cell_entities(t["cells"], text_fn.extract_entities(F.col("text")))


def asked_ents(t: Tables) -> DataFrame:
    return recall.query_entities(t["queries"], text_fn.extract_entities)


# --- recall -------------------------------------------------------------------------------------------------------


@query("bm25_postings", "cells queries", BM25 + """
SELECT tenant_id, user_id, mem_cell_id, term, tf, dl FROM post JOIN dl USING (mem_cell_id)""", query_ids=False)
def _(t):
    return recall.bm25_postings(t["cells"]).select(*SCOPE, "mem_cell_id", "term", "tf", "dl")


@query("corpus_stats", "cells queries", BM25 + """
SELECT n AS n_docs, (SELECT count(*) FROM tok) AS n_terms, round(al, 6) AS avg_len FROM st""", query_ids=False)
def _(t):
    return recall.corpus_stats(t["cells"]).withColumn("avg_len", F.round("avg_len", 6))


@query("bm25_topk", "cells queries", BM25 + f"""
SELECT query_id, tenant_id, user_id, memory_id, round(score, 6) AS score, rank FROM brank WHERE rank < {TOP}""")
def _(t):
    return bm25_hits(t).select("query_id", *SCOPE, "memory_id", score6(), "rank")


@query("vector_topk", "cells queries", VECTOR + f"""
SELECT query_id, tenant_id, user_id, memory_id, round(score, 6) AS score, rank FROM vrank WHERE rank < {TOP}""")
def _(t):
    return vector_hits(t).select("query_id", *SCOPE, "memory_id", score6(), "rank")


@query("vector_topk_l2", "cells queries", vector_sql(
    "-sqrt(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: "
    "pow(CAST(query_vec[i] AS DOUBLE) - CAST(embedding[i] AS DOUBLE), 2))))") + f"""
SELECT query_id, tenant_id, user_id, memory_id, round(score, 6) AS score FROM vrank WHERE rank < {TOP}""")
def _(t):
    return vector_hits(t, metric="L2").select("query_id", *SCOPE, "memory_id", score6())


def ann_recall(t: Tables, nprobe: int) -> DataFrame:
    """Recall of the approximate against the exact top 10, per query."""
    near = recall.vector_ann(t["queries"], t["cells"], 10, n_cells=16, nprobe=nprobe)
    exact = vector_hits(t, 10).select(*QUERY, "memory_id")
    found = near.select(*QUERY, "memory_id", F.lit(1).alias("hit"))
    joined = exact.join(found, [*QUERY, "memory_id"], "left")
    return joined.groupBy(*QUERY).agg(
        F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found"),
        F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall"),
    ).drop(*SCOPE)


@query("vector_ann")
def _(t):
    return ann_recall(t, 8)


@query("vector_ann_all_lists", "cells queries", VECTOR + """
SELECT query_id, count(*) AS wanted, count(*) AS found, CAST(1 AS DOUBLE) AS recall FROM vrank WHERE rank < 10 GROUP BY 1""")
def _(t):
    return ann_recall(t, 16)


@query("entity_topk", "cells queries", CELL_ENTS + "," + QUERY_ENTS + """,
n AS (SELECT query_id, count(*) AS n FROM qe GROUP BY 1),
found AS (SELECT DISTINCT query_id, tenant_id, user_id, mem_cell_id FROM qe JOIN ce USING (tenant_id, user_id, entity)),
inside AS (SELECT f.query_id, f.tenant_id, f.user_id, f.mem_cell_id AS memory_id,
  count(*) FILTER (contains(c.text, q.entity)) AS hit
  FROM found f JOIN cells c USING (mem_cell_id) JOIN qe q ON q.query_id = f.query_id GROUP BY ALL),
s AS (SELECT i.*, greatest(1, hit) / greatest(1, n) AS score FROM inside i JOIN n USING (query_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY SIGNIFICANT(score) DESC, memory_id) - 1 AS rank FROM s)
SELECT query_id, tenant_id, user_id, memory_id, round(score, 6) AS score, rank FROM r WHERE rank < 20""")
def _(t):
    hits = recall.entity_topk(asked_ents(t), graph.entity_postings(cell_ents(t)), t["cells"], TOP)
    return hits.select("query_id", *SCOPE, "memory_id", score6(), "rank")


@query("graph_topk", "cells queries", CELL_ENTS + "," + QUERY_ENTS + """,
m AS (SELECT query_id, q.tenant_id, q.user_id, mem_cell_id AS memory_id, min(q.pos) AS pos
  FROM qe q JOIN ce c ON q.tenant_id = c.tenant_id AND q.user_id = c.user_id AND q.entity = c.entity GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos, memory_id) - 1 AS rank FROM m)
SELECT query_id, tenant_id, user_id, memory_id, CAST(1 AS DOUBLE) AS score, rank FROM r WHERE rank < 20""")
def _(t):
    ents = materialize(cell_ents(t), "entities")
    hits = recall.graph_topk(
        asked_ents(t), graph.graph_nodes(ents, t["cells"]), graph.graph_edges(ents), t["cells"], TOP
    )
    return hits.select("query_id", *SCOPE, "memory_id", "score", "rank")


# --- entities and graph -------------------------------------------------------------------------------------------


@query("extract_entities", "cells", CELL_ENTS + """
SELECT mem_cell_id, pos, entity, CASE kind WHEN 0 THEN 'QUOTED' WHEN 1 THEN 'PROPER' WHEN 2 THEN 'COMPOUND'
  ELSE 'NOUN' END AS entity_type, CAST(CASE kind WHEN 0 THEN 0.95 WHEN 1 THEN 0.85 WHEN 2 THEN 0.75 ELSE 0.55 END
  AS DOUBLE) AS confidence FROM ce""")
def _(t):
    found = unnest(t["cells"], ["mem_cell_id"], text_fn.entity_structs(F.col("text")), "pos", "e")
    return found.select(
        "mem_cell_id", "pos", F.col("e.text").alias("entity"), text_fn.entity_kind(F.col("e.kind")).alias("entity_type"),
        text_fn.entity_confidence(F.col("e.kind")).alias("confidence"),
    )


@query("fallback_tokens", "cells", """
w AS (SELECT mem_cell_id, unnest(regexp_extract_all(text, '[一-鿿]{2,}|[A-Za-z]{3,}')) AS token,
  generate_subscripts(regexp_extract_all(text, '[一-鿿]{2,}|[A-Za-z]{3,}'), 1) AS p FROM cells),
f AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY mem_cell_id, lower(token) ORDER BY p) = 1)
SELECT mem_cell_id, row_number() OVER (PARTITION BY mem_cell_id ORDER BY p) - 1 AS pos, token FROM f""")
def _(t):
    return unnest(t["cells"], ["mem_cell_id"], text_fn.fallback_tokens(F.col("text")), "pos", "token")


@query("entity_index", "cells", CELL_ENTS + """
SELECT entity, tenant_id, user_id, count(DISTINCT mem_cell_id) AS ref_count, max(d.age_days) AS updated_at
FROM ce JOIN cells d USING (tenant_id, user_id, mem_cell_id) GROUP BY 1, 2, 3""")
def _(t):
    cells = t["cells"].withColumn("seq", F.col("age_days"))
    return graph.entity_index(graph.cell_entities(cells, text_fn.extract_entities(F.col("text"))))


@query("entity_postings", "cells", CELL_ENTS + "SELECT DISTINCT entity, tenant_id, user_id, mem_cell_id FROM ce")
def _(t):
    return graph.entity_postings(cell_ents(t))


@query("entity_lookup", "cells queries", CELL_ENTS + "," + QUERY_ENTS + """,
f AS (SELECT DISTINCT query_id, tenant_id, user_id, mem_cell_id FROM qe JOIN ce USING (tenant_id, user_id, entity))
SELECT * FROM f""")
def _(t):
    return graph.entity_lookup(graph.entity_postings(cell_ents(t)), asked_ents(t))


@query("entity_remove_cell", "cells", CELL_ENTS + """,
gone AS (SELECT concat('d', doc_id) AS mem_cell_id FROM labels WHERE toxic = 1)
SELECT 'kept' AS outcome, tenant_id, user_id, '' AS mem_cell_id, count(*) AS n FROM ce
  WHERE mem_cell_id NOT IN (SELECT mem_cell_id FROM gone) GROUP BY ALL
UNION ALL SELECT 'changed', tenant_id, user_id, mem_cell_id, count(*) FROM ce
  WHERE mem_cell_id IN (SELECT mem_cell_id FROM gone) GROUP BY ALL""")
def _(t):
    toxic = t["labels"].filter("toxic = 1").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("mem_cell_id")
    )
    removed = t["cells"].join(toxic, "mem_cell_id", "left_semi")
    kept, changed = graph.entity_remove_cell(
        materialize(graph.entity_postings(cell_ents(t)), "postings"), removed
    )
    return kept.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("kept").alias("outcome"), *SCOPE, F.lit("").alias("mem_cell_id"), "n"
    ).unionAll(changed.select(F.lit("changed"), *SCOPE, "mem_cell_id", "changed"))


NODE_SQL = """
SELECT DISTINCT concat('memory:', mem_cell_id) AS node_id, 'memory' AS node_type, tenant_id, user_id,
  mem_cell_id AS label FROM cells
UNION ALL SELECT DISTINCT concat('entity:', tenant_id, ':', user_id, ':', entity), 'entity', tenant_id, user_id, entity
  FROM ce"""


@query("graph_nodes", "cells", CELL_ENTS + NODE_SQL)
def _(t):
    return graph.graph_nodes(cell_ents(t), t["cells"]).select("node_id", "node_type", *SCOPE, "label")


@query("graph_edges", "cells", CELL_ENTS + """
SELECT concat('memory:', mem_cell_id, '|MENTIONS|entity:', tenant_id, ':', user_id, ':', entity) AS edge_id,
  tenant_id, user_id, CAST(0.9 AS DOUBLE) AS confidence, CAST(2 AS DOUBLE) AS strength, mem_cell_id AS source_ids
FROM ce""")
def _(t):
    ents = materialize(cell_ents(t), "entities")
    return graph.graph_edges(ents.unionAll(ents)).select(
        "edge_id", *SCOPE, "confidence", "strength", F.array_join("source_memory_ids", ",").alias("source_ids")
    )


@query("graph_stats", "cells", CELL_ENTS + """, n AS (""" + NODE_SQL + """)
SELECT (SELECT count(DISTINCT (tenant_id, user_id)) FROM n) AS users, (SELECT count(*) FROM n) AS nodes,
  (SELECT count(*) FROM ce) AS edges""")
def _(t):
    ents = materialize(cell_ents(t), "entities")
    return graph.graph_stats(graph.graph_nodes(ents, t["cells"]), graph.graph_edges(ents))


BFS = """,
e AS (SELECT tenant_id, user_id, concat('memory:', mem_cell_id) AS a,
  concat('entity:', tenant_id, ':', user_id, ':', entity) AS b FROM ce),
step AS (SELECT tenant_id, user_id, a AS f, b AS t FROM e UNION ALL SELECT tenant_id, user_id, b, a FROM e),
h0 AS (SELECT query_id, tenant_id, user_id, concat('entity:', tenant_id, ':', user_id, ':', entity) AS n
  FROM qe),
h1 AS (SELECT DISTINCT query_id, h.tenant_id, h.user_id, t AS n FROM h0 h JOIN step s
  ON h.tenant_id = s.tenant_id AND h.user_id = s.user_id AND h.n = s.f),
h2 AS (SELECT DISTINCT query_id, h.tenant_id, h.user_id, t AS n FROM h1 h JOIN step s
  ON h.tenant_id = s.tenant_id AND h.user_id = s.user_id AND h.n = s.f
  WHERE (query_id, t) NOT IN (SELECT (query_id, n) FROM h0)),
h3 AS (SELECT DISTINCT query_id, h.tenant_id, h.user_id, t AS n FROM h2 h JOIN step s
  ON h.tenant_id = s.tenant_id AND h.user_id = s.user_id AND h.n = s.f
  WHERE (query_id, t) NOT IN (SELECT (query_id, n) FROM h1))
"""


def seeds(t: Tables) -> DataFrame:
    return asked_ents(t).select(
        "query_id", *SCOPE, graph.entity_node_id("entity").alias("node_id"), "entity"
    )


@query("graph_traverse", "cells queries", CELL_ENTS + "," + QUERY_ENTS + BFS + """,
every AS (SELECT *, 0 AS hop FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2),
known AS (SELECT DISTINCT f FROM step)
SELECT 'node' AS what, query_id, tenant_id, user_id, n AS id, hop FROM every WHERE n IN (SELECT f FROM known)
UNION ALL SELECT DISTINCT 'edge', query_id, v.tenant_id, v.user_id, concat(a, '|MENTIONS|', b), -1
FROM every v JOIN e ON v.tenant_id = e.tenant_id AND v.user_id = e.user_id AND (v.n = e.a OR v.n = e.b)
WHERE hop < 2""")
def _(t):
    ents = materialize(cell_ents(t), "entities")
    nodes, edges = graph.graph_traverse(
        seeds(t), graph.graph_nodes(ents, t["cells"]), graph.graph_edges(ents), 2, ["mentions"]
    )
    return nodes.select(F.lit("node").alias("what"), "query_id", *SCOPE, F.col("node_id").alias("id"), "hop").unionAll(
        edges.select(F.lit("edge"), "query_id", *SCOPE, "edge_id", F.lit(-1))
    )


@query("related_memories", "cells queries", CELL_ENTS + "," + QUERY_ENTS + BFS + """
SELECT query_id, tenant_id, user_id, substr(n, 8) AS memory_id, 1 AS hop FROM h1
UNION ALL SELECT query_id, tenant_id, user_id, substr(n, 8), 3 FROM h3""")
def _(t):
    ents = materialize(cell_ents(t), "entities")
    return graph.related_memories(
        seeds(t), graph.graph_nodes(ents, t["cells"]), graph.graph_edges(ents), 3
    )


# --- ranking ------------------------------------------------------------------------------------------------------


@query("channel_rank", "cells queries", HITS + """
SELECT query_id, channel, memory_id, row_number() OVER (PARTITION BY query_id, channel
  ORDER BY SIGNIFICANT(score) DESC, memory_id) - 1 AS rank FROM hits""")
def _(t):
    return ranking.channel_rank(channel_hits(t).drop("rank")).select("query_id", "channel", "memory_id", "rank")


@query("threshold_filter", "cells queries", VECTOR + f"""
SELECT query_id, memory_id, round(score, 6) AS score FROM vrank WHERE rank < {TOP} AND score >= 0.1""")
def _(t):
    return store.threshold_filter(vector_hits(t), 0.1).select("query_id", "memory_id", score6())


@query("lifecycle_filter", "stated queries", VECTOR + f"""
SELECT query_id, memory_id FROM vrank WHERE rank < {TOP}
  AND memory_id NOT IN (SELECT mem_cell_id FROM stated WHERE state = 'ARCHIVED')""")
def _(t):
    return store.lifecycle_filter(vector_hits(t), t["stated"]).select("query_id", "memory_id")


@query("channel_enable", "cells queries", HITS + """
SELECT query_id, channel, memory_id FROM hits WHERE CASE CAST(substr(query_id, 2) AS BIGINT) % 3
  WHEN 0 THEN channel = 'bm25' WHEN 1 THEN true ELSE channel = 'vector' END""")
def _(t):
    item = F.col("item_id") % 3
    wanted = F.when(item == 0, F.array(F.lit("bm25"))).when(item == 2, F.array(F.lit("vector"))).otherwise(
        F.array().cast("array<string>")
    )
    requests = t["queries"].select(*QUERY, wanted.alias("channels"))
    return store.channel_enable(channel_hits(t), requests).select("query_id", "channel", "memory_id")


FUSED = HITS + """,
w AS (SELECT *, CASE channel WHEN 'bm25' THEN 0.3::DOUBLE ELSE 0.4::DOUBLE END AS wt FROM hits),
fused AS (SELECT query_id, tenant_id, user_id, memory_id, sum(wt / (60 + rank + 1)) AS score, min(channel) AS source_channel,
  string_agg(channel, ',' ORDER BY channel) AS channels FROM w GROUP BY ALL)
"""


@query("rrf_fuse", "cells queries", FUSED + """
SELECT query_id, tenant_id, user_id, memory_id, round(score, 6) AS score, source_channel, channels FROM fused""")
def _(t):
    return ranking.rrf_fuse(channel_hits(t)).select(
        "query_id", *SCOPE, "memory_id", score6(), "source_channel", F.array_join("channels", ",").alias("channels")
    )


@query("rrf_fuse_weights", "cells queries", HITS + """,
w AS (SELECT *, CASE WHEN channel = 'bm25' THEN 0.3::DOUBLE WHEN CAST(substr(query_id, 2) AS BIGINT) % 2 = 0 THEN 0
  ELSE 0.9::DOUBLE END AS wt FROM hits)
SELECT query_id, memory_id, round(sum(wt / (60 + rank + 1)), 6) AS score FROM w WHERE wt > 0 GROUP BY 1, 2""")
def _(t):
    own = F.when(F.col("item_id") % 2 == 0, F.lit(0.0)).otherwise(F.lit(0.9))
    requests = t["queries"].select(*QUERY, F.create_map(F.lit("vector"), own).alias("weights"))
    return ranking.rrf_fuse(channel_hits(t), requests=requests).select("query_id", "memory_id", score6())


@query("concat_fuse", "cells queries", HITS + """
SELECT query_id, memory_id, round(max(score), 6) AS score FROM hits GROUP BY 1, 2""")
def _(t):
    return ranking.concat_fuse(channel_hits(t)).select("query_id", "memory_id", score6())


@query("union_fuse", "cells queries", HITS + """
SELECT query_id, channel, memory_id, round(score, 6) AS score, rank FROM hits""")
def _(t):
    return channel_hits(t).select("query_id", "channel", "memory_id", score6(), "rank")


SIGNALS = """
signal AS (SELECT tenant_id, user_id, mem_cell_id AS memory_id,
  exp(-age_days / greatest(0.1, 4 * greatest(0.1, strength))) * (0.6::DOUBLE + 0.4::DOUBLE * least(1, access_count / 10))
    AS decay,
  round(0.25::DOUBLE * least(length(text) / 500, 1) + 0.3::DOUBLE * least(0.2::DOUBLE * access_count + 0.1::DOUBLE * strength, 1)
    + 0.25::DOUBLE * exp(-ln(2) * age_days / 30) + 0.2::DOUBLE * least(0.3::DOUBLE * n_raw, 1), 6) AS importance FROM cells)
"""


@query("signal_boost", "cells queries", FUSED + "," + SIGNALS + """,
b AS (SELECT query_id, f.memory_id, score * decay * (1 + importance) AS score FROM fused f JOIN signal USING (memory_id))
SELECT query_id, memory_id, round(score, 8) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY SIGNIFICANT(score) DESC, memory_id) - 1 AS rank FROM b""")
def _(t):
    fused = materialize(ranking.rrf_fuse(channel_hits(t)), "fused")
    boosted = ranking.signal_boost(fused, jobs.retrieval_signals(t["cells"]))
    return ranking.rerank(boosted).select("query_id", "memory_id", F.round("score", 8).alias("score"), "rank")


@query("overfetch", "", "x AS (SELECT 1) " + """
SELECT item_id AS query_id, channel, CASE channel WHEN 'bm25' THEN 16 WHEN 'vector' THEN 16 ELSE 4 END
  * (1 + item_id % 10) AS recall_k
FROM benchmark, (SELECT unnest(['bm25', 'vector', 'entity', 'graph']) AS channel)""")
def _(t):
    per_one = ranking.overfetch(1)
    factor = F.create_map(*(F.lit(x) for pair in per_one.items() for x in pair))
    asked = t["benchmark"].select(F.col("item_id").alias("query_id"), (1 + F.col("item_id") % 10).alias("top_k"))
    return asked.select("query_id", "top_k", F.explode(factor).alias("channel", "n")).select(
        "query_id", "channel", (F.col("n") * F.col("top_k")).alias("recall_k")
    )


@query("final_topk", "cells queries", FUSED + """,
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY SIGNIFICANT(score) DESC, memory_id) - 1 AS rank
  FROM fused)
SELECT query_id, memory_id, round(score, 6) AS score, rank FROM r WHERE rank < 5""")
def _(t):
    return ranking.final_topk(ranking.rrf_fuse(channel_hits(t)), 5).select("query_id", "memory_id", score6(), "rank")


@query("cross_rerank", "cells queries", FUSED + """,
p AS (SELECT query_id, memory_id, coalesce(CASE WHEN length(c.text) % 2 = 0 THEN length(c.text) / 100000 END, score) AS score
  FROM fused f JOIN cells c ON c.mem_cell_id = f.memory_id)
SELECT query_id, memory_id, round(score, 6) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY SIGNIFICANT(score) DESC, memory_id) - 1 AS rank FROM p""")
def _(t):
    fused = materialize(ranking.rrf_fuse(channel_hits(t)), "fused")
    size = F.length("text")
    given = t["cells"].filter(size % 2 == 0).select(F.col("mem_cell_id").alias("memory_id"), (size / 100000).alias("pair_score"))
    scores = fused.select(*QUERY, "memory_id").join(given, "memory_id")
    return ranking.cross_rerank(fused, scores).select("query_id", "memory_id", score6(), "rank")


def mmr_sql(source: str, lam: float, k: int) -> str:
    """Greedy diversity over `source` (query_id, memory_id, score) as a recursive walk; candidates sit in rank order."""
    rest = round(1 - lam, 2)
    return f"""
cand AS (SELECT f.*, c.embedding AS v, row_number() OVER (PARTITION BY query_id ORDER BY SIGNIFICANT(score) DESC, memory_id) AS i
  FROM {source} f JOIN cells c ON c.mem_cell_id = f.memory_id),
sim AS (SELECT x.query_id, x.i, list(CASE WHEN x.v IS NULL OR y.v IS NULL THEN 0 ELSE
  list_cosine_similarity(CAST(x.v AS DOUBLE[]), CAST(y.v AS DOUBLE[])) END ORDER BY y.i) AS sims
  FROM cand x JOIN cand y USING (query_id) GROUP BY 1, 2),
item AS (SELECT query_id, i, memory_id, score, sims FROM cand JOIN sim USING (query_id, i)),
pick AS (SELECT query_id, CAST(0 AS BIGINT) AS rank, i, [i] AS chosen, {lam}::DOUBLE * score AS mmr_score FROM item WHERE i = 1
  UNION ALL
  SELECT query_id, rank + 1, g.i, list_append(chosen, g.i), g.shown
  FROM (SELECT query_id, rank, chosen, min_by({{'i': i, 'shown': shown}}, {{'gain': -gain, 'i': i}}) AS g FROM (
    SELECT p.query_id, p.rank, p.chosen, t.i,
      {lam}::DOUBLE * score - {rest}::DOUBLE * list_max(list_transform(p.chosen, lambda j: t.sims[j])) AS shown,
      round({lam}::DOUBLE * score - {rest}::DOUBLE * greatest(0, list_max(list_transform(p.chosen, lambda j: t.sims[j]))), 12) AS gain
    FROM pick p JOIN item t ON t.query_id = p.query_id WHERE NOT list_contains(p.chosen, t.i) AND p.rank + 1 < {k})
    GROUP BY query_id, rank, chosen)),
mmr AS (SELECT p.query_id, memory_id, score, rank, mmr_score FROM pick p JOIN item t ON t.query_id = p.query_id AND t.i = p.i)
"""


@query("mmr_rerank", "cells queries", FUSED + "," + mmr_sql("fused", 0.7, 10) + """
SELECT query_id, memory_id, round(score, 6) AS score, rank, round(mmr_score, 6) AS mmr_score FROM mmr""")
def _(t):
    fused = materialize(ranking.rrf_fuse(channel_hits(t)), "fused")
    out = ranking.mmr_rerank(fused, t["cells"], 10)
    return out.select("query_id", "memory_id", score6(), "rank", F.round("mmr_score", 6).alias("mmr_score"))


@query("cosine", "cells queries", VECTOR + "SELECT query_id, memory_id, round(score, 6) AS cosine FROM vscore")
def _(t):
    pairs = t["queries"].filter("query_vec IS NOT NULL").join(t["cells"].filter("embedding IS NOT NULL"), SCOPE)
    return pairs.select(
        "query_id", F.col("mem_cell_id").alias("memory_id"), F.round(cosine(F.col("query_vec"), F.col("embedding")), 6).alias("cosine")
    )


@query("ip_l2", "", """
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a, CAST(lag(embedding) OVER (ORDER BY vec_id) AS DOUBLE[]) AS b
  FROM embeddings)
SELECT vec_id, round(list_inner_product(a, b), 6) AS ip, round(-list_distance(a, b), 6) AS neg_l2
FROM v WHERE b IS NOT NULL""")
def _(t):
    a = t["embeddings"].select("vec_id", F.col("embedding").alias("a"))
    b = t["embeddings"].select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select(
        "vec_id", F.round(ip(F.col("a"), F.col("b")), 6).alias("ip"), F.round(neg_l2(F.col("a"), F.col("b")), 6).alias("neg_l2")
    )


# --- jobs ---------------------------------------------------------------------------------------------------------

WIDE = hits_sql(80) + """,
fused AS (SELECT query_id, tenant_id, user_id, memory_id,
  sum(CASE channel WHEN 'bm25' THEN 0.4::DOUBLE ELSE 0.6::DOUBLE END / (90 + rank + 1)) AS score FROM hits GROUP BY ALL)
"""


@query("job_retrieve_lite", "cells queries", WIDE + """,
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY SIGNIFICANT(score) DESC, memory_id) - 1 AS rank FROM fused)
SELECT query_id, tenant_id, user_id, memory_id, round(score, 6) AS score, rank FROM r WHERE rank < 5""")
def _(t):
    out = jobs.job_retrieve(t["queries"], t["cells"], 5, lam=None)
    return out.select("query_id", *SCOPE, "memory_id", score6(), "rank")


@query("job_retrieve_boosted", "cells queries", WIDE + "," + SIGNALS + """,
b AS (SELECT query_id, f.tenant_id, f.user_id, f.memory_id, score * decay * (1 + importance) AS score
  FROM fused f JOIN signal USING (memory_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY SIGNIFICANT(score) DESC, memory_id) - 1 AS rank FROM b)
SELECT query_id, tenant_id, user_id, memory_id, round(score, 8) AS score, rank FROM r WHERE rank < 5""")
def _(t):
    out = jobs.job_retrieve(t["queries"], t["cells"], 5, lam=None, signals=jobs.retrieval_signals(t["cells"]))
    return out.select("query_id", *SCOPE, "memory_id", F.round("score", 8).alias("score"), "rank")


@query("job_retrieve", "cells queries", hits_sql(80) + "," + CELL_ENTS + "," + QUERY_ENTS + "," + SIGNALS + """,
n AS (SELECT query_id, count(*) AS n FROM qe GROUP BY 1),
m AS (SELECT query_id, q.tenant_id, q.user_id, mem_cell_id AS memory_id, min(q.pos) AS pos FROM qe q JOIN ce c
  ON q.tenant_id = c.tenant_id AND q.user_id = c.user_id AND q.entity = c.entity GROUP BY ALL),
es AS (SELECT m.query_id, m.memory_id, greatest(1, count(*) FILTER (contains(c.text, q.entity))) / greatest(1, any_value(n)) AS score
  FROM m JOIN cells c ON c.mem_cell_id = m.memory_id JOIN qe q ON q.query_id = m.query_id JOIN n ON n.query_id = m.query_id
  GROUP BY 1, 2),
every AS (SELECT query_id, channel, memory_id, rank FROM hits
  UNION ALL SELECT query_id, 'entity', memory_id, row_number() OVER (PARTITION BY query_id ORDER BY SIGNIFICANT(score) DESC, memory_id) - 1 FROM es
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY SIGNIFICANT(score) DESC, memory_id) <= 20
  UNION ALL SELECT query_id, 'graph', memory_id, row_number() OVER (PARTITION BY query_id ORDER BY pos, memory_id) - 1 FROM m
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos, memory_id) <= 20),
fz AS (SELECT query_id, memory_id, sum(CASE channel WHEN 'bm25' THEN 0.4::DOUBLE WHEN 'vector' THEN 0.6::DOUBLE ELSE 0.15::DOUBLE END
  / (90 + rank + 1)) AS score FROM every GROUP BY 1, 2),
boosted AS (SELECT query_id, f.memory_id, score * decay * (1 + importance) AS score FROM fz f JOIN signal USING (memory_id)),
""" + mmr_sql("boosted", 0.55, 5) + """
SELECT query_id, q.tenant_id, q.user_id, memory_id, round(score, 6) AS score, rank, round(mmr_score, 6) AS mmr_score
FROM mmr JOIN queries q USING (query_id)""")
def _(t):
    cells = t.stored("cells")
    out = jobs.job_retrieve(
        t["queries"], cells, 5, ("bm25", "vector", "entity", "graph"), entities=cell_ents(t),
        signals=jobs.retrieval_signals(cells),
    )
    return out.select("query_id", *SCOPE, "memory_id", score6(), "rank", F.round("mmr_score", 6).alias("mmr_score"))


@query("job_retrieve_options", "stated queries", WIDE + "," + SIGNALS.replace("FROM cells", "FROM stated") + """,
asked_for AS (SELECT concat('i', item_id) AS query_id, 1 + item_id % 5 AS top_k, item_id % 3 AS wants, item_id % 2 AS heavy,
  0.00001::DOUBLE * (item_id % 4) AS least FROM benchmark),
chosen AS (SELECT h.*, a.top_k, CASE WHEN channel = 'bm25' THEN 0.4::DOUBLE WHEN heavy = 1 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS wt
  FROM hits h JOIN asked_for a USING (query_id)
  WHERE h.rank < 16 * a.top_k AND CASE wants WHEN 0 THEN channel = 'bm25' WHEN 1 THEN true ELSE channel = 'vector' END),
fz AS (SELECT query_id, tenant_id, user_id, memory_id, sum(wt / (90 + rank + 1)) AS score, string_agg(channel, ',' ORDER BY channel) AS channels
  FROM chosen GROUP BY ALL),
b AS (SELECT f.query_id, f.tenant_id, f.user_id, f.memory_id, f.channels, f.score * decay * (1 + importance) AS score, length(c.text) AS n_chars
  FROM fz f JOIN signal USING (memory_id) JOIN stated c ON c.mem_cell_id = f.memory_id WHERE state <> 'ARCHIVED'),
r AS (SELECT b.*, top_k, row_number() OVER (PARTITION BY b.query_id ORDER BY SIGNIFICANT(score) DESC, memory_id) - 1 AS rank
  FROM b JOIN asked_for a USING (query_id) WHERE score >= least)
SELECT query_id, tenant_id, user_id, memory_id, channels, n_chars, rank FROM r WHERE rank < top_k""")
def _(t):
    item = F.col("item_id")
    wanted = F.when(item % 3 == 0, F.array(F.lit("bm25"))).when(item % 3 == 2, F.array(F.lit("vector"))).otherwise(
        F.array().cast("array<string>")
    )
    requests = t["queries"].withColumns({
        "top_k": (1 + item % 5).cast("int"), "channels": wanted, "threshold": 0.00001 * (item % 4),
        "weights": F.when(item % 2 == 1, F.create_map(F.lit("vector"), F.lit(0.9))),
    })
    cells = t.stored("stated")
    out, _ = jobs.job_retrieve_requests(requests, cells, jobs.retrieval_signals(cells))
    return out.select(
        "query_id", *SCOPE, "memory_id", F.array_join("channels", ",").alias("channels"), F.length("content").alias("n_chars"), "rank"
    )


@query("job_retrieve_filters", "stated queries", BM25 + "," + VECTOR + """,
want AS (SELECT query_id, CASE i % 5 WHEN 1 THEN 'en' WHEN 3 THEN 'de' END AS lang, CASE i % 5 WHEN 2 THEN 'COLD' WHEN 3 THEN 'WARM' END AS state,
  i % 5 = 4 AS lost FROM (SELECT query_id, CAST(substr(query_id, 2) AS BIGINT) AS i FROM queries)),
fb AS (SELECT b.query_id, b.tenant_id, b.user_id, memory_id, 0.4::DOUBLE AS wt,
  row_number() OVER (PARTITION BY b.query_id ORDER BY SIGNIFICANT(score) DESC, memory_id) - 1 AS rank
  FROM bscore b JOIN want w USING (query_id) JOIN stated c ON c.mem_cell_id = b.memory_id
  WHERE NOT lost AND (w.lang IS NULL OR c.lang = w.lang) AND (w.state IS NULL OR c.state = w.state)),
fv AS (SELECT v.query_id, v.tenant_id, v.user_id, memory_id, 0.6::DOUBLE AS wt,
  row_number() OVER (PARTITION BY v.query_id ORDER BY SIGNIFICANT(score) DESC, memory_id) - 1 AS rank
  FROM vscore v JOIN want w USING (query_id) JOIN stated c ON c.mem_cell_id = v.memory_id WHERE w.state IS NULL OR c.state = w.state),
fz AS (SELECT query_id, tenant_id, user_id, memory_id, sum(wt / (90 + rank + 1)) AS score, count(*) AS n_channels
  FROM (SELECT * FROM fb WHERE rank < 80 UNION ALL SELECT * FROM fv WHERE rank < 80) GROUP BY ALL),
r AS (SELECT f.*, row_number() OVER (PARTITION BY query_id ORDER BY SIGNIFICANT(score) DESC, memory_id) - 1 AS rank
  FROM fz f JOIN stated c ON c.mem_cell_id = f.memory_id WHERE c.state <> 'ARCHIVED')
SELECT query_id, tenant_id, user_id, memory_id, n_channels, round(score, 6) AS score, rank FROM r WHERE rank < 5""")
def _(t):
    # No filter, a language (text channel only), a state, both, and a column that no cell has (text channel finds nothing).
    kind, text = F.col("item_id") % 5, "map<string,string>"
    filters = (
        F.when(kind == 1, F.create_map(F.lit("lang"), F.lit("en"), F.lit("state"), F.lit(None)).cast(text))
        .when(kind == 2, F.create_map(F.lit("state"), F.lit("COLD")))
        .when(kind == 3, F.create_map(F.lit("lang"), F.lit("de"), F.lit("state"), F.lit("WARM")))
        .when(kind == 4, F.create_map(F.lit("colour"), F.lit("red")))
    )
    requests = t["queries"].withColumns(
        {"filters": filters, "top_k": F.lit(5), "channels": F.lit(None).cast("array<string>"), "threshold": F.lit(0.0),
         "weights": F.lit(None).cast("map<string,double>")}
    )
    out, _ = jobs.job_retrieve_requests(requests, t["stated"])
    return out.select("query_id", *SCOPE, "memory_id", F.size("channels").cast("bigint").alias("n_channels"), score6(), "rank")
