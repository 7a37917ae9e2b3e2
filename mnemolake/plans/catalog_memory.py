"""Queries over lifecycle, scenes, facts, model answers, parameters, scalars and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.functions import scoring, text as text_fn
from mnemolake.functions.answers import parse_items, strip_fence
from mnemolake.functions.core import hash_bucket
from mnemolake.functions.vectors import composite_sim, cosine
from mnemolake.operators.graph import entity_source, graph_edges, graph_nodes, cell_entities
from mnemolake.operators import extraction, facts, lifecycle, params, reports, scenes
from mnemolake.operators.ordered import rank_in_key
from mnemolake.plans import jobs
from mnemolake.plans.catalog_retrieval import CELL_ENTS
from mnemolake.plans.registry import query
from mnemolake.schemas import SCOPE
from mnemolake.sources.views import Tables


def r6(column, name: str):
    return F.round(column, 6).alias(name)


# --- scalars ------------------------------------------------------------------------------------------------------


@query("approx_tokens", "cells", "SELECT mem_cell_id, length(text) // 4 AS n FROM cells")
def _(t):
    return t["cells"].select("mem_cell_id", text_fn.approx_tokens(F.col("text")).alias("n"))


@query("needs_refine", "turns", "SELECT conv_id, count(*) > 4 AS refine FROM turns GROUP BY 1")
def _(t):
    return t["turns"].groupBy("conv_id").agg(text_fn.needs_refine(F.count(F.lit(1)), 4).alias("refine"))


@query("strip_fence", "responses", """
SELECT mem_cell_id, CASE WHEN regexp_matches(response, '^```') THEN
  trim(regexp_extract(response, '(?s)^```(?:json|JSON)?\\s*\\n?(.*?)\\n?```$', 1)) ELSE response END AS body
FROM responses""")
def _(t):
    return t["responses"].select("mem_cell_id", strip_fence(F.col("response")).alias("body"))


@query("age_days", "", """
x AS (SELECT max(ts) AS now FROM events)
SELECT event_id, round(greatest(0, (epoch_us(now - INTERVAL 1 DAY) - epoch_us(ts)) / 86400e6), 6) AS age FROM events, x""")
def _(t):
    now = t["events"].agg(F.max("ts") - F.expr("INTERVAL 1 DAY")).scalar()
    return t["events"].select("event_id", r6(scoring.age_days(F.col("ts"), now), "age"))


SCORE = """
sc AS (SELECT mem_cell_id, least(length(text) / 500, 1) AS cqa,
  least(0.2::DOUBLE * access_count + 0.1::DOUBLE * strength, 1) AS bve,
  exp(-ln(2) * age_days / 30) AS trs, least(0.3::DOUBLE * n_raw, 1) AS src FROM cells),
scored AS (SELECT *, 0.25::DOUBLE * cqa + 0.3::DOUBLE * bve + 0.25::DOUBLE * trs + 0.2::DOUBLE * src AS total FROM sc)
"""


def score_columns(with_text: bool = True):
    return scoring.score_parts(
        F.col("age_days"), F.col("access_count"), F.col("strength"), F.col("n_raw"), F.col("text") if with_text else None
    )


@query("fsfm_score", "cells", SCORE + """
SELECT mem_cell_id, round(cqa, 6) AS cqa, round(bve, 6) AS bve, round(trs, 6) AS trs, round(src, 6) AS src,
  round(total, 6) AS composite FROM scored""")
def _(t):
    return t["cells"].select("mem_cell_id", *[r6(c, n) for n, c in score_columns().items()])


@query("fsfm_score_ref", "cells", SCORE + """
SELECT mem_cell_id, round(0.3::DOUBLE * bve + 0.25::DOUBLE * trs, 6) AS composite FROM scored""")
def _(t):
    score = scoring.fsfm_score(F.col("age_days"), F.col("access_count"), F.col("strength"), F.lit(0))
    return t["cells"].select("mem_cell_id", score.alias("composite"))


@query("retention", "cells", """
k AS (SELECT mem_cell_id, exp(-age_days / greatest(0.1, 4 * greatest(0.1, strength)))
  * (0.6::DOUBLE + 0.4::DOUBLE * least(1, access_count / 10)) AS v FROM cells)
SELECT mem_cell_id, round(v, 6) AS retention, v < 0.15 AS forget FROM k""")
def _(t):
    value = scoring.retention(F.col("age_days"), F.col("strength"), F.col("access_count"))
    return t["cells"].select("mem_cell_id", r6(value, "retention"), (value < 0.15).alias("forget"))


@query("compute_state", "stated", "SELECT mem_cell_id, state FROM stated")
def _(t):
    return t["cells"].select("mem_cell_id", scoring.compute_state(F.col("access_count"), F.col("age_days")).alias("state"))


@query("signal_map", "feedback", """
SELECT event_id, CASE WHEN signal_value <> 0 THEN signal_value ELSE CASE feedback_type WHEN 'explicit_confirm' THEN 1
  WHEN 'positive' THEN 0.3 WHEN 'negative' THEN -0.5 WHEN 'correction' THEN -2 ELSE 0 END END AS signal FROM feedback""")
def _(t):
    return t["feedback"].select("event_id", scoring.signal_map(F.col("feedback_type"), F.col("signal_value")).alias("signal"))


@query("hash_bucket", "cells", """
SELECT mem_cell_id, CAST(('0x' || substr(md5(mem_cell_id), 1, 8)) AS BIGINT) % 100 AS b100,
  CAST(('0x' || substr(md5(mem_cell_id), 1, 8)) AS BIGINT) % 10000 AS b10000 FROM cells""")
def _(t):
    key = F.col("mem_cell_id")
    return t["cells"].select("mem_cell_id", hash_bucket(key).alias("b100"), hash_bucket(key, 10000).alias("b10000"))


@query("pick_phase", "", """
x AS (SELECT event_id, ts, CASE event_id % 4 WHEN 0 THEN 'rem' ELSE 'all' END AS scope FROM events)
SELECT event_id, CASE WHEN scope <> 'all' THEN scope WHEN dayofweek(ts) = 0 AND hour(ts) IN (5, 6) THEN 'rem'
  WHEN hour(ts) IN (3, 4) THEN 'deep' ELSE 'light' END AS phase FROM x""")
def _(t):
    scope = F.when(F.col("event_id") % 4 == 0, "rem").otherwise("all")
    return t["events"].select("event_id", scoring.pick_phase(scope, F.col("ts")).alias("phase"))


JACCARD_SQL = """
s AS (SELECT doc_id, list_filter(list_distinct(string_split(text, '')),
  lambda ch: ch NOT IN ('', ' ', chr(10), chr(9), chr(13))) AS a FROM documents),
p AS (SELECT x.doc_id, x.a, y.a AS b FROM s x JOIN s y ON y.doc_id = x.doc_id + 1),
j AS (SELECT doc_id, len(list_intersect(a, b)) AS i, len(a) AS na, len(b) AS nb FROM p),
v AS (SELECT doc_id, CASE WHEN na + nb - i = 0 THEN 0 ELSE i / (na + nb - i) END AS jac FROM j)
"""


def neighbours(t: Tables) -> DataFrame:
    """Each document next to the following one."""
    a = t["documents"].select("doc_id", F.col("text").alias("a"))
    return a.join(t["documents"].select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("b")), "doc_id")


@query("char_jaccard", "", JACCARD_SQL + "SELECT doc_id, round(jac, 6) AS jaccard FROM v")
def _(t):
    return neighbours(t).select("doc_id", r6(text_fn.char_jaccard(F.col("a"), F.col("b")), "jaccard"))


@query("decide", "", JACCARD_SQL + """
SELECT doc_id, CASE WHEN jac >= 0.97 THEN 'NOOP' WHEN jac >= 0.93 THEN 'SUPERSEDE' WHEN jac >= 0.85 THEN 'UPDATE'
  ELSE 'ADD' END AS decision FROM v""")
def _(t):
    sim = text_fn.char_jaccard(F.col("a"), F.col("b"))
    return neighbours(t).select("doc_id", scoring.decide(sim).alias("decision"))


@query("composite_sim", "", JACCARD_SQL + """,
e AS (SELECT v.doc_id, jac, x.embedding AS a, y.embedding AS b FROM v LEFT JOIN embeddings x ON x.vec_id = v.doc_id
  LEFT JOIN embeddings y ON y.vec_id = v.doc_id + 1)
SELECT doc_id, round(CASE WHEN a IS NULL THEN jac ELSE 0.4::DOUBLE * jac + 0.6::DOUBLE * CASE WHEN b IS NULL THEN 0 ELSE
  list_cosine_similarity(CAST(a AS DOUBLE[]), CAST(b AS DOUBLE[])) END END, 6) AS sim FROM e""")
def _(t):
    x = t["embeddings"].select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("x"))
    y = t["embeddings"].select((F.col("vec_id") - 1).alias("doc_id"), F.col("embedding").alias("y"))
    rows = neighbours(t).join(x, "doc_id", "left").join(y, "doc_id", "left")
    jac = text_fn.char_jaccard(F.col("a"), F.col("b"))
    sim = composite_sim(jac, cosine(F.col("x"), F.col("y")), F.col("x").isNotNull())
    return rows.select("doc_id", r6(sim, "sim"))


# --- lifecycle ----------------------------------------------------------------------------------------------------

HIT_SQL = """
n AS (SELECT mem_cell_id, count(DISTINCT batch_day) AS n FROM hits GROUP BY 1),
hit AS (SELECT c.*, coalesce(n, 0) AS n,
  CASE WHEN n IS NULL THEN strength ELSE least(coalesce(strength, 0) + 0.1::DOUBLE * n, 5) END AS s2
  FROM cells c LEFT JOIN n USING (mem_cell_id))
"""


@query("hit_update", "cells hits", HIT_SQL + """
SELECT mem_cell_id, round(s2, 6) AS strength, access_count + n AS access_count FROM hit""")
def _(t):
    return lifecycle.hit_update(t["cells"], t["hits"]).select("mem_cell_id", r6(F.col("strength"), "strength"), "access_count")


FOLD_SQL = """
f AS (SELECT fb.*, c.strength, c.access_count, CASE WHEN signal_value <> 0 THEN signal_value ELSE CASE feedback_type
    WHEN 'explicit_confirm' THEN 1::DOUBLE WHEN 'positive' THEN 0.3::DOUBLE WHEN 'negative' THEN -0.5::DOUBLE
    WHEN 'correction' THEN -2::DOUBLE ELSE 0 END END AS sig,
  coalesce((epoch_us(ts) - epoch_us(coalesce(lag(ts) OVER (PARTITION BY fb.mem_cell_id ORDER BY ts, event_id), c.updated_at))) / 86400e6, 0) AS days
  FROM feedback fb JOIN cells c USING (mem_cell_id, tenant_id, user_id)),
g AS (SELECT mem_cell_id, tenant_id, user_id, any_value(strength) AS old_strength,
  any_value(access_count) + count(*) FILTER (feedback_type IN ('positive', 'explicit_confirm')) AS access_count,
  count(*) AS n_events, list(0.3::DOUBLE * sig - 0.01::DOUBLE * days ORDER BY ts, event_id) AS steps
  FROM f GROUP BY ALL),
fold AS (SELECT *, list_reduce(steps, lambda s, a: least(5, greatest(0, s + a)), old_strength) AS new_strength FROM g)
"""


@query("feedback_fold", "cells feedback", FOLD_SQL + """
SELECT mem_cell_id, tenant_id, user_id, round(old_strength, 6) AS old_strength, round(new_strength, 6) AS new_strength,
  round(new_strength - old_strength, 6) AS delta, access_count, n_events FROM fold""")
def _(t):
    out = lifecycle.feedback_fold(t["cells"], t["feedback"])
    return out.select(
        "mem_cell_id", *SCOPE, *[r6(F.col(c), c) for c in ("old_strength", "new_strength", "delta")], "access_count", "n_events"
    )


@query("passive_decay", "stated", """
SELECT mem_cell_id, state = 'COLD' AND (age_days > 90 OR exp(-ln(2) * age_days / 30) < 0.15) AS archived,
  CASE WHEN state = 'COLD' AND (age_days > 90 OR exp(-ln(2) * age_days / 30) < 0.15) THEN 'ARCHIVED' ELSE state END AS state
FROM stated""")
def _(t):
    return lifecycle.passive_decay(t["stated"], F.col("age_days")).select("mem_cell_id", "archived", "state")


def capacity_sql(table: str, cap: str) -> str:
    return f"""
cap AS (SELECT tenant_id, user_id, count(*) AS total, least(count(*) - {cap}, greatest(1, CAST(floor(count(*) * 0.1) AS BIGINT)))
  AS quota FROM {table} GROUP BY 1, 2 HAVING count(*) > {cap}),
worst AS (SELECT s.tenant_id, s.user_id, s.mem_cell_id, total, quota, round(total_score, 6) AS score,
  row_number() OVER (PARTITION BY s.tenant_id, s.user_id ORDER BY SIGNIFICANT(total_score), s.mem_cell_id) AS position
  FROM {table} s JOIN cap USING (tenant_id, user_id) JOIN (SELECT mem_cell_id, total AS total_score FROM scored) x
  USING (mem_cell_id) WHERE state <> 'ARCHIVED')
"""


@query("enforce_capacity", "cells stated", SCORE + "," + capacity_sql("stated", "10") + """
SELECT tenant_id, user_id, mem_cell_id, score, total, position FROM worst WHERE position <= quota""")
def _(t):
    out = lifecycle.enforce_capacity(t["stated"], score_columns()["composite"], 10)
    return out.select(*SCOPE, "mem_cell_id", "score", "total", "position")


@query("select_to_forget", "stated", """
u AS (SELECT tenant_id, user_id, count(*) AS total, count(*) FILTER (importance_score <= -10) AS d
  FROM stated GROUP BY 1, 2 HAVING count(*) > 10),
q AS (SELECT *, total - 10 AS excess, least(total - 10, greatest(1, CAST(floor(total * 0.1) AS BIGINT))) AS target FROM u),
r AS (SELECT s.*, excess, target, least(d, excess) AS taken, row_number() OVER (PARTITION BY s.tenant_id, s.user_id,
  importance_score <= -10 ORDER BY CASE WHEN importance_score <= -10 THEN 0 ELSE CASE state WHEN 'ARCHIVED' THEN 0
    WHEN 'COLD' THEN 1 WHEN 'WARM' THEN 2 ELSE 3 END END,
  CASE WHEN importance_score <= -10 THEN 0 ELSE round(strength * greatest(1, access_count / 10), 9) END,
  CASE WHEN importance_score <= -10 THEN 0 ELSE importance_score END, mem_cell_id) AS place
  FROM stated s JOIN q USING (tenant_id, user_id))
SELECT tenant_id, user_id, mem_cell_id, CASE WHEN importance_score <= -10 THEN 'danger' ELSE 'greedy' END AS reason
FROM r WHERE place <= CASE WHEN importance_score <= -10 THEN taken ELSE greatest(0, target - taken) END""")
def _(t):
    return lifecycle.select_to_forget(t["stated"], 10)


@query("keep_recent", "cells", """
SELECT tenant_id, user_id, mem_cell_id FROM cells
QUALIFY row_number() OVER (PARTITION BY tenant_id, user_id ORDER BY age_days, mem_cell_id) <= 8""")
def _(t):
    newest = [F.col("age_days"), F.col("mem_cell_id")]
    return lifecycle.keep_recent(t["cells"], SCOPE, newest, 8).select(*SCOPE, "mem_cell_id")


@query("keep_recent_graph", "cells", """
n AS (SELECT tenant_id, user_id, mem_cell_id FROM cells
  QUALIFY row_number() OVER (PARTITION BY tenant_id, user_id ORDER BY age_days, mem_cell_id) <= 6)
SELECT tenant_id, user_id, mem_cell_id, concat('entity:', tenant_id, ':', user_id, ':', session_id) AS target
FROM cells JOIN n USING (tenant_id, user_id, mem_cell_id)
QUALIFY row_number() OVER (PARTITION BY tenant_id, user_id ORDER BY concat(mem_cell_id, '|')) <= 4""")
def _(t):
    """Sessions as the entities of cells; all entity nodes stay, the newest six memories per user too."""
    ents = cell_entities(t["cells"], F.array("session_id"))
    age = t["cells"].select(F.col("mem_cell_id").alias("label"), "age_days")
    nodes = graph_nodes(ents, t["cells"]).join(age, "label", "left").withColumn("seq", F.coalesce("age_days", F.lit(-1.0)))
    memories = nodes.filter("node_type = 'memory'")
    named = F.concat_ws(":", F.lit("memory"), "label")
    kept = lifecycle.keep_recent(memories, SCOPE, [F.col("seq"), F.col("label")], 6)
    every = kept.unionByName(nodes.filter("node_type = 'entity'"))
    _, edges = lifecycle.keep_recent_graph(
        every.withColumn("node_id", F.when(F.col("node_type") == "memory", named).otherwise(F.col("node_id"))),
        graph_edges(ents), F.lit(0), F.lit(0), 100_000, 4,
    )
    return edges.select(*SCOPE, F.array_join("source_memory_ids", "").alias("mem_cell_id"), F.col("target_node_id").alias("target"))


# --- scenes -------------------------------------------------------------------------------------------------------


def scene_sql(key: str, run: str) -> str:
    """Scenes by a recursive walk over the cells of a key and run (sim 0.2, gap 30 days, at most 50 members)."""
    return f"""
b AS (SELECT *, {key} AS k, -age_days AS at_day,
  -age_days - lag(-age_days) OVER (PARTITION BY {key} ORDER BY -age_days, mem_cell_id) > 30 AS far FROM cells),
c AS (SELECT *, CAST(embedding AS DOUBLE[]) AS v, sum(CASE WHEN far THEN 1 ELSE 0 END)
  OVER (PARTITION BY k ORDER BY at_day, mem_cell_id) AS run FROM b),
o AS (SELECT *, concat(k, '#', {run}) AS g, row_number() OVER (PARTITION BY concat(k, '#', {run})
  ORDER BY at_day, mem_cell_id) AS i FROM c),
walk AS (
  SELECT g, i, mem_cell_id, tenant_id, user_id, [{{'c': v, 'n': 1, 't': at_day, 'f': mem_cell_id}}] AS scenes, 0 AS ordinal,
    CAST(0 AS DOUBLE) AS similarity, true AS is_new FROM o WHERE i = 1
  UNION ALL
  SELECT g, i, mem_cell_id, tenant_id, user_id,
    CASE WHEN p IS NULL THEN list_append(scenes, {{'c': v, 'n': 1, 't': at_day, 'f': mem_cell_id}})
      ELSE list_concat(list_concat(scenes[1:p-1], [{{'c': list_transform(range(1, len(v) + 1),
        lambda j: (scenes[p].c[j] * scenes[p].n + v[j]) / (scenes[p].n + 1)), 'n': scenes[p].n + 1, 't': at_day, 'f': scenes[p].f}}]),
        scenes[p+1:]) END,
    CASE WHEN p IS NULL THEN len(scenes) ELSE p - 1 END, CASE WHEN p IS NULL THEN 0 ELSE sims[p] END, p IS NULL
  FROM (SELECT *, CASE WHEN list_max(sims) >= 0.2 THEN list_position(sims, list_max(sims)) END AS p
    FROM (SELECT o.g, o.i, o.mem_cell_id, o.tenant_id, o.user_id, o.v, o.at_day, w.scenes,
      list_transform(w.scenes, lambda s: CASE WHEN o.v IS NULL OR s.c IS NULL OR s.n >= 50 OR abs(o.at_day - s.t) > 30
        THEN -1::DOUBLE ELSE list_cosine_similarity(s.c, o.v) END) AS sims
      FROM walk w JOIN o ON o.g = w.g AND o.i = w.i + 1)))
SELECT tenant_id, user_id, mem_cell_id, concat(split_part(g, '#', 1), '#', scenes[ordinal + 1].f) AS scene_id, round(similarity, 6) AS similarity, is_new FROM walk"""


def timed_cells(t: Tables) -> DataFrame:
    return t["cells"].withColumn("at", -F.col("age_days"))


def assigned(t: Tables) -> DataFrame:
    return scenes.cluster_scenes(timed_cells(t), sim=0.2, gap_days=30)


@query("cluster_scenes", "cells", scene_sql("concat(tenant_id, '|', user_id, '|', session_id)", "run || '.'"))
def _(t):
    return assigned(t).select(*SCOPE, "mem_cell_id", "scene_id", r6(F.col("similarity"), "similarity"), "is_new")


@query("scene_centroid", "cells", """
m AS (SELECT tenant_id, user_id, session_id AS scene_id, embedding, -age_days AS at_day FROM cells WHERE embedding IS NOT NULL),
e AS (SELECT tenant_id, user_id, scene_id, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(0, len(embedding))) AS i FROM m),
c AS (SELECT tenant_id, user_id, scene_id, i, avg(x) AS x FROM e GROUP BY ALL),
l AS (SELECT tenant_id, user_id, scene_id, string_agg(CAST(CAST(round(x * 1000) AS BIGINT) AS STRING), ',' ORDER BY i) AS centroid
  FROM c GROUP BY ALL)
SELECT tenant_id, user_id, scene_id, count(*) AS member_count, max(at_day) AS last_at, any_value(centroid) AS centroid
FROM m JOIN l USING (tenant_id, user_id, scene_id) GROUP BY ALL""")
def _(t):
    members = timed_cells(t).filter("embedding IS NOT NULL").withColumn("scene_id", F.col("session_id"))
    thousandths = F.transform("centroid", lambda x: F.round(x * 1000).cast("bigint").cast("string"))
    return scenes.scene_centroid(members).select(
        *SCOPE, "scene_id", "member_count", "last_at", F.array_join(thousandths, ",").alias("centroid")
    )


SCENE_SIZE = 5


def session_scenes(t: Tables) -> DataFrame:
    """Scenes of bounded size: the cells of a user's session in id order, SCENE_SIZE at a time."""
    placed = rank_in_key(t["cells"], [*SCOPE, "session_id"], [F.col("doc_id")], "place")
    part = F.floor((F.col("place") - 1) / SCENE_SIZE).cast("string")
    members = F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "mem_cell_id"))), lambda m: m["mem_cell_id"])
    return placed.groupBy(*SCOPE, F.concat_ws(".", "session_id", part).alias("scene_id")).agg(
        members.alias("member_episode_ids")
    )


@query("mature_scenes", "cells", """
p AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, user_id, session_id ORDER BY doc_id) - 1 AS place FROM cells)
SELECT tenant_id, user_id, concat(session_id, '.', place // 5) AS scene_id, count(*) AS n_members,
  string_agg(text, chr(10) || '---' || chr(10) ORDER BY doc_id) AS memories
FROM p WHERE text <> '' GROUP BY 1, 2, 3 HAVING count(*) >= 3""")
def _(t):
    return facts.mature_scenes(session_scenes(t), t["cells"])


# --- facts --------------------------------------------------------------------------------------------------------

PAIR_SQL = """
s AS (SELECT *, list_sort(list_filter(list_distinct(string_split(content, '')),
  lambda ch: ch NOT IN ('', ' ', chr(10), chr(9), chr(13)))) AS a FROM facts),
forms AS (SELECT tenant_id, user_id, is_new, a, count(*) AS n, min(semantic_id) AS first_id FROM s GROUP BY ALL),
pairs AS (SELECT x.tenant_id, x.user_id, x.a, x.first_id AS form_id, y.first_id AS target_id, x.n AS n_new, y.n AS n_old,
  len(list_intersect(x.a, y.a)) AS i, len(x.a) + len(y.a) AS total
  FROM forms x JOIN forms y USING (tenant_id, user_id) WHERE x.is_new AND NOT y.is_new),
sims AS (SELECT *, CASE WHEN total - i = 0 THEN 0 ELSE i / (total - i) END AS sim FROM pairs),
best AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY tenant_id, user_id, form_id
  ORDER BY round(sim, 9) DESC, target_id) = 1),
matched AS (SELECT s.tenant_id, s.user_id, s.semantic_id, target_id, sim FROM s LEFT JOIN best b
  ON s.tenant_id = b.tenant_id AND s.user_id = b.user_id AND s.a = b.a WHERE s.is_new),
decided AS (SELECT tenant_id, user_id, semantic_id, coalesce(round(sim, 9), 0) AS sim, CASE WHEN round(sim, 9) >= 0.97 THEN 'NOOP'
  WHEN round(sim, 9) >= 0.93 THEN 'SUPERSEDE' WHEN round(sim, 9) >= 0.85 THEN 'UPDATE' ELSE 'ADD' END AS decision, target_id FROM matched)
"""


def new_facts(t: Tables) -> DataFrame:
    return t["facts"].filter("is_new")


def old_facts(t: Tables) -> DataFrame:
    return t["facts"].filter("NOT is_new")


@query("fact_pairs", "facts", PAIR_SQL + """
SELECT tenant_id, user_id, form_id, target_id, n_new, n_old, round(sim, 6) AS sim FROM sims WHERE round(sim, 9) >= 0.93""")
def _(t):
    return facts.fact_pairs(new_facts(t), old_facts(t), 0.93).select(
        *SCOPE, "form_id", "target_id", "n_new", "n_old", r6(F.col("sim"), "sim")
    )


@query("best_match", "facts", PAIR_SQL + """
SELECT tenant_id, user_id, semantic_id, target_id, round(sim, 6) AS sim FROM matched""")
def _(t):
    return facts.best_match(new_facts(t), old_facts(t)).select(*SCOPE, "semantic_id", "target_id", r6(F.col("sim"), "sim"))


@query("decide_facts", "facts", PAIR_SQL + """
SELECT tenant_id, user_id, semantic_id, decision, CASE WHEN decision <> 'ADD' THEN target_id END AS target_id FROM decided""")
def _(t):
    return facts.decide_facts(new_facts(t), old_facts(t)).select(*SCOPE, "semantic_id", "decision", "target_id")


VECTOR_PAIR_SQL = """
s AS (SELECT *, list_sort(list_filter(list_distinct(string_split(content, '')),
  lambda ch: ch NOT IN ('', ' ', chr(10), chr(9), chr(13)))) AS a, CAST(embedding AS DOUBLE[]) AS v FROM vfacts),
forms AS (SELECT tenant_id, user_id, is_new, a, v, min(semantic_id) AS first_id FROM s GROUP BY ALL),
pairs AS (SELECT x.tenant_id, x.user_id, x.first_id AS form_id, y.first_id AS target_id, x.v AS xv, y.v AS yv,
  len(list_intersect(x.a, y.a)) AS i, len(x.a) + len(y.a) AS total
  FROM forms x JOIN forms y USING (tenant_id, user_id) WHERE x.is_new AND NOT y.is_new),
jac AS (SELECT *, CASE WHEN total - i = 0 THEN 0 ELSE i / (total - i) END AS jac FROM pairs),
sims AS (SELECT *, CASE WHEN xv IS NULL THEN jac ELSE 0.4::DOUBLE * jac
  + 0.6::DOUBLE * CASE WHEN yv IS NULL THEN 0 ELSE list_cosine_similarity(xv, yv) END END AS sim FROM jac),
best AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY tenant_id, user_id, form_id
  ORDER BY round(sim, 9) DESC, target_id) = 1),
matched AS (SELECT s.tenant_id, s.user_id, s.semantic_id, target_id, sim FROM s JOIN forms f ON f.is_new AND s.tenant_id = f.tenant_id
  AND s.user_id = f.user_id AND s.a = f.a AND s.v IS NOT DISTINCT FROM f.v LEFT JOIN best b ON b.form_id = f.first_id WHERE s.is_new)
"""


@query("best_match_vectors", "vfacts", VECTOR_PAIR_SQL + """
SELECT tenant_id, user_id, semantic_id, target_id, round(sim, 6) AS sim FROM matched""")
def _(t):
    rows = t["vfacts"]
    out = facts.best_match(rows.filter("is_new"), rows.filter("NOT is_new"))
    return out.select(*SCOPE, "semantic_id", "target_id", r6(F.col("sim"), "sim"))


@query("decide_facts_vectors", "vfacts", VECTOR_PAIR_SQL + """
SELECT tenant_id, user_id, semantic_id, CASE WHEN round(sim, 9) >= 0.97 THEN 'NOOP' WHEN round(sim, 9) >= 0.93 THEN 'SUPERSEDE'
  WHEN round(sim, 9) >= 0.85 THEN 'UPDATE' ELSE 'ADD' END AS decision, CASE WHEN round(sim, 9) >= 0.85 THEN target_id END AS target_id
FROM matched""")
def _(t):
    rows = t["vfacts"]
    return facts.decide_facts(rows.filter("is_new"), rows.filter("NOT is_new")).select(*SCOPE, "semantic_id", "decision", "target_id")


CONSOLIDATE_SQL = """
s AS (SELECT *, list_sort(list_filter(list_distinct(string_split(content, '')),
  lambda ch: ch NOT IN ('', ' ', chr(10), chr(9), chr(13)))) AS a FROM facts),
n AS (SELECT tenant_id, user_id, a, min_by(semantic_id, seq) AS id, min(seq) AS seq,
  row_number() OVER (PARTITION BY tenant_id, user_id ORDER BY min(seq)) AS i FROM s WHERE is_new GROUP BY 1, 2, 3),
e AS (SELECT tenant_id, user_id, a, min(semantic_id) AS id FROM s WHERE NOT is_new GROUP BY 1, 2, 3),
pool AS (SELECT tenant_id, user_id, a, id, 0 AS i FROM e UNION ALL SELECT tenant_id, user_id, a, id, i FROM n),
pr AS (SELECT x.tenant_id, x.user_id, x.id, x.i, y.id AS other, y.i AS j, len(list_intersect(x.a, y.a)) AS b,
  len(x.a) + len(y.a) AS total FROM n x JOIN pool y USING (tenant_id, user_id) WHERE y.i < x.i),
sm AS (SELECT *, round(CASE WHEN total = b THEN 0 ELSE b / (total - b) END, 9) AS sim FROM pr),
near AS (SELECT n.tenant_id, n.user_id, n.id, n.i, coalesce(bool_or(j = 0 AND sim >= 0.97), false) AS stopped,
  coalesce(list(j) FILTER (j > 0 AND sim >= 0.97), []) AS js
  FROM n LEFT JOIN sm USING (tenant_id, user_id, id) GROUP BY 1, 2, 3, 4),
walk AS (SELECT tenant_id, user_id, id, i, CASE WHEN stopped THEN CAST([] AS BIGINT[]) ELSE [i] END AS kept, NOT stopped AS ok
    FROM near WHERE i = 1
  UNION ALL SELECT x.tenant_id, x.user_id, x.id, x.i, CASE WHEN x.stopped OR list_has_any(x.js, w.kept) THEN w.kept
    ELSE list_append(w.kept, x.i) END, NOT (x.stopped OR list_has_any(x.js, w.kept))
  FROM walk w JOIN near x ON x.tenant_id = w.tenant_id AND x.user_id = w.user_id AND x.i = w.i + 1),
kept AS (SELECT tenant_id, user_id, id, i FROM walk WHERE ok),
best AS (SELECT sm.* FROM sm JOIN kept k USING (tenant_id, user_id, id)
  WHERE j = 0 OR (sm.tenant_id, sm.user_id, sm.other) IN (SELECT (tenant_id, user_id, id) FROM kept)
  QUALIFY row_number() OVER (PARTITION BY sm.tenant_id, sm.user_id, sm.id ORDER BY sim DESC, other) = 1),
final AS (SELECT k.tenant_id, k.user_id, k.id AS semantic_id, coalesce(sim, 0) AS sim, CASE WHEN sim >= 0.93 THEN 'SUPERSEDE'
  WHEN sim >= 0.85 THEN 'UPDATE' ELSE 'ADD' END AS decision, other FROM kept k LEFT JOIN best USING (tenant_id, user_id, id))
"""


@query("consolidate_facts", "facts", CONSOLIDATE_SQL + """
SELECT tenant_id, user_id, semantic_id, decision, CASE WHEN decision <> 'ADD' THEN other END AS target_id,
  round(sim, 6) AS sim FROM final""")
def _(t):
    out = facts.consolidate_facts(new_facts(t), old_facts(t))
    return out.select(*SCOPE, "semantic_id", "decision", "target_id", r6(F.col("sim"), "sim"))


@query("apply_decisions", "facts", PAIR_SQL + """,
h AS (SELECT target_id AS semantic_id, count(*) FILTER (decision = 'UPDATE') AS up, bool_or(decision = 'SUPERSEDE') AS ov
  FROM decided WHERE decision <> 'ADD' GROUP BY 1)
SELECT f.semantic_id, NOT coalesce(ov, false) AS is_valid, 1 + coalesce(up, 0) AS evidence_count
FROM facts f LEFT JOIN h USING (semantic_id) WHERE NOT is_new
UNION ALL SELECT semantic_id, true, 1 FROM decided WHERE decision IN ('ADD', 'SUPERSEDE')""")
def _(t):
    stored = old_facts(t).withColumns({"is_valid": F.lit(True), "evidence_count": F.lit(1)})
    out = facts.apply_decisions(stored, new_facts(t), facts.decide_facts(new_facts(t), old_facts(t)))
    return out.select("semantic_id", "is_valid", "evidence_count")


# --- model answers ------------------------------------------------------------------------------------------------


@query("parse_items", "responses cells", """
SELECT mem_cell_id, CASE doc_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n FROM cells""")
def _(t):
    return t["responses"].select("mem_cell_id", F.size(parse_items(F.col("response"))).alias("n"))


EPISODES_SQL = """
ep AS (
SELECT mem_cell_id, 0 AS pos, CASE WHEN doc_id % 4 >= 2 THEN left(trim(text, ' ' || chr(10) || chr(9) || chr(13)), 50)
    ELSE concat('s', doc_id) END AS summary,
  CASE doc_id % 4 WHEN 0 THEN 'alpha|beta' ELSE '' END AS key_entities, CAST(0 AS DOUBLE) AS emotional_valence,
  CASE doc_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.4 ELSE 0 END AS importance_score, doc_id FROM cells
UNION ALL SELECT mem_cell_id, 1, 'x', 'gamma', -1, 0, doc_id FROM cells WHERE doc_id % 4 = 0)
"""


def cell_answers(t: Tables) -> DataFrame:
    """One answer per cell id: documents that share an id have the same answer, which must not meet each of them twice."""
    return t["responses"].dropDuplicates(["mem_cell_id"])


@query("episodes", "cells", EPISODES_SQL + """
SELECT concat(mem_cell_id, '#', pos) AS episode_id, summary, key_entities, emotional_valence, importance_score FROM ep""")
def _(t):
    return extraction.episodes(t["cells"], cell_answers(t)).select(
        "episode_id", "summary", F.array_join("key_entities", "|").alias("key_entities"), "emotional_valence", "importance_score"
    )


def fact_answers(episodes_: DataFrame) -> DataFrame:
    """An answer per episode: three items, one of them without content, written with the episode's own id."""
    body = F.concat(
        F.lit('[{"content":"about '), F.col("episode_id"), F.lit('","knowledge_type":"Preference","confidence":"1.5"},'),
        F.lit('{"content":"  "},{"content":"also '), F.col("episode_id"),
        F.lit('","knowledge_type":"odd","duration_days":3}]'),
    )
    return episodes_.select("episode_id", body.alias("response"))


@query("semantics", "cells", EPISODES_SQL + """,
e AS (SELECT concat(mem_cell_id, '#', pos) AS episode_id FROM ep)
SELECT concat(episode_id, '#0') AS semantic_id, concat('about ', episode_id) AS content, 'preference' AS knowledge_type,
  CAST(1 AS DOUBLE) AS confidence, NULL AS duration_days FROM e
UNION ALL SELECT concat(episode_id, '#1'), concat('also ', episode_id), 'knowledge', 0.8, 3 FROM e""")
def _(t):
    found = extraction.episodes(t["cells"], cell_answers(t))
    return extraction.semantics(found, fact_answers(found).dropDuplicates(["episode_id"])).select(
        "semantic_id", "content", "knowledge_type", "confidence", "duration_days"
    )


@query("boundary_answers", "turns", """
SELECT request_id, turn, CASE turn % 3 WHEN 0 THEN turn WHEN 1 THEN 2 ELSE -1 END AS boundary_index,
  CASE turn % 3 WHEN 0 THEN 'topic' WHEN 1 THEN '' ELSE 'parse_failed' END AS reasoning,
  CAST(CASE turn % 3 WHEN 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS confidence FROM turns""")
def _(t):
    n = F.col("turn").cast("string")
    answer = F.when(
        F.col("turn") % 3 == 0,
        F.concat(F.lit('```json\n{"boundary_index": '), n, F.lit(', "reasoning": "topic", "confidence": 0.5}\n```')),
    ).when(F.col("turn") % 3 == 1, F.lit('Options [1, 2]: {"boundary_index": 2} fits')).otherwise("cannot say")
    return extraction.boundary_answers(t["turns"].select("request_id", "turn", answer.alias("response")))


@query("render_prompts", "cells", """
SELECT mem_cell_id AS id, CASE doc_id % 3 WHEN 0 THEN concat('Read {literal}: ', text, ' for ', user_id) END AS prompt,
  CASE doc_id % 3 WHEN 1 THEN 'missing: user' WHEN 2 THEN 'undeclared: who' END AS error FROM cells""")
def _(t):
    spark = t.spark
    templates = spark.createDataFrame(
        [("p0", "Read {{literal}}: {text} for {user}", ["text", "user"]), ("p1", "{text} {user}", ["text", "user"]),
         ("p2", "{who}: {text}", ["text"])],
        "prompt_id string, template string, variables array<string>",
    )
    kind = F.col("doc_id") % 3
    full = F.create_map(F.lit("text"), F.col("text"), F.lit("user"), F.col("user_id"))
    given = F.when(kind == 1, F.create_map(F.lit("text"), F.col("text"))).otherwise(full)
    rows = t["cells"].select(
        F.col("mem_cell_id").alias("id"), F.concat(F.lit("p"), kind.cast("string")).alias("prompt_id"), given.alias("vars")
    )
    return extraction.render_prompts(rows, templates).select("id", "prompt", "error")


@query("entity_source", "cells", CELL_ENTS + """,
named AS (SELECT tenant_id, user_id, mem_cell_id, unnest(['alpha', 'beta', 'gamma']) AS entity FROM cells WHERE doc_id % 4 = 0)
SELECT * FROM named
UNION ALL SELECT ce.tenant_id, ce.user_id, mem_cell_id, entity FROM ce JOIN cells USING (mem_cell_id) WHERE doc_id % 4 <> 0""")
def _(t):
    return entity_source(t["cells"], extraction.episodes(t["cells"], t["responses"]))


# --- parameters ---------------------------------------------------------------------------------------------------


def asked_users(t: Tables) -> DataFrame:
    """Every event user asks for a category."""
    u = F.col("user_id").cast("string")
    return t["events"].select("user_id").distinct().select(
        F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"), F.concat(F.lit("u"), u).alias("user_id"),
        F.concat(F.lit("cat"), (F.col("user_id") % 5).cast("string")).alias("category"),
        F.array(F.concat(F.lit("tag"), (F.col("user_id") % 4).cast("string"))).alias("tags"),
    )


USERS_SQL = """
users AS (SELECT DISTINCT concat('t', user_id % 3) AS tenant_id, concat('u', user_id) AS user_id,
  concat('cat', user_id % 5) AS category, concat('tag', user_id % 4) AS tag, user_id AS n FROM events)
"""


@query("variant_assign", "", USERS_SQL + """,
b AS (SELECT *, CAST('0x' || substr(md5(user_id), 1, 8) AS BIGINT) AS h FROM users)
SELECT tenant_id, user_id, category, CASE WHEN category = 'cat1' AND tenant_id IN ('t1', 't2') AND h % 100 < 40 THEN 'early'
  WHEN category = 'cat1' AND h % 10000 < 12.5 * 100 THEN 'share' WHEN category = 'cat2' AND tag IN ('tag1', 'tag2') THEN 'tagged'
  ELSE 'base' END AS variant FROM b""")
def _(t):
    rules = t.spark.createDataFrame(
        [
            ("cat1", 1, "early", ["t1", "t2"], 40, None, None, None, None),
            ("cat1", 2, "share", None, None, 12.5, None, None, None),
            ("cat2", 1, "past", None, None, None, "2020-01-01", "2020-02-01", None),
            ("cat2", 2, "tagged", None, None, None, None, None, ["tag1", "tag2"]),
        ],
        "category string, rule_order int, variant string, tenant_in array<string>, bucket_lt int, traffic_pct double,"
        "starts string, ends string, tag_in array<string>",
    ).withColumns({c: F.col(c).cast("timestamp") for c in ("starts", "ends")})
    return params.variant_assign(asked_users(t), rules, F.lit("2026-01-01").cast("timestamp"))


@query("param_overlay", "", USERS_SQL + """,
k AS (SELECT *, unnest(['p.a', 'p.b', 'p.c']) AS param FROM users),
v AS (SELECT *, CASE WHEN param = 'p.a' AND n % 7 = 0 AND category <> 'cat3' THEN 'user' WHEN param = 'p.b' AND tenant_id = 't1'
    THEN 'tenant' WHEN param IN ('p.b', 'p.c') AND category IN ('cat1', 'cat2') THEN 'global'
    WHEN param IN ('p.a', 'p.b') THEN 'default' END AS source FROM k)
SELECT tenant_id, user_id, category, param, concat(source, '-', param) AS value, source FROM v WHERE source IS NOT NULL""")
def _(t):
    asked = asked_users(t).drop("tags")
    cats = asked.select("category").distinct()
    rows = lambda df, layer, *names: df.withColumn("param", F.explode(F.array(*map(F.lit, names)))).withColumn(
        "value", F.concat(F.lit(f"{layer}-"), F.col("param"))
    )
    defaults = rows(cats, "default", "p.a", "p.b")
    global_ = rows(cats.filter(F.col("category").isin("cat1", "cat2")), "global", "p.b", "p.c")
    tenant = rows(asked.select("tenant_id", "category").distinct().filter("tenant_id = 't1'"), "tenant", "p.b")
    seventh = F.substring("user_id", 2, 20).cast("bigint") % 7 == 0
    user = rows(asked.filter(seventh).select("user_id", "category"), "user", "p.a")
    return params.param_overlay(asked, defaults, global_, tenant, user, barred={"user": ["cat3"]})


@query("param_history", "params", """
SELECT category, scope_id, version, params, actor, lead(updated_at) OVER w AS archived_at,
  lead(version) OVER w IS NULL AS is_current FROM params WINDOW w AS (PARTITION BY category, scope, scope_id, name ORDER BY version)""")
def _(t):
    return params.param_history(t["params"]).select(
        "category", "scope_id", "version", "params", "actor", "archived_at", "is_current"
    )


@query("param_rollback", "params", """
h AS (SELECT category, scope_id, max(version) AS head FROM params GROUP BY 1, 2)
SELECT p.category, p.scope_id, p.params, head + 1 AS version, concat('ops/rollback@v', p.version) AS actor
FROM params p JOIN h USING (category, scope_id) WHERE p.version = 2 AND p.version < head""")
def _(t):
    requests = t["params"].select("category", "scope", "scope_id").distinct().withColumns(
        {"target_version": F.lit(2), "actor": F.lit("ops"), "at": F.lit("2026-01-01").cast("timestamp_ntz")}
    )
    return params.param_rollback(t["params"], requests).select("category", "scope_id", "params", "version", "actor")


@query("param_write", "params", """
w AS (SELECT *, row_number() OVER (PARTITION BY category, scope_id ORDER BY updated_at, version) AS i FROM params),
h AS (SELECT category, scope_id, max(version) AS head FROM params GROUP BY 1, 2)
SELECT category, scope_id, params, head + i AS version FROM w JOIN h USING (category, scope_id)""")
def _(t):
    writes = t["params"].withColumnRenamed("version", "seq")
    return params.param_write(t["params"], writes).select("category", "scope_id", "params", "version")


@query("change_feed", "params", """
a AS (SELECT category, scope_id, name, max(version) AS version FROM params WHERE actor <> 'view' GROUP BY ALL),
b AS (SELECT category, scope_id, name, max(version) AS version, max_by(actor, version) AS actor FROM params GROUP BY ALL)
SELECT b.category, b.scope_id, b.version, b.actor, CASE WHEN a.version IS NULL THEN 'insert' ELSE 'update' END AS operation
FROM b LEFT JOIN a USING (category, scope_id, name) WHERE a.version IS NULL OR a.version <> b.version""")
def _(t):
    key = ["category", "scope", "scope_id", "name"]
    heads = lambda df: df.groupBy(*key).agg(F.max_by("actor", "version").alias("actor"), F.max("version").alias("version"))
    return params.change_feed(heads(t["params"].filter("actor <> 'view'")), heads(t["params"])).select(
        "category", "scope_id", "version", "actor", "operation"
    )


# --- reports ------------------------------------------------------------------------------------------------------


def rollup_sql() -> str:
    b = reports.LATENCY_BUCKETS
    counts = ", ".join(f"count(*) FILTER (seconds <= {x}) AS le_{i}" for i, x in enumerate(b))

    def quantile(q: float) -> str:
        arms = []
        for i, x in enumerate(b):
            low, below = (b[i - 1], f"le_{i - 1}") if i else (0, "0")
            arms.append(f"WHEN le_{i} >= {q} * n THEN {low} + ({x} - {low}) * ({q} * n - {below}) / (le_{i} - {below})")
        return "CAST(CASE " + " ".join(arms) + f" ELSE {b[-1]} END AS DOUBLE)"

    return f"""
g AS (SELECT time_bucket(INTERVAL '5 minutes', ts) AS bucket, path, count(*) AS n, {counts},
  count(*) FILTER (status = '500') AS e, count(*) FILTER (status = '429') AS throttled FROM serving_log GROUP BY 1, 2)
SELECT bucket, path, n AS requests, round({quantile(0.5)}, 6) AS p50, round({quantile(0.95)}, 6) AS p95,
  round(e / n, 6) AS share_5xx, throttled FROM g"""


@query("serving_rollups", "serving_log", rollup_sql())
def _(t):
    out = reports.serving_rollups(t["serving_log"])
    return out.select(
        F.col("bucket").cast("timestamp_ntz").alias("bucket"), "path", "requests",
        *[r6(F.col(c), c) for c in ("p50", "p95", "share_5xx")], "throttled",
    )


@query("consolidation_report", "facts stated", PAIR_SQL + """,
a AS (SELECT tenant_id, user_id, count(*) AS archived FROM stated WHERE state = 'COLD' AND exp(-ln(2) * age_days / 30) < 0.15
  GROUP BY 1, 2),
d AS (SELECT tenant_id, user_id, count(*) AS scanned, count(*) FILTER (decision <> 'NOOP') AS consolidated FROM decided GROUP BY 1, 2)
SELECT coalesce(d.tenant_id, a.tenant_id) AS tenant_id, coalesce(d.user_id, a.user_id) AS user_id, coalesce(scanned, 0) AS scanned,
  coalesce(consolidated, 0) AS consolidated, coalesce(archived, 0) AS archived, 0 AS errors, 'deep' AS phase
FROM d FULL JOIN a ON d.tenant_id = a.tenant_id AND d.user_id = a.user_id""")
def _(t):
    gone = lifecycle.passive_decay(t["stated"], F.col("age_days")).filter("archived")
    return reports.consolidation_report(facts.decide_facts(new_facts(t), old_facts(t)), gone, "deep")


# --- jobs ---------------------------------------------------------------------------------------------------------


@query("job_feedback", "cells feedback hits", FOLD_SQL + """,
n AS (SELECT mem_cell_id, count(DISTINCT batch_day) AS n FROM hits GROUP BY 1),
m AS (SELECT c.tenant_id, c.user_id, c.mem_cell_id, coalesce(new_strength, c.strength) AS s, coalesce(fold.access_count, c.access_count)
  + coalesce(n, 0) AS access_count, n, fold.mem_cell_id IS NOT NULL AS fed, age_days
  FROM cells c LEFT JOIN fold USING (mem_cell_id) LEFT JOIN n USING (mem_cell_id))
SELECT tenant_id, user_id, mem_cell_id, round(CASE WHEN n IS NULL THEN s ELSE least(s + 0.1::DOUBLE * n, 5) END, 6) AS strength,
  access_count, CASE WHEN access_count >= 5 OR age_days < 1 THEN 'ACTIVE' WHEN access_count >= 2 OR age_days < 7 THEN 'WARM'
  WHEN age_days < 90 THEN 'COLD' ELSE 'ARCHIVED' END AS state, fed OR n IS NOT NULL AS changed FROM m""")
def _(t):
    out = jobs.job_feedback(t["cells"], t["feedback"], t["hits"])
    return out.select(*SCOPE, "mem_cell_id", r6(F.col("strength"), "strength"), "access_count", "state", "changed")


@query("job_cold_path", "cells", CELL_ENTS + "," + EPISODES_SQL + """,
named AS (SELECT tenant_id, user_id, mem_cell_id, unnest(['alpha', 'beta', 'gamma']) AS entity FROM cells WHERE doc_id % 4 = 0
  UNION ALL SELECT tenant_id, user_id, mem_cell_id, entity FROM ce WHERE mem_cell_id IN
  (SELECT mem_cell_id FROM cells WHERE doc_id % 4 <> 0)),
epi AS (SELECT tenant_id, user_id FROM ep JOIN cells USING (mem_cell_id))
SELECT 'episodes' AS "table", tenant_id, user_id, count(*) AS n FROM epi GROUP BY ALL
UNION ALL SELECT 'facts', tenant_id, user_id, 2 * count(*) FROM epi GROUP BY ALL
UNION ALL SELECT 'scenes', tenant_id, user_id, count(*) FROM cells GROUP BY ALL
UNION ALL SELECT 'postings', tenant_id, user_id, count(*) FROM named GROUP BY ALL
UNION ALL SELECT 'edges', tenant_id, user_id, count(*) FROM named GROUP BY ALL
UNION ALL SELECT 'index', tenant_id, user_id, count(DISTINCT entity) FROM named GROUP BY ALL
UNION ALL SELECT 'nodes', tenant_id, user_id, count(DISTINCT entity) + count(DISTINCT mem_cell_id) FROM
  (SELECT tenant_id, user_id, mem_cell_id, entity FROM named UNION ALL SELECT tenant_id, user_id, mem_cell_id, NULL FROM cells)
  GROUP BY ALL""")
def _(t):
    """Row counts of every table the cold path writes, per user."""
    t.stored("cells")
    cells = timed_cells(t)
    found = extraction.episodes(cells, t["responses"])
    done = jobs.job_cold_path(cells, t["responses"], fact_answers(found), sim=0.2, gap_days=30)
    out = None
    for name in ("episodes", "facts", "scenes", "postings", "index", "nodes", "edges"):
        counted = getattr(done, name).groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n")).withColumn("table", F.lit(name))
        out = counted if out is None else out.unionByName(counted)
    return out.select("table", *SCOPE, "n")


@query("job_consolidate", "facts cells stated", CONSOLIDATE_SQL + "," + SCORE + """,
decayed AS (SELECT * REPLACE (CASE WHEN state = 'COLD' AND exp(-ln(2) * age_days / 30) < 0.15 THEN 'ARCHIVED' ELSE state END
  AS state), state = 'COLD' AND exp(-ln(2) * age_days / 30) < 0.15 AS gone FROM stated),
""" + capacity_sql("decayed", "10") + """,
a AS (SELECT tenant_id, user_id, count(*) AS archived FROM (SELECT tenant_id, user_id FROM decayed WHERE gone
  UNION ALL SELECT tenant_id, user_id FROM worst WHERE position <= quota) GROUP BY 1, 2),
d AS (SELECT tenant_id, user_id, count(*) AS scanned FROM final GROUP BY 1, 2)
SELECT coalesce(d.tenant_id, a.tenant_id) AS tenant_id, coalesce(d.user_id, a.user_id) AS user_id, coalesce(scanned, 0) AS scanned,
  coalesce(scanned, 0) AS consolidated, coalesce(archived, 0) AS archived, 0 AS errors, 'deep' AS phase
FROM d FULL JOIN a ON d.tenant_id = a.tenant_id AND d.user_id = a.user_id""")
def _(t):
    stored = old_facts(t).withColumns({"is_valid": F.lit(True), "evidence_count": F.lit(1)})
    return jobs.job_consolidate("deep", new_facts(t), stored, t["stated"], max_per_user=10).report


