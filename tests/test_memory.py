"""Recall, ranking, lifecycle, scenes, facts, parameters, limits: fixed values and brute force."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from mnemolake.operators import facts, graph, lifecycle, limits, params, ranking, recall, scenes, store
from mnemolake.plans import jobs

CELLS = "tenant_id string, user_id string, mem_cell_id string, text string, embedding array<float>"


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(5)
    words = "alpha beta gamma delta tea coffee plan Paris 北京 note".split()
    data = []
    for i in range(60):
        text = " ".join(r.choice(words) for _ in range(r.randint(0, 12)))
        vec = [r.gauss(0, 1) for _ in range(4)] if i % 5 else None
        data.append((f"t{i % 2}", f"u{i % 3}", f"m{i:02d}", text, vec))
    queries = [(f"q{i}", f"t{i % 2}", f"u{i % 3}", " ".join(r.choice(words) for _ in range(4)),
                [r.gauss(0, 1) for _ in range(4)]) for i in range(8)]
    return data, queries, spark.createDataFrame(data, CELLS), spark.createDataFrame(
        queries, "query_id string, tenant_id string, user_id string, query string, query_vec array<float>"
    )


def words_of(text):
    out = []
    for token in text.lower().split():
        out += list(token) if token == "北京" else [token]
    return out


def test_bm25_by_hand(corpus):
    data, queries, cells, asked = corpus
    docs = [words_of(d[3]) for d in data]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    got = {}
    hits = recall.bm25_topk(asked, recall.bm25_postings(cells), recall.corpus_stats(cells), 5)
    for h in hits.collect():
        got.setdefault(h["query_id"], []).append((h["rank"], h["memory_id"], round(h["score"], 6)))
    for q, tenant, user, text, _ in queries:
        scored = []
        for d, doc in zip(data, docs):
            if (d[0], d[1]) != (tenant, user):
                continue
            s = 0.0
            for w in words_of(text):
                df, tf = sum(w in x for x in docs), doc.count(w)
                s += math.log(1 + (n - df + .5) / (df + .5)) * tf / (tf + 1.2 * (.25 + .75 * len(doc) / avg))
            if s:
                scored.append((-round(s, 9), d[2], round(s, 6)))
        want = [(i, m, s) for i, (_, m, s) in enumerate(sorted(scored)[:5])]
        assert sorted(got.get(q, [])) == want


@pytest.mark.parametrize("metric", ["COSINE", "IP", "L2"])
@pytest.mark.parametrize("block", [3, 4096])
def test_vector_topk(corpus, metric, block):
    data, queries, cells, asked = corpus
    got = rows(recall.vector_topk(asked, cells, 4, metric, block).withColumn("score", F.round("score", 5)),
               "query_id", "memory_id", "rank", "score")
    want = []
    for q, tenant, user, _, v in queries:
        v = np.float32(v).astype(float)
        scored = []
        for d in data:
            if (d[0], d[1]) == (tenant, user) and d[4]:
                x = np.float32(d[4]).astype(float)
                s = {"IP": v @ x, "L2": -np.linalg.norm(v - x), "COSINE": v @ x / np.linalg.norm(v) / np.linalg.norm(x)}
                scored.append((-s[metric], d[2]))
        want += [(q, m, i, round(-s, 5)) for i, (s, m) in enumerate(sorted(scored)[:4])]
    assert [w[:3] for w in got] == [w[:3] for w in sorted(want, key=str)]
    assert all(abs(a[3] - b[3]) < 2e-5 for a, b in zip(got, sorted(want, key=str)))


def test_ann_with_all_lists_is_exact(corpus):
    _, _, cells, asked = corpus
    exact = rows(recall.vector_topk(asked, cells, 4), "query_id", "memory_id")
    assert rows(recall.vector_ann(asked, cells, 4, n_cells=5, nprobe=5), "query_id", "memory_id") == exact
    some = recall.vector_ann(asked, cells, 4, n_cells=5, nprobe=2)
    assert some.count() > 0


def test_vector_items(spark):
    cells = spark.createDataFrame(
        [("t", "u", k, "", [float(x) for x in v]) for k, v in (("a", (1, 0, 0)), ("b", (.9, .1, 0)), ("c", (0, 0, 1)))],
        CELLS,
    )
    q = spark.createDataFrame([("q", "t", "u", [1., 0., 0.]), ("x", "other", "u", [1., 0., 0.]), ("s", "t", "u", [1.])],
                              "query_id string, tenant_id string, user_id string, query_vec array<float>")
    hits = recall.vector_topk(q, cells, 2)
    assert rows(hits.filter("query_id = 'q'"), "memory_id") == [("a",), ("b",)]
    assert hits.filter("query_id = 'x'").count() == 0
    assert {r["score"] for r in hits.filter("query_id = 's'").collect()} == {0.0}


def test_upsert_rejects_mixed_sizes(spark):
    base = spark.createDataFrame([("a", [1., 0.], 0)], "id string, embedding array<float>, seq int")
    more = spark.createDataFrame([("a", [0., 1.], 1), ("b", [], 1)], base.schema)
    assert rows(store.vector_upsert(base, more, "id", "seq"), "id", "seq") == [("a", 1)]
    mixed = spark.createDataFrame([("a", [0., 1.], 1), ("b", [1.], 1)], base.schema)
    with pytest.raises(Exception, match="mixed vector dimensions"):
        store.vector_upsert(base, mixed, "id", "seq").collect()


def test_no_row_leaves_its_scope(corpus):
    _, _, cells, asked = corpus
    ents = graph.cell_entities(cells, F.split("text", " "))
    out = jobs.job_retrieve(asked, cells, 5, ("bm25", "vector", "entity", "graph"), entities=ents)
    home = cells.select(F.col("mem_cell_id").alias("memory_id"), F.col("tenant_id").alias("t"), F.col("user_id").alias("u"))
    joined = out.join(home, "memory_id")
    assert joined.count() == out.count() > 0
    assert joined.filter("t <> tenant_id OR u <> user_id").count() == 0


def test_result_does_not_depend_on_partitions(corpus):
    _, _, cells, asked = corpus
    a = jobs.job_retrieve(asked, cells, 5)
    b = jobs.job_retrieve(asked.repartition(3), cells.repartition(7), 5)
    pick = ["query_id", "memory_id", "rank"]
    assert rows(a, *pick) == rows(b, *pick)


def test_no_channel_is_an_error(corpus):
    _, _, cells, asked = corpus
    with pytest.raises(ValueError):
        jobs.job_retrieve(asked, cells, 5, ())
    assert jobs.job_retrieve(asked.drop("query_vec"), cells, 5).count() > 0


HIT = "query_id string, tenant_id string, user_id string, channel string, memory_id string, score double, rank int"


def hits_of(spark, *items):
    return spark.createDataFrame([("q", "t", "u", *i) for i in items], HIT)


def test_rrf(spark):
    hits = hits_of(spark, ("bm25", "mc1", 5., 0), ("bm25", "mc2", 3., 1), ("vector", "mc2", .9, 0), ("vector", "mc3", .8, 1))
    fused = ranking.rerank(ranking.rrf_fuse(hits)).orderBy("rank").collect()
    assert fused[0]["memory_id"] == "mc2" and {r["memory_id"] for r in fused} == {"mc1", "mc2", "mc3"}
    assert fused[0]["channels"] == ["bm25", "vector"] and fused[0]["source_channel"] == "bm25"
    alone = {r["memory_id"]: r["score"] for r in ranking.rrf_fuse(hits.filter("channel = 'bm25'")).collect()}
    assert alone == {"mc1": pytest.approx(.3 / 61), "mc2": pytest.approx(.3 / 62)}
    odd = hits_of(spark, ("odd", "a", 1., 0), ("bm25", "", 1., 0))
    assert ranking.rrf_fuse(odd).count() == 0


def mmr(spark, items, k=None, lam=0.7):
    hits = hits_of(spark, *[("bm25", m, s, 0) for m, s, _ in items])
    vecs = spark.createDataFrame([("t", "u", m, v) for m, _, v in items],
                                 "tenant_id string, user_id string, mem_cell_id string, embedding array<double>")
    return [tuple(r) for r in ranking.mmr_rerank(hits, vecs, k, lam).orderBy("rank").select("memory_id", "mmr_score").collect()]


def test_mmr(spark):
    vectors = [("a", .9, [1., 0.]), ("b", .85, [.99, .01]), ("c", .5, [0., 1.])]
    assert [m for m, _ in mmr(spark, vectors, lam=.5)] == ["a", "c", "b"]
    plain = [("a", .5, None), ("b", .9, None), ("c", .7, None)]
    assert [m for m, _ in mmr(spark, plain)] == ["b", "c", "a"]
    opposite = mmr(spark, [("a", 1., [1., 0.]), ("b", .5, [-1., 0.])], lam=.5)
    assert opposite[1] == ("b", pytest.approx(.25 + .5))  # shown with the sign, not chosen by it
    assert len(mmr(spark, vectors, k=2)) == 2


FEEDBACK = "event_id bigint, tenant_id string, user_id string, mem_cell_id string, feedback_type string, signal_value double, ts timestamp"


@pytest.mark.parametrize("limit", [20_000, 40])
def test_feedback_fold(spark, limit):
    r = random.Random(1)
    start = dt.datetime(2026, 1, 1)
    kinds = ["positive", "negative", "explicit_confirm", "correction"]
    events = [(i, "t", "u", f"m{0 if i % 3 else i % 7}", r.choice(kinds), r.choice([0., 0., .8]),
               start + dt.timedelta(hours=r.randint(0, 4000), seconds=i)) for i in range(400)]
    events.append((999, "t2", "u", "m0", "positive", 0., start))
    cells = spark.createDataFrame([("t", "u", f"m{i}", float(i), 0) for i in range(7)],
                                  "tenant_id string, user_id string, mem_cell_id string, strength double, access_count int")
    got = {x["mem_cell_id"]: x for x in lifecycle.feedback_fold(
        cells, spark.createDataFrame(events, FEEDBACK), rows_per_chunk=limit).collect()}
    signal = {"positive": .3, "negative": -.5, "explicit_confirm": 1., "correction": -2.}
    for cell in {e[3] for e in events}:
        s, last, used = float(cell[1:]), None, 0
        for e in sorted((e for e in events if e[3] == cell and e[1] == "t"), key=lambda e: (e[6], e[0])):
            days = 0 if last is None else (e[6] - last).total_seconds() / 86400
            s = max(0., min(5., s + .3 * (e[5] or signal[e[4]]) - .01 * days))
            last, used = e[6], used + (e[4] in ("positive", "explicit_confirm"))
        assert got[cell]["new_strength"] == pytest.approx(s) and got[cell]["access_count"] == used


@pytest.mark.parametrize("old, signal, want", [(1., .3, 1.09), (1., -.5, .85), (.5, -10., 0.), (4.9, 10., 5.)])
def test_one_feedback(spark, old, signal, want):
    cells = spark.createDataFrame([("t", "u", "m", old, 0)], "tenant_id string, user_id string, mem_cell_id string, strength double, access_count int")
    event = spark.createDataFrame([(1, "t", "u", "m", "positive", signal, dt.datetime(2026, 1, 1))], FEEDBACK)
    assert lifecycle.feedback_fold(cells, event).first()["new_strength"] == pytest.approx(want)


def scored(spark, items):
    return spark.createDataFrame([("t", "u", f"m{i:02d}", s, v) for i, (s, v) in enumerate(items)],
                                 "tenant_id string, user_id string, mem_cell_id string, state string, v double")


@pytest.mark.parametrize("limit", [1_000_000, 6])
def test_capacity(spark, limit):
    twenty = scored(spark, [("COLD", float(i % 4)) for i in range(20)])
    got = lifecycle.enforce_capacity(twenty, F.col("v"), 10, .1, rows_per_chunk=limit)
    assert rows(got, "mem_cell_id") == [("m00",), ("m04",)]
    eight = scored(spark, [("COLD", 1.)] * 5 + [("ARCHIVED", 0.)] * 3)
    assert lifecycle.enforce_capacity(eight, F.col("v"), 4, 1.).count() == 4
    assert lifecycle.enforce_capacity(eight, F.col("v"), 8).count() == 0


def test_forget_and_decay(spark):
    data = [("ACTIVE", 1.), ("WARM", 1.), ("COLD", 1.), ("ARCHIVED", 1.)]
    refs = scored(spark, data).withColumns({"strength": F.lit(1.), "access_count": F.lit(0), "importance_score": F.lit(0.)})
    assert rows(lifecycle.select_to_forget(refs, 2, 1.), "mem_cell_id") == [("m02",), ("m03",)]
    bad = refs.withColumn("importance_score", F.when(F.col("state") == "ACTIVE", -10.).otherwise(0.))
    assert rows(lifecycle.select_to_forget(bad, 3, 1.), "mem_cell_id", "reason") == [("m00", "danger")]
    aged = scored(spark, [("COLD", 100.), ("COLD", 5.), ("ACTIVE", 200.)])
    done = lifecycle.passive_decay(aged, F.col("v"))
    assert rows(done, "mem_cell_id", "archived", "state") == [("m00", True, "ARCHIVED"), ("m01", False, "COLD"), ("m02", False, "ACTIVE")]
    assert lifecycle.passive_decay(aged, F.col("v"), dry_run=True).filter("state = 'ARCHIVED'").count() == 0


def test_keep_recent_graph(spark):
    ents = spark.createDataFrame([("t", "u", "m1", "a"), ("t", "u", "m2", "b")], "tenant_id string, user_id string, mem_cell_id string, entity string")
    nodes, edges = graph.graph_nodes(ents), graph.graph_edges(ents)
    seq = F.when(F.col("node_id").contains("m2") | F.col("node_id").endswith(":b"), 0).otherwise(1)
    kept, ends = lifecycle.keep_recent_graph(nodes, edges, seq, F.lit(0), 2, 5)
    assert rows(kept, "label") == [("b",), ("m2",)] and rows(ends, "source_node_id") == [("memory:m2",)]


def scene_rows(spark, items):
    return spark.createDataFrame([("t", "u", "s", f"c{i:03d}", float(at), v) for i, (at, v) in enumerate(items)],
                                 "tenant_id string, user_id string, session_id string, mem_cell_id string, at double, embedding array<double>")


def test_scene_rules(spark):
    items = [(0, [1., 0., 0.]), (1, [.99, .1, 0.]), (2, [0., 1., 0.]), (3, None), (40, [1., 0., 0.])]
    got = {r["mem_cell_id"]: r["scene_id"] for r in scenes.cluster_scenes(scene_rows(spark, items)).collect()}
    assert got["c000"] == got["c001"] and len(set(got.values())) == 4
    full = scenes.cluster_scenes(scene_rows(spark, [(0, [1., 0.])] * 5), max_size=2)
    assert sorted(r["count"] for r in full.groupBy("scene_id").count().collect()) == [1, 2, 2]


@pytest.mark.parametrize("limit", [50_000, 25])
def test_scenes_in_chunks(spark, limit):
    r = random.Random(2)
    items, at = [], 0.0
    for _ in range(150):
        at += r.choice([.1, .5, 1., 9.])
        items.append((at, None if r.random() < .1 else [r.gauss(0, 1), r.gauss(0, 1)]))
    got = rows(scenes.cluster_scenes(scene_rows(spark, items), .8, 7, 6, 256, rows_per_chunk=limit), "mem_cell_id", "is_new")
    groups, want = [], []
    for i, (at, v) in enumerate(items):
        best, top = None, 0.0
        for g in groups:
            if v and g["c"] is not None and g["n"] < 6 and at - g["last"] <= 7:
                s = float(np.dot(v, g["c"]) / np.linalg.norm(v) / np.linalg.norm(g["c"]))
                if s >= .8 and s > top:
                    best, top = g, s
        if best:
            best["n"] += 1
            best["c"] = (best["c"] * (best["n"] - 1) + np.array(v)) / best["n"]
            best["last"] = at
        else:
            groups.append({"c": np.array(v) if v else None, "n": 1, "last": at})
        want.append((f"c{i:03d}", best is None))
    assert got == want


FACT = "semantic_id string, tenant_id string, user_id string, content string, seq int"


def jac(a, b):
    a, b = set(a) - set(" \n"), set(b) - set(" \n")
    return len(a & b) / len(a | b) if a | b else 0.0


def test_consolidation_against_brute_force(spark):
    r = random.Random(4)
    base = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    def text():
        out = set(base) - set(r.sample(base, r.choice([0, 1, 1, 2, 4, 9])))
        return "".join(sorted(out))
    old = [(f"e{i:02d}", "t", "u", text(), -1) for i in range(6)]
    new = [(f"n{i:02d}", "t", "u" if i % 4 else "v", text(), i) for i in range(60)]
    new += [(f"n{60 + i}", "t", "u", new[1][3], 60 + i) for i in range(20)]  # copies
    th = facts.FactThresholds()
    known, want = {"u": [(i, c) for i, _, _, c, _ in old], "v": []}, []
    for i, _, u, c, _ in new:
        best = max(((round(jac(c, k), 9), ), [-ord(x) for x in j], j) for j, k in known[u]) if known[u] else None
        sim, target = (best[0][0], best[2]) if best else (0.0, None)
        d = "NOOP" if sim >= th.noop else "SUPERSEDE" if sim >= th.supersede else "UPDATE" if sim >= th.update else "ADD"
        if d != "NOOP":
            want.append((i, d, None if d == "ADD" else target))
            known[u].append((i, c))
    got = facts.consolidate_facts(spark.createDataFrame(new, FACT), spark.createDataFrame(old, FACT), block=16)
    assert rows(got, "semantic_id", "decision", "target_id") == sorted(want, key=str)


def test_decisions_and_copies(spark):
    new = spark.createDataFrame([(f"n{i}", "t", "u", "same text", i) for i in range(50)], FACT)
    old = spark.createDataFrame([("e1", "t", "u", "same text", 0), ("e2", "t2", "u", "same text", 0)], FACT)
    pairs = facts.fact_pairs(new, old)
    assert rows(pairs, "target_id", "n_new", "n_old") == [("e1", 50, 1)]  # copies are one row
    assert rows(facts.decide_facts(new, old).groupBy("decision", "target_id").count()) == [("NOOP", "e1", 50)]
    assert facts.consolidate_facts(new, old).count() == 0
    assert rows(facts.consolidate_facts(new, old.filter("tenant_id = 'zz'")), "semantic_id", "decision") == [("n0", "ADD")]


def test_vectors_in_similarity():
    new = pd.DataFrame({"chars": ["abc", "abc"], "vec": [[1., 0.], None]})
    old = pd.DataFrame({"chars": ["abc", "abd"], "vec": [[.917, math.sqrt(1 - .917 ** 2)], None]})
    got = facts.similarities(new, old)
    assert got[0] == pytest.approx([.4 + .6 * .917, .4 * .5]) and got[1] == pytest.approx([1.0, .5])


@pytest.mark.parametrize("chunk", [500_000, 60])
def test_moving_window(spark, chunk):
    r = random.Random(6)
    at, events = 0.0, []
    for i in range(400):
        at += r.choice([0, .2, 1, 3]) if i % 90 else 100
        events.append((i, "k1" if i % 5 else "k2", dt.datetime(2026, 1, 1) + dt.timedelta(seconds=at)))
    table = spark.createDataFrame(events, "event_id bigint, key string, ts timestamp").repartition(5)
    got = {x["event_id"]: x["accepted"] for x in limits.moving_window_limit(table, "key", "ts", 5, 20, chunk).collect()}
    taken = {"k1": [], "k2": []}
    for i, k, ts in events:
        taken[k] = [t for t in taken[k] if (ts - t).total_seconds() < 20]
        assert got[i] == (len(taken[k]) < 5)
        if got[i]:
            taken[k].append(ts)


def test_graph(spark):
    ents = spark.createDataFrame([("t", "u", "m1", "e1"), ("t", "u", "m2", "e1"), ("t", "u", "m2", "e2"), ("t", "u", "m3", "e2")],
                                 "tenant_id string, user_id string, mem_cell_id string, entity string")
    nodes, edges = graph.graph_nodes(ents), graph.graph_edges(ents)
    want = spark.createDataFrame([("q", "t", "u", "e1")], "query_id string, tenant_id string, user_id string, entity string")
    found = lambda d: rows(graph.related_memories(want, nodes, edges, d), "memory_id")
    assert found(1) == found(2) == [("m1",), ("m2",)] and found(3) == [("m1",), ("m2",), ("m3",)]
    seeds = want.select("query_id", "tenant_id", "user_id", graph.entity_node_id("entity").alias("node_id"))
    _, crossed = graph.graph_traverse(seeds, nodes, edges, 1)
    assert crossed.count() == 2
    cut_edges = edges.withColumn("is_valid", F.col("source_node_id") != "memory:m1")
    hidden = nodes.withColumn("is_valid", F.col("label") != "m2")
    assert rows(graph.related_memories(want, hidden, cut_edges, 3), "memory_id") == [("m3",)]
    assert graph.graph_traverse(seeds, nodes, edges, 2, ["related_to"])[1].count() == 0


def test_variants(spark):
    users = spark.createDataFrame([("acme", "u1", ["x"], "fuser"), ("other", "u1", ["x"], "fuser")],
                                  "tenant_id string, user_id string, tags array<string>, category string")
    rules = spark.createDataFrame([("fuser", 1, "k200", ["acme"], None, None, None, None, None)],
        "category string, rule_order int, variant string, tenant_in array<string>, bucket_lt int, traffic_pct double,"
        "starts timestamp, ends timestamp, tag_in array<string>")
    got = params.variant_assign(users, rules, F.lit(dt.datetime(2026, 1, 1)))
    assert rows(got, "tenant_id", "variant") == [("acme", "k200"), ("other", "base")]


def test_dead_letters(spark):
    cells = spark.createDataFrame([("a", [1.]), ("b", None)], "mem_cell_id string, embedding array<float>")
    dlq = spark.createDataFrame([(1, "es", "a", 5), (2, "cold", "a", 0), (3, "es", "zz", 0), (4, "milvus", "b", 0), (5, "es", "b", 1)],
                                "event_id bigint, target string, mem_cell_id string, retry_count int")
    got = store.reconcile(dlq, cells)
    assert [s for _, s in rows(got, "event_id", "status")] == ["exhausted", "skipped", "skipped", "skipped", "ok"]
    dry = store.reconcile(dlq, cells, dry_run=True)
    assert [s for _, s in rows(dry, "event_id", "status")] == ["exhausted", "skipped", "skipped", "dry_run", "dry_run"]
    failed = store.reconcile(dlq, cells, retry_ok=F.lit(False))
    assert rows(store.reconcile_remaining(failed).filter("event_id = 5"), "retry_count") == [(2,)]


def test_no_scene_in_reach_is_forgotten():
    """Scenes leave the state when they are full or, only if asked for, when there are too many."""
    state, capped = (scenes.SceneState(.9, 7, 3, most) for most in (None, 256))
    unit = np.eye(400)
    for s in (state, capped):
        assert all(s.place(f"c{i:03d}", unit[i], 0.0)[2] for i in range(400))
    assert state.place("x", unit[0], 1.0) == ("c000", 1.0, False) and capped.place("x", unit[0], 1.0)[2]
    assert state.place("y", unit[0], 8.0)[0] == "c000"  # within the gap of the last member; full then
    assert state.place("z", unit[0], 8.0)[2] and state.place("x", None, 8.0) == ("c000", 1.0, False)
    assert state.place("v", unit[1] + unit[2], 1.0)[2]
    assert state.place("w", unit[399], 7.5)[2] and state.place("u", unit[399], math.inf)[0] == "c399"


def test_trailing_counts_of_dense_events(spark):
    """A moving frame is counted anew for each row, so its work grew with the square of the events of an hour."""
    r = random.Random(9)
    start = dt.datetime(2026, 1, 1)
    data = [("ab"[i % 2], i, start + dt.timedelta(microseconds=r.choice([0, 1, 499_999, 500_000]) + 500_000 * r.randint(0, 40))) for i in range(900)]
    out = limits.trailing_counts(spark.createDataFrame(data, "key string, event_id bigint, ts timestamp"), "key", "ts", 3)
    width = dt.timedelta(seconds=3)
    assert rows(out) == sorted(((k, i, sum(k == q and t - width < u <= t for q, _, u in data)) for k, i, t in data), key=str)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame, unboundedpreceding$()" in plan


def test_state_leaves_columns_their_types():
    from mnemolake.operators.ordered import _with_state

    done = pd.DataFrame({"key": ["a", "a"], "event_id": [1, 2], "accepted": [True, False]})
    out = _with_state(done, {"key": "a"}, b"s", [*done.columns, "_state"])
    assert out.dtypes["event_id"] == "int64" and out.dtypes["accepted"] == bool
    assert out["_state"].tolist() == [None, None, b"s"] and out["event_id"].tolist() == [1, 2, 2]
    assert _with_state(done[:0], {"key": "a"}, b"s", [*done.columns, "_state"]).values.tolist() == [["a", None, None, b"s"]]


def test_limit_of_a_large_key_is_answered_in_slices():
    from mnemolake.streaming.operators import _Limit

    class Values(dict):
        exists = lambda self: bool(self)
        get = lambda self: self["v"]
        update = lambda self, v: self.__setitem__("v", v)
        getValue = lambda self, k: self[k]  # noqa: E731, N815
        updateValue = lambda self, k, v: self.__setitem__(k, v)  # noqa: E731, N815

    r = random.Random(11)
    limiter, batch = _Limit(7, 0.001), limits.Limiter(7, 0.001)
    limiter._taken, limiter._count = Values(), Values()
    at = 0
    for _ in range(2):  # two micro-batches
        times = [at := at + r.choice([0, 1, 90, 400]) for _ in range(130_000)]
        ids = list(range(130_000))
        order = r.sample(ids, len(ids))
        frames = [pd.DataFrame({"key": "k", "at": [times[i] for i in part], "event_id": part}) for part in (order[:70_000], order[70_000:])]
        out = list(limiter.handleInputRows(("k",), iter(frames), None))
        assert len(out) > 1 and max(map(len, out)) <= 100_000
        got = pd.concat(out).sort_values("event_id")["accepted"].tolist()
        assert got == [batch.hit(t) for t in times]
