import datetime as dt
import json
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from mnemolake.operators import ingest
from mnemolake.plans import jobs
from mnemolake.sources.tables import latest_snapshot, read_requests, write_snapshot

RAW = "tenant_id string, user_id string, request_id string, pos bigint, raw_id string, content string, event_min double"


def raws(spark, per_request):
    data = []
    for request, items in per_request.items():
        data += [("t", "u", request, i, f"{request}:{i}", "x" * chars, float(at)) for i, (at, chars) in enumerate(items)]
    return spark.createDataFrame(data, RAW)


def fold(items, gap, turns, tokens):
    out, number, n, held, last = [], -1, 0, 0, None
    for at, chars in items:
        if number < 0 or at - last > gap or n >= turns or held // 4 >= tokens:
            number, n, held = number + 1, 0, 0
        n, held, last = n + 1, held + chars, at
        out.append(number)
    return out


def check(spark, data, gap=30, turns=20, tokens=512, **limits):
    got = {(r["request_id"], r["pos"]): r["segment"] for r in
           ingest.segment(raws(spark, data), gap, turns, tokens, **limits).collect()}
    want = {(q, i): s for q, items in data.items() for i, s in enumerate(fold(items, gap, turns, tokens))}
    assert got == want


def test_rules(spark):
    check(spark, {
        "gap": [(0, 5), (30, 5), (61, 5)], "back": [(100, 5), (0, 5)], "turns": [(i, 1) for i in range(45)],
        "size": [(0, 2047), (1, 1), (2, 1)], "one": [(0, 1)],
    })


@pytest.mark.parametrize("seed", [1, 2])
def test_long_requests_in_chunks(spark, seed):
    r = random.Random(seed)
    data = {}
    for q, n in (("long", 700), ("short", 12), ("mid", 130)):
        at, items = 0, []
        for _ in range(n):
            at += r.choice([1, 2, 5, 31 if q == "long" else 3])
            items.append((at, r.randint(1, 60)))
        data[q] = items
    check(spark, data, 30, 7, 40, fold_rows=50, rows_per_chunk=100)


def test_hot_request_without_gaps(spark):
    check(spark, {"hot": [(i, 10 + i % 3) for i in range(600)]}, 30, 6, 30, fold_rows=50, rows_per_chunk=90)


def test_gap_segments_and_cells(spark):
    table = raws(spark, {"q": [(0, 3), (45, 3)]}).withColumn("session_id", F.lit("s"))
    assert rows(ingest.gap_segments(table), "pos", "segment") == [(0, 0), (1, 1)]
    cells = ingest.build_cells(ingest.segment(table.withColumn("event_min", F.lit(1.0))))
    assert rows(cells, "mem_cell_id", "raw_data_ids", "text") == [("t/u/q#0", ["q:0", "q:1"], "xxx\nxxx")]


def test_request_ids_repeat_across_tenants(spark):
    one = raws(spark, {"q": [(0, 3), (1, 4)]}).withColumn("session_id", F.lit("s"))
    both = one.unionByName(one.withColumn("tenant_id", F.lit("t2")).withColumn("content", F.lit("other")))
    cells = ingest.build_cells(ingest.segment(both))
    assert rows(cells, "mem_cell_id", "text") == [("t/u/q#0", "xxx\nxxxx"), ("t2/u/q#0", "other\nother")]
    assert ingest.gap_segments(both).count() == 4
    answers = ingest.segment(both).select("tenant_id", "user_id", "request_id", "segment").distinct().withColumn(
        "boundary_index", F.when(F.col("tenant_id") == "t", 1)
    )
    split = ingest.split_at(ingest.segment(both), answers)
    assert rows(split, "tenant_id", "pos", "segment") == [("t", 0, 0), ("t", 1, 1), ("t2", 0, 0), ("t2", 1, 0)]


def test_large_and_small_requests_follow_one_rule(spark):
    r = random.Random(5)
    table = raws(spark, {"q": [(i * 3, r.randint(1, 60)) for i in range(120)]})
    odd = table.withColumn("pos", F.floor(F.col("pos") / 5)).withColumn("content", F.when(F.length("content") > 9, F.col("content")))
    small = rows(ingest.segment(odd, 30, 7, 40), "raw_id", "segment")
    assert len(small) == 120 and small == rows(ingest.segment(odd, 30, 7, 40, fold_rows=50, rows_per_chunk=40), "raw_id", "segment")


CLAIMED = "request_id string, tenant_id string, user_id string, idempotency_key string, event_time timestamp"


def test_claims_live_a_day_and_across_runs(spark):
    at = lambda hour: dt.datetime(2026, 1, 1) + dt.timedelta(hours=hour)
    data = [("a", "t", "u", "k", at(0)), ("b", "t", "u", "k", at(23)), ("c", "t", "u", "k", at(24)), ("d", "t", "u", "k", at(47)),
            ("a", "t2", "u", "k", at(1)), ("e", "t", "u", None, at(0)), ("f", "t", "u", None, at(0))]
    table = spark.createDataFrame(data, CLAIMED)
    first = jobs.claims(table)
    assert rows(first, "tenant_id", "request_id", "holder") == [("t", "a", "a"), ("t", "b", "a"), ("t", "c", "c"), ("t", "d", "c"), ("t2", "a", "a")]
    later = jobs.claims(spark.createDataFrame([("g", "t", "u", "k", at(40)), ("h", "t", "u", "k", at(60))], CLAIMED), first)
    assert rows(later, "request_id", "holder") == [("g", "c"), ("h", "h")]
    kept = jobs.first_claim(table, ["tenant_id", "user_id", "idempotency_key"], F.col("request_id"))
    assert rows(kept, "tenant_id", "request_id") == [("t", "a"), ("t", "e"), ("t", "f"), ("t2", "a")]


def test_split_at(spark):
    table = ingest.segment(raws(spark, {"q": [(0, 1), (1, 1), (2, 1), (90, 1)]}))
    answers = spark.createDataFrame([("t", "u", "q", 0, 2), ("t", "u", "q", 1, 1)], "tenant_id string, user_id string, request_id string, segment bigint, boundary_index int")
    assert rows(ingest.split_at(table, answers), "pos", "segment") == [(0, 0), (1, 0), (2, 1), (3, 2)]


REQUEST = {
    "request_id": "q1", "tenant_id": "t1", "user_id": "u1", "raw_data_type": "CONVERSATION",
    "event_time": "2026-01-01T00:00:00Z", "agent_id": "a1", "adiu": "", "idempotency_key": "k1",
    "min_read_consistency": 0, "metadata": {"agent_id": "low", "src": "x"},
    "history_sessions": [
        {"session_id": "s1", "speaker_a": "Ann", "session_summary": "sum", "turns": [
            {"role": "user", "content": "hi", "speaker_name": "Ann", "dia_id": "D1", "turn_index": 0},
            {"role": "assistant", "content": "yo", "has_answer": True, "timestamp": "2026-01-01T00:45:00Z"}]},
        {"session_id": "s2", "session_start": "2026-01-02T00:00:00Z", "turns": [{"role": "user", "content": "bye"}]},
    ],
}


@pytest.fixture(scope="module")
def requests(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("requests") / "a.json"
    twin = {**REQUEST, "request_id": "q2"}
    path.write_text(json.dumps(REQUEST) + "\n" + json.dumps(twin) + "\n")
    return read_requests(spark, str(path))


def test_raw_records(requests):
    first = requests.filter("request_id = 'q1'")
    turns = ingest.raw_per_turn(first).orderBy("pos").collect()
    assert [r["content"] for r in turns] == ["user: hi", "assistant: yo", "user: bye"]
    assert [r["event_time"] for r in turns] == [
        dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 1, 0, 45), dt.datetime(2026, 1, 2)
    ]
    sessions = ingest.raw_per_session(first).orderBy("pos").collect()
    assert [r["content"] for r in sessions] == ["Ann: hi\nassistant: yo", "user: bye"]


def test_metadata_layers(requests):
    turns = ingest.raw_per_turn(requests.filter("request_id = 'q1'")).orderBy("pos").collect()
    assert turns[0]["metadata"] == {
        "agent_id": "a1", "src": "x", "idempotency_key": "k1", "min_read_consistency": "0", "speaker_a": "Ann",
        "session_summary": "sum", "dia_id": "D1", "turn_index": "0",
    }
    assert turns[1]["metadata"]["has_answer"] == "true" and "dia_id" not in turns[1]["metadata"]


def test_job_claims_once(spark, requests):
    none = requests.select(F.lit("").alias("mem_cell_id")).filter(F.lit(False))
    done = jobs.job_ingest(requests, none, F.lit(0))
    assert rows(done.cells, "mem_cell_id") == [("t1/u1/q1#0",), ("t1/u1/q1#1",)]
    assert rows(done.claims, "request_id", "holder") == [("q1", "q1"), ("q2", "q1")]
    again = jobs.job_ingest(requests, done.cells.select("mem_cell_id"), F.lit(0))
    assert again.cells.count() == 0
    later = requests.filter("request_id = 'q2'").withColumn("request_id", F.lit("q3"))
    assert jobs.job_ingest(later, none, F.lit(0), held=done.claims).cells.count() == 0  # held by an earlier run
    unkeyed = requests.withColumn("idempotency_key", F.lit(None).cast("string"))
    assert jobs.job_ingest(unkeyed, none, F.lit(0)).cells.count() == 4  # no key, no claim, nothing lost


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "cells")
    table = spark.createDataFrame([("t1", "a", 1)], "tenant_id string, id string, n int")
    write_snapshot(table, root, 1)
    write_snapshot(table.withColumn("n", F.col("n") + 1), root, 2)
    assert rows(latest_snapshot(spark, root), "id", "n") == [("a", 2)]
