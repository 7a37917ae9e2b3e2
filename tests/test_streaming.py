"""Streams over several files and batches must equal the batch operators on the same ordered input."""

import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from mnemolake.operators import ingest, lifecycle, limits, scenes, store
from mnemolake.streaming import operators as streams
from mnemolake.streaming.runs import to_table


def stream_of(spark, parts, schema, folder):
    """Write each part as one file, in order, and read them one file per micro-batch."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")
    table = spark.read.schema(schema).parquet(*[f"{folder}/{i:03d}" for i in range(len(parts))])
    stream = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    )
    return table, stream


def parts_of(data, n=3):
    size = -(-len(data) // n)
    return [data[i:i + size] for i in range(0, len(data), size)]


def test_segment(spark, tmp_path):
    r, data = random.Random(1), []
    for q in range(4):
        at = 0
        for pos in range(30):
            at += r.choice([1, 5, 40])
            data.append((pos, "t", "u", f"q{q}", f"q{q}:{pos:02d}", "x" * r.randint(1, 80), float(at)))
    data.sort()
    table, stream = stream_of(spark, parts_of(data), "pos bigint, tenant_id string, user_id string, request_id string, raw_id string, content string, event_min double", tmp_path / "in")
    got = to_table(streams.stream_segment(stream, 30, 4, 30))
    assert rows(got, "raw_id", "segment") == rows(ingest.segment(table, 30, 4, 30), "raw_id", "segment")


def test_cluster(spark, tmp_path):
    r = random.Random(2)
    data = [("t", "u", f"s{i % 2}", f"c{i:02d}", i * .5, [r.gauss(0, 1), r.gauss(0, 1)]) for i in range(60)]
    schema = "tenant_id string, user_id string, session_id string, mem_cell_id string, at double, embedding array<double>"
    table, stream = stream_of(spark, parts_of(data), schema, tmp_path / "in")
    got = to_table(streams.stream_cluster(stream, .8, 7, 5))
    same = scenes.cluster_scenes(table, .8, 7, 5)
    assert rows(got, "mem_cell_id", "is_new") == rows(same, "mem_cell_id", "is_new")


def test_feedback_and_hits(spark, tmp_path):
    start = dt.datetime(2026, 1, 1)
    r = random.Random(3)
    data = [(i, "t", "u", f"m{i % 4}", r.choice(["positive", "negative"]), 0., start + dt.timedelta(hours=i)) for i in range(60)]
    schema = "event_id bigint, tenant_id string, user_id string, mem_cell_id string, feedback_type string, signal_value double, ts timestamp"
    table, stream = stream_of(spark, parts_of(data), schema, tmp_path / "in")
    cells = spark.createDataFrame([("t", "u", f"m{i}", 1.0, 0) for i in range(4)],
                                  "tenant_id string, user_id string, mem_cell_id string, strength double, access_count int")
    out = to_table(streams.stream_feedback(streams.feedback_events(stream, cells)), "update")
    last = out.groupBy("mem_cell_id").agg(F.max_by(F.round("strength", 9), "n_events").alias("s"))
    want = lifecycle.feedback_fold(cells, table)
    assert rows(last) == rows(want.select("mem_cell_id", F.round("new_strength", 9)))
    hits = spark.createDataFrame([(1, "m0", dt.date(2026, 1, 1)), (2, "m0", dt.date(2026, 1, 1)), (3, "m0", dt.date(2026, 1, 2))],
                                 "event_id bigint, mem_cell_id string, batch_day date")
    hits.coalesce(1).write.parquet(str(tmp_path / "hits"))
    live = spark.readStream.schema(hits.schema).parquet(str(tmp_path / "hits"))
    counted = to_table(streams.stream_feedback(streams.hit_events(live, cells)), "update")
    assert rows(counted.select("mem_cell_id", F.round("strength", 9), "access_count")) == [("m0", 1.2, 2)]


def test_limit(spark, tmp_path):
    start = dt.datetime(2026, 1, 1)
    data = [(i, f"k{i % 2}", start + dt.timedelta(seconds=i * i % 7 + i)) for i in range(120)]
    data.sort(key=lambda x: (x[2], x[0]))
    table, stream = stream_of(spark, parts_of(data), "event_id bigint, key string, ts timestamp", tmp_path / "in")
    got = to_table(streams.stream_limit(stream, "key", "ts", 5, 20))
    pick = ["key", "event_id", "accepted"]
    assert rows(got, *pick) == rows(limits.moving_window_limit(table, "key", "ts", 5, 20), *pick)


def test_dedupe_and_fanout(spark, tmp_path):
    start = dt.datetime(2026, 1, 1)
    data = [(f"k{i % 5}", i, start + dt.timedelta(minutes=i)) for i in range(30)]
    _, stream = stream_of(spark, parts_of(data), "key string, n int, ts timestamp", tmp_path / "in")
    first = to_table(streams.stream_dedupe(stream, ["key"], "ts"))
    assert rows(first, "key", "n") == [(f"k{i}", i) for i in range(5)]
    cells = [("a", "t", "u", "text", [1.0]), ("b", "t", "u", " ", [float("nan")]), ("c", "t", "u", "text", None)]
    schema = "mem_cell_id string, tenant_id string, user_id string, text string, embedding array<float>"
    table, live = stream_of(spark, [cells[:1], cells[1:]], schema, tmp_path / "cells")
    paths = {n: str(tmp_path / n) for n in ("text", "vector", "dlq")}
    streams.stream_fanout(live, paths, F.lit(0))
    docs, vectors, dead = store.index_fanout(table, F.lit(0))
    for name, want in (("text", docs), ("vector", vectors), ("dlq", dead)):
        assert rows(spark.read.parquet(paths[name]), "mem_cell_id") == rows(want, "mem_cell_id")
    assert rows(dead, "target", "mem_cell_id") == [("es", "b"), ("milvus", "b")]


def test_replayed_batch_overwrites(spark, tmp_path):
    from mnemolake.streaming import runs

    root = str(tmp_path / "sink")
    seen = []

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")
        seen.append(number)
        if len(seen) == 1:
            raise RuntimeError("lost")

    _, stream = stream_of(spark, [[("a",)]], "id string", tmp_path / "in")
    check = str(tmp_path / "check")
    with pytest.raises(Exception, match="lost"):
        runs.run_available(stream, write, checkpoint=check)
    runs.run_available(stream, write, checkpoint=check)
    assert seen == [0, 0] and rows(spark.read.parquet(root), "id") == [("a",)]


def test_limit_state_goes_when_nothing_can_reach_it(spark, tmp_path):
    """Keys whose window is past the watermark leave no state; a key that comes back starts with an empty limiter."""
    from mnemolake.streaming import runs

    start = dt.datetime(2026, 1, 1)
    parts = [[(i, f"k{i}", start) for i in range(40)], [(100, "late", start + dt.timedelta(days=1))], [(101, "late", start + dt.timedelta(days=1, seconds=1))],
             [(102, "k1", start + dt.timedelta(days=1, seconds=2)), (103, "k1", start + dt.timedelta(days=1, seconds=3))]]
    table, stream = stream_of(spark, parts, "event_id bigint, key string, ts timestamp", tmp_path / "in")
    limited = streams.stream_limit(stream, "key", "ts", 1, 20, delay="10 minutes")
    root = str(tmp_path / "out")
    done = runs.run_available(limited, lambda b, n: b.write.mode("overwrite").parquet(f"{root}/batch={n}"))
    held = [p["stateOperators"][0]["numRowsTotal"] for p in done.recentProgress if p["stateOperators"]]
    assert max(held) >= 40 and held[-1] <= 8
    pick = ["key", "event_id", "accepted"]
    assert rows(spark.read.parquet(root), *pick) == rows(limits.moving_window_limit(table, "key", "ts", 1, 20), *pick)


def test_limit_of_many_rows_of_one_key_in_a_batch(spark, tmp_path):
    start = dt.datetime(2026, 1, 1)
    table = spark.range(100_000).select(F.col("id").alias("event_id"), F.lit("k").alias("key"), (F.lit(start) + F.make_dt_interval(secs=F.col("id") / 10)).alias("ts"))
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    got = to_table(streams.stream_limit(live, "key", "ts", 7, 3))
    want = limits.moving_window_limit(table, "key", "ts", 7, 3)
    assert got.filter("accepted").select("event_id").exceptAll(want.filter("accepted").select("event_id")).isEmpty()
    assert got.filter("accepted").count() == want.filter("accepted").count() and got.count() == 100_000


def test_segment_state_goes_after_a_day(spark, tmp_path):
    from mnemolake.streaming import runs

    parts = [[(0, "t", "u", f"q{i}", f"r{i}", "hello", 100.0) for i in range(30)], [(0, "t", "u", "z", "z0", "later", 9000.0)], [(1, "t", "u", "z", "z1", "later", 9001.0)],
             [(2, "t", "u", "z", "z2", "later", 9002.0)]]
    schema = "pos bigint, tenant_id string, user_id string, request_id string, raw_id string, content string, event_min double"
    table, stream = stream_of(spark, parts, schema, tmp_path / "in")
    root = str(tmp_path / "out")
    done = runs.run_available(streams.stream_segment(stream, delay="1 hour"), lambda b, n: b.write.mode("overwrite").parquet(f"{root}/batch={n}"))
    held = [p["stateOperators"][0]["numRowsTotal"] for p in done.recentProgress if p["stateOperators"]]
    assert max(held) >= 30 and held[-1] <= 4
    assert rows(spark.read.parquet(root), "raw_id", "segment") == rows(ingest.segment(table), "raw_id", "segment")


def test_rows_without_a_key_claim_nothing(spark, tmp_path):
    start = dt.datetime(2026, 1, 1)
    data = [("a", 1, start), (None, 2, start), (None, 3, start), ("a", 4, start + dt.timedelta(hours=1)), ("b", 5, start + dt.timedelta(hours=2)),
            ("c", 6, start + dt.timedelta(hours=60)), ("d", 7, start + dt.timedelta(hours=61)), ("a", 8, start + dt.timedelta(hours=62))]
    _, stream = stream_of(spark, [[r] for r in data], "key string, n int, ts timestamp", tmp_path / "in")
    assert rows(to_table(streams.stream_dedupe(stream, ["key"], "ts")), "n") == [(1,), (2,), (3,), (5,), (6,), (7,), (8,)]


def fan_out(spark, tmp_path, name, fails, check=None, attempts=3):
    """Run the fan-out over two batches with a text sink that fails `fails` times; what was written, tried and waited."""
    from mnemolake.streaming.sinks import Retry, to_folder

    cells = [("a", "t", "u", "text", [1.0]), ("b", "t", "u", " ", [2.0]), ("c", "t", "u", "text", None)]
    schema = "mem_cell_id string, tenant_id string, user_id string, text string, embedding array<float>"
    folder = tmp_path / f"{name}-in"
    _, live = stream_of(spark, [cells[:2], cells[2:]], schema, folder)
    paths = {n: str(tmp_path / f"{name}-{n}") for n in ("text", "vector", "dlq")}
    tried = []

    def text(rows_, number):
        tried.append(number)
        if len(tried) <= fails:
            raise OSError("sink is away")
        to_folder(paths["text"])(rows_, number)

    streams.stream_fanout(live, paths, F.lit(0), retry=Retry(attempts, 0.01), writers={"text": text}, ledger=str(tmp_path / f"{name}-ledger"))
    return paths, tried


def test_a_sink_that_recovers_gives_no_dead_letter(spark, tmp_path):
    paths, tried = fan_out(spark, tmp_path, "some", 2)
    assert tried == [0, 0, 0, 1]
    assert rows(spark.read.parquet(paths["text"]), "mem_cell_id") == [("a",), ("c",)]
    assert rows(spark.read.parquet(paths["dlq"]), "target", "mem_cell_id") == [("es", "b")]


def test_a_sink_that_stays_away_gives_a_dead_letter_a_row(spark, tmp_path):
    paths, tried = fan_out(spark, tmp_path, "all", 99)
    assert tried == [0, 0, 0, 1, 1, 1]
    assert rows(spark.read.parquet(paths["vector"]), "mem_cell_id") == [("a",), ("b",)]
    dead = spark.read.parquet(paths["dlq"])
    assert rows(dead.filter("error = 'sink is away'"), "target", "mem_cell_id", "retry_count") == [("es", "a", 3), ("es", "c", 3)]
    assert rows(dead, "mem_cell_id") == [("a",), ("b",), ("c",)]


def test_a_replayed_batch_does_not_write_a_sink_again(spark, tmp_path):
    from mnemolake.streaming.sinks import Ledger, Retry, deliver

    frame = spark.createDataFrame([(1,)], "x int")
    ledger, seen, waits = Ledger(spark, str(tmp_path / "ledger")), [], []

    def flaky(rows_, number):
        seen.append(number)
        if len(seen) < 3:
            raise OSError("not yet")

    def broken(rows_, number):
        seen.append(-1)
        raise OSError("never")

    policy = Retry(4, 1.0, 2.0, 3.0)
    assert deliver(frame, 7, "good", flaky, ledger, policy, waits.append) == (3, None) and waits == [1.0, 2.0]
    assert deliver(frame, 7, "bad", broken, ledger, policy, waits.append) == (4, "never") and waits[2:] == [1.0, 2.0, 3.0]
    before = len(seen)
    assert deliver(frame, 7, "good", flaky, ledger, policy) == (3, None)
    assert deliver(frame, 7, "bad", broken, ledger, policy) == (4, "never")
    assert len(seen) == before
    assert rows(ledger.rows(), "batch", "sink", "attempts", "state") == [(7, "bad", 4, "dead"), (7, "good", 3, "done")]


@pytest.mark.parametrize("name", ["stream_segment", "stream_cluster", "stream_fanout"])
def test_stream_queries_read_tables_of_several_files(spark, tmp_path, name):
    from mnemolake.plans.catalog import QUERIES

    folder = "/root/testdata/sf0.001"
    for table in ("conversations", "documents", "embeddings"):
        spark.read.parquet(f"{folder}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    got = rows(QUERIES[name](spark, str(tmp_path)))
    assert got and got == rows(QUERIES[name](spark, folder))
