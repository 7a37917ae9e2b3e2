import random

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from mnemolake.operators import ordered

DATA = [("hot", i, (i * 7919) % 1009, f"r{i:04d}") for i in range(900)] + [("cold", i, i, f"c{i}") for i in range(5)]


@pytest.fixture(scope="module", autouse=True)
def small_chunks():
    """Few cuts per level, so that chunks are cut more than once."""
    old = ordered.MAX_CHUNKS, ordered.SAMPLES_PER_CHUNK
    ordered.MAX_CHUNKS, ordered.SAMPLES_PER_CHUNK = 4, 8
    yield
    ordered.MAX_CHUNKS, ordered.SAMPLES_PER_CHUNK = old


@pytest.fixture(scope="module")
def table(spark):
    data = DATA[:]
    random.Random(3).shuffle(data)
    return spark.createDataFrame(data, "k string, n int, v int, id string").repartition(6)


ORDER = None


@pytest.fixture(autouse=True)
def order_columns(spark):
    """Columns need a session; rebuild them per test."""
    global ORDER
    ORDER = [F.col("v"), F.col("id")]


def expected():
    out = {}
    for k in ("hot", "cold"):
        out[k] = sorted((v, i) for key, _, v, i in DATA if key == k)
    return out


def test_chunks_are_small_and_ordered(table):
    chunks, hot = ordered.split_hot_keys(table, ["k"], ORDER, 50)
    assert hot
    per = chunks.groupBy("k", "_chunk").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    got = sorted(per.filter("k = 'hot'").collect(), key=lambda r: r["_chunk"])
    assert [r["_chunk"] for r in got] == list(range(len(got)))
    assert max(r["n"] for r in got) <= 50 and sum(r["n"] for r in got) == 900
    assert all(a["hi"] <= b["lo"] for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("limit", [50, 10_000])
def test_rank(table, limit):
    got = rows(ordered.rank_in_key(table, ["k"], ORDER, "r", limit), "k", "id", "r")
    want = sorted(((k, i, n + 1) for k, part in expected().items() for n, (_, i) in enumerate(part)), key=str)
    assert got == want


@pytest.mark.parametrize("limit", [50, 10_000])
def test_previous(table, limit):
    got = rows(ordered.previous_in_key(table, ["k"], ORDER, F.col("v"), "p", limit), "k", "id", "p")
    want = []
    for k, part in expected().items():
        want += [(k, i, part[n - 1][0] if n else None) for n, (_, i) in enumerate(part)]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("limit", [50, 10_000])
def test_runs(table, limit):
    got = rows(
        ordered.runs_in_key(table, ["k"], ORDER, F.col("v"), lambda a, b: (b - a) > 1, "run", limit), "k", "id", "run"
    )
    want = []
    for k, part in expected().items():
        run = 0
        for n, (v, i) in enumerate(part):
            run += bool(n and v - part[n - 1][0] > 1)
            want.append((k, i, run))
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("limit", [100, 10_000])
def test_sequential_fold(table, limit):
    def step(key, pdf, state):
        held = int(state.decode()) if state else 0
        out = []
        for row in pdf.itertuples():
            held = (held * 31 + row.v) % 1_000_003
            out.append((key[0], row.id, held))
        return pd.DataFrame(out, columns=["k", "id", "h"]), str(held).encode()

    got = rows(ordered.sequential_fold(table, ["k"], ["v", "id"], step, "k string, id string, h bigint", limit))
    want = []
    for k, part in expected().items():
        held = 0
        for v, i in part:
            held = (held * 31 + v) % 1_000_003
            want.append((k, i, held))
    assert got == sorted(want, key=str)
