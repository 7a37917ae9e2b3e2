"""Operators on embeddings and conversations against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemolake.llm import chat, quantised, topk

EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def vectors(seed=1, n=400, width=16):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(20, width))
    rows = []
    for i in range(n):
        v = base[i % 20] + rnd.normal(size=width) * rnd.choice([0.02, 0.3, 1.0])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i % 3)))
    nan, inf = float("nan"), float("inf")
    rows += [
        (1000, None, 1), (1050, [0.0] * width, 1), (1100, [nan] + [1.0] * (width - 1), 1), (1150, [inf] + [0.0] * (width - 1), 0),
        (1200, [None] + [1.0] * (width - 1), 0), (1250, rows[0][1], None), (1300, rows[0][1], 0), (1301, rows[0][1], 0), (1350, [1.0, 2.0], 0),
        (1351, [2.0, 4.0], 0), (1400, [], 0), (None, rows[0][1], 0), (1450, [2 * x for x in rows[0][1]], 0),
    ]
    return rows


def fine(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def plain_topk(rows, k=5):
    whole = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v, _ in rows if fine(v) and i is not None]
    out = []
    for q, a in whole:
        if q % 50 == 0:
            hits = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q and len(a) == len(b))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(hits)]
    return sorted(out)


@pytest.mark.parametrize("candidates,queries", [(8192, 1024), (50, 3)])
def test_top_k_is_exact(spark, monkeypatch, candidates, queries):
    monkeypatch.setattr(topk, "CANDIDATES", candidates)
    monkeypatch.setattr(topk, "QUERIES", queries)
    rows = vectors()
    df = spark.createDataFrame(rows, EMBEDDINGS).withColumn("score", F.lit("x")).withColumn("size", F.lit(1))
    got = topk.top_k(df, F.col("vec_id") % 50 == 0)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == plain_topk(rows)


def test_top_k_small_sample_and_large_numbers(spark, monkeypatch):
    monkeypatch.setattr(topk, "SAMPLE", 7)
    rows = [(i, [float(x * 2.0**13) for x in v], y) for i, v, y in vectors(2, 120) if fine(v) and i is not None]
    got = topk.top_k(spark.createDataFrame(rows, EMBEDDINGS), F.col("vec_id") % 50 == 0)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == plain_topk(rows)


def test_top_k_empty(spark):
    assert topk.top_k(spark.createDataFrame([], EMBEDDINGS), F.col("vec_id") % 50 == 0).count() == 0


def plain_links(rows, cosine=0.98):
    live = [fine(v) and y is not None and any(v) for _, v, y in rows]
    n, links = len(rows), np.zeros(len(rows), int)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if live[a] and live[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= cosine:
                    links[a] += 1
                    links[b] += 1
                    root[find(a)] = find(b)
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(i)
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in groups[find(i)] if rows[j][0] is not None] if live[i] else [rows[i][0]]
        least = min(ids, default=None) if ids != [None] else None
        out.append((rows[i][0], int(links[i]), least, rows[i][0] == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [2048, 5])
def test_near_vectors_lose_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(quantised, "BLOCK", block)
    rows = vectors(3)
    df = spark.createDataFrame(rows, EMBEDDINGS).withColumn("form", F.lit(1)).withColumn("n_links", F.lit(1))
    got = quantised.near_vectors(df).select("vec_id", "n_links", "component_id", "kept")
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_links(rows)


def test_near_vectors_from_a_small_sample(spark):
    rows = vectors(4, 200)
    got = quantised.near_vectors(spark.createDataFrame(rows, EMBEDDINGS), 0.9, rows=9).select("vec_id", "n_links", "component_id", "kept")
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_links(rows, 0.9)


def test_near_vectors_without_usable_rows(spark):
    got = quantised.near_vectors(spark.createDataFrame([(1, None, 1), (2, [0.0], 1)], EMBEDDINGS)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert quantised.near_vectors(spark.createDataFrame([], EMBEDDINGS)).count() == 0


TURNS = "conv_id long, turn long, role string, text string, formatted string, conflict boolean"


def test_chat_round_trip(spark):
    texts = [
        "plain", "</s>", "<\\s> <\\\\/s>", "<<s>[[INST]", None, "", "]</s", "x<", "é😀 [/INST]", "a\n\nb", "[\\INST]", "$1 \\1 \\", "<s>" * 5, "y" * 200_000,
    ]
    rows = [(i % 4, i, ["user", "assistant", None, "[INST]"][i % 4 if i < 8 else i % 2], t, "x", True) for i, t in enumerate(texts)]
    rows += [(None, None, "assistant", "n", None, None), (2, 2, "assistant", "same", None, None), (2, 2, "assistant", "same", None, None)]
    df = chat.with_loss(chat.format_conversations(spark.createDataFrame(rows, TURNS)))
    got = {r.conv_id: r for r in df.collect()}
    assert set(got) == {0, 1, 2, 3, None}
    for conv, r in got.items():
        mine = sorted(
            ((t is not None, t or 0, role or "", text or "") for c, t, role, text, *_ in rows if c == conv),
        )
        assert [(t.role, t.text) for t in r.recovered] == [(role, text) for _, _, role, text in mine]
        assert r.loss_text == "".join(text for _, _, role, text in mine if role == "assistant")
        assert len(r.loss) == sum(role == "assistant" for _, _, role, _ in mine)
        inner = [r.formatted[s.start : s.end] for s in r.loss]
        assert all("</s>" not in x and "[INST]" not in x and "[/INST]" not in x and "<s>" not in x for x in inner)


def test_chat_empty(spark):
    assert chat.format_conversations(spark.createDataFrame([], TURNS)).count() == 0
