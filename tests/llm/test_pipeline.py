"""The pipeline, stage by stage against plain Python, and the registered queries."""

import hashlib
import os
import re
from collections import Counter

import numpy as np
import pytest
from test_documents import plain_components, plain_simhash, plain_targets

from mnemolake.llm import mixing, quality, secrets
from mnemolake.llm.bpe import vocabulary_path
from mnemolake.llm.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"

if not os.path.isdir(FOLDER):
    pytest.skip("no test tables", allow_module_level=True)

import corpus_pipeline  # noqa: E402
from check import compare, duck  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def redacted(text):
    spans = []
    for kind, (pattern, group, least) in secrets.RULES.items():
        spans += [m.span() for m in re.finditer(pattern.replace("(?i:", "(?ai:"), text) if len(m[group]) >= least]
    out, at = [], 0
    for lo, hi in sorted(spans):
        if lo >= at:
            out += [text[at:lo], "[secret]"]
        at = max(at, hi)
    return "".join(out) + text[at:]


def draw(doc_id):
    return int(hashlib.sha256(f"{mixing.SEED}:{doc_id}".encode()).hexdigest()[:8], 16) / 2**32


def test_pipeline_as_plain_python(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(vocabulary_path())
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model, stats = quality.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    good = {r.doc_id for r in stats.collect() if model is None or model.score(np.array([r.x]))[0] >= 0.7}
    rows = sorted((r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id in good)
    prints = [plain_simhash(t) for _, t, _ in rows]
    root = plain_components(prints, lambda a, b: bin(a ^ b).count("1") <= 3)
    rows = [(d, redacted(t), s) for i, (d, t, s) in enumerate(rows) if root[i] == i]
    sizes, targets = Counter(), None
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t))
    targets = plain_targets(dict(sizes))
    want = []
    for source in sizes:
        rate = targets[source] / sizes[source] if sizes[source] else 0.0
        mine = [(d, t) for d, t, s in rows if s == source]
        for d, t in mine:
            n = int(rate) + (draw(d) < rate - int(rate))
            ids = library.encode(t, add_special_tokens=False).ids
            text = library.decode(ids, skip_special_tokens=False)
            want += [(d, source, len(ids), np.array(ids, "<u4").tobytes(), hashlib.sha256(text.encode()).hexdigest())] * n
    got = [(r.doc_id, r.source, r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, FOLDER).collect()]
    assert len(got) > 50 and sorted(got) == sorted(want)


@pytest.mark.parametrize("schema", ["doc_id long, text string, lang string, source string, n_chars long, size long, e string"])
def test_stages_on_odd_and_empty_tables(spark, schema):
    odd = spark.createDataFrame([(1, None, None, None, None, 1, "x"), (1, "", "en", "a", 0, 1, "x"), (None, "b", "en", "a", 1, 1, "x")], schema)
    for frame in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert tuple(stage(spark, frame, FOLDER).columns) == corpus_pipeline.COLUMNS, name
            stage(spark, frame, FOLDER).count()
        assert corpus_pipeline.STAGES[-1][1](spark, frame, FOLDER).count() == frame.count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_as_its_sql(spark, name):
    text, _, ok = compare(spark, duck(FOLDER), name, QUERIES[name], ORACLES[name], FOLDER)
    assert ok, text


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
