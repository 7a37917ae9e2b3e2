import pytest
from conftest import rows
from pyspark.sql import functions as F

from mnemolake.functions import models
from mnemolake.operators import extraction, ranking


def test_embed(spark):
    table = spark.createDataFrame([("a",), ("bbb",), (None,)], "t string")
    got = table.select(models.embed(F.col("t"), lambda texts: [[float(len(x)), 1.0] for x in texts], 2).alias("v"))
    assert sorted(r["v"] for r in got.collect()) == [[0.0, 1.0], [1.0, 1.0], [3.0, 1.0]]
    with pytest.raises(Exception, match="agreed size"):
        table.select(models.embed(F.col("t"), lambda texts: [[1.0] for _ in texts], 2)).collect()


def test_generate(spark):
    prompts = spark.createDataFrame([("1", "ok"), ("2", "bad")], "id string, prompt string")

    def model(prompt):
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper()

    assert rows(models.generate(prompts, "id", model)) == [("1", "OK", None), ("2", None, "no")]


def test_pair_scores(spark):
    pairs = spark.createDataFrame([("t", "u", "q", "a", "x", "xx"), ("t", "u", "q", "b", "x", "y")], "tenant_id string, user_id string, query_id string, memory_id string, query string, text string")
    scored = ranking.pair_scores(pairs, lambda q, t: [float(b.count(a)) for a, b in zip(q, t)])
    assert rows(scored) == [("t", "u", "q", "a", 2.0), ("t", "u", "q", "b", 0.0)]


def test_prompts(spark):
    templates = spark.createDataFrame([("p", "{{x}} {text}!", ["text"])], "prompt_id string, template string, variables array<string>")
    given = spark.createDataFrame([("1", "p", {"text": "has {braces}"}), ("2", "p", {"other": "y"})], "id string, prompt_id string, vars map<string,string>")
    got = extraction.render_prompts(given, templates)
    assert rows(got, "id", "prompt", "error") == [("1", "{x} has {braces}!", None), ("2", None, "missing: text")]
