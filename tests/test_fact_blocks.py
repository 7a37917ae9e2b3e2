"""Facts compared by blocks: brute force, order, and work that does not grow with parts of character sets."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mnemolake.operators import facts

FACTS = "tenant_id string, user_id string, semantic_id string, content string, seq int"


def forms(n, seed, row_id, vectors, ordered, letters="abcdefghijklmnopqrstuvwxyzäöß€😀"):
    r = random.Random(seed)
    vecs = [None, [], [1.0, 0.0], [0.9, 0.1], [-1.0, 0.2], [0.0, 0.0], [1.0, 0.0, 0.0]]
    out = pd.DataFrame(
        [("t", "u", "".join(sorted(r.sample(letters, r.choice([0, 3, 24, 25, 26, 27])))), r.choice(vecs) if vectors else None, 1, f"f{i:03d}", i * 7 % n) for i in r.sample(range(n), n)],
        columns=["tenant_id", "user_id", "chars", "vec", "n", row_id, "at"],
    )
    return out if ordered else out.drop(columns="at")


def brute(new, old):
    for _, x in new.iterrows():
        for _, y in old.iterrows():
            if "at" in new and not y["at"] < x["at"]:
                continue
            a, b = set(x["chars"]), set(y["chars"])
            sim = len(a & b) / len(a | b) if a | b else 0.0
            if x["vec"]:
                cos, v, w = 0.0, np.array(x["vec"]), np.array(y["vec"] or [])
                if len(v) == len(w) and v.any() and w.any():
                    cos = v @ w / (np.linalg.norm(v) * np.linalg.norm(w))
                sim = 0.4 * sim + 0.6 * cos
            yield x["form_id"], y["target_id"], round(sim, 9)


@pytest.mark.parametrize("vectors", [False, True])
@pytest.mark.parametrize("ordered", [False, True])
def test_kernels_equal_brute_force(vectors, ordered, monkeypatch):
    monkeypatch.setattr(facts, "STRIP", 16)
    new, old = forms(60, 1, "form_id", vectors, ordered), forms(70, 2, "target_id", vectors, ordered)
    pairs = list(brute(new, old))
    best = {}
    for form, target, sim in pairs:
        best[form] = min(best.get(form, (2.0, "")), (-sim, target))
    # A block pair may give a form up to three rows; the least of them is what the job keeps.
    got = {}
    for x in facts._best(new, old).itertuples():
        got[x.form_id] = min(got.get(x.form_id, (2.0, "")), (-round(x.sim, 9), x.target_id))
    assert got == best and len(best) > 50
    for floor in (0.0, 0.4, 0.8, 0.93, 1.0):
        close = facts._close(floor)(new, old)
        want = sorted(p for p in pairs if p[2] >= floor)
        assert want or floor > 0.9
        assert sorted((x.form_id, x.target_id, round(x.sim, 9)) for x in close.itertuples()) == want


def test_sets_of_most_of_an_alphabet_are_not_dealt_into_parts(spark):
    """Such texts share parts of their sets with almost all others, so a join on parts made more rows than there are pairs."""
    r = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz,.ABCDEFGH"
    rows = [("t", "u", f"f{i}", "".join(r.sample(letters, r.randint(28, 36))), i) for i in range(400)]
    new, old = (spark.createDataFrame(rows[i::2], FACTS) for i in (0, 1))
    for df in (facts.best_forms(facts.fact_forms(new), facts.fact_forms(old)), facts.fact_pairs(new, old, 0.93)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "posexplode" not in plan and "CoGroup" in plan
    assert facts.best_match(new, old).count() == 200


def test_texts_are_parsed_once_for_pairs(spark):
    """The comparison, its counts of blocks and the numbers of facts read written forms; each parsed all texts before."""
    rows = [("t", "u", f"f{i}", f"fact {i % 7} of words", i) for i in range(20)]
    new, old = (spark.createDataFrame(rows[i::2], FACTS) for i in (0, 1))
    pairs = facts.fact_pairs(new, old, 0.5)
    assert "content" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.n_new, r.n_old) for r in pairs.collect()} == {(1, 1), (1, 2), (2, 1), (2, 2)}


def test_every_blank_of_unicode_is_left_out(spark):
    blanks = [*range(9, 14), 32, 133, 160, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    text = "".join(f"b{chr(c)}\u200b" for c in blanks) + "\x1ca"
    found = spark.range(1).select(facts.char_set(F.lit(text)).alias("letters")).first()["letters"]
    assert found == ["\x1c", "a", "b", "\u200b"]
