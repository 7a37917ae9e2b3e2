"""The set-similarity join against brute force, how its work grows, and forms compared through it."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from mnemolake.operators import facts, setjoin

SETS = "tenant_id string, user_id string, id string, elements array<string>"
FACTS = "tenant_id string, user_id string, semantic_id string, content string, seq int"


def near_sets(n, seed, letters="abcdefghijklmnopqrstuvwxyzäöü0123456789"):
    """Sets around some centres, so that all similarities occur."""
    r = random.Random(seed)
    centres = [r.sample(letters, r.randint(1, 24)) for _ in range(max(1, n // 6))]
    out = []
    for i in range(n):
        own = set(r.choice(centres))
        for c in r.sample(letters, r.randint(0, 4)):
            own ^= {c}
        out.append(("t", f"u{i % 2}", f"s{i}", sorted(own)))
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


@pytest.mark.parametrize("floor", [0.7, 0.85, 0.93, 1.0])
def test_no_pair_is_lost_and_none_comes_twice(spark, floor):
    sets = near_sets(300, 1)
    left, right = sets[:150], sets[150:] + [("t", "u0", "empty", []), ("t", "u1", "none", None)]
    a, b = spark.createDataFrame(left, SETS), spark.createDataFrame(right, SETS)
    found = setjoin.candidates(a, b, ["tenant_id", "user_id"], floor, (["id"], ["id"]))
    got = found.filter(setjoin.jaccard_of(found) >= floor - 1e-12).select("l_id", "r_id").collect()
    want = [
        (x[2], y[2]) for x in left for y in right if x[:2] == y[:2] and jaccard(set(x[3]), set(y[3] or ())) >= floor - 1e-12
    ]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 3
    assert found.select("l_id", "r_id").distinct().count() == found.count()


def test_compared_pairs_grow_slower_than_all_pairs(spark):
    """Ten times the facts of one user are a hundred times the pairs; far fewer come to be compared."""
    r = random.Random(4)
    texts = ["".join(r.sample("abcdefghijklmnopqrstuvwxyzäöüß0123456789éèàç", r.randint(14, 30))) for _ in range(4000)]

    def compared(n):
        new = spark.createDataFrame([("t", "u", f"n{i}", t, i) for i, t in enumerate(texts[:n])], FACTS)
        old = spark.createDataFrame([("t", "u", f"o{i}", t, i) for i, t in enumerate(texts[2000 : 2000 + n])], FACTS)
        return facts.candidate_pairs(facts.fact_forms(new), facts.fact_forms(old), 0.93).count()

    small, large = compared(200), compared(2000)
    assert large <= 0.02 * 2000 * 2000
    assert large <= 60 * max(small, 1) or large < 4000


def test_best_match_is_exact_above_and_below_the_likely_threshold(spark):
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    new = [("t", f"u{i % 3}", f"n{i}", "".join(r.sample(letters, r.randint(0, 26))), i) for i in range(80)]
    old = [("t", f"u{i % 3}", f"o{i:03d}", "".join(r.sample(letters, r.randint(1, 26))), i) for i in range(120)]
    old += [("t", "u1", f"o{200 + i}", n[3][:-1], i) for i, n in enumerate(new[:30]) if len(n[3]) > 3]
    got = facts.best_match(spark.createDataFrame(new, FACTS), spark.createDataFrame(old, FACTS), 16)
    want = []
    for n in new:
        sims = [(-round(jaccard(set(n[3]), set(o[3])), 9), o[2]) for o in old if o[1] == n[1]]
        sim, target = min(sims)
        want.append((n[2], target, round(-sim, 6)))
    assert rows(got.select("semantic_id", "target_id", F.round("sim", 6))) == sorted(want, key=str)
    levels = [w[2] for w in want]
    assert min(levels) < 0.5 and sum(x >= facts.LIKELY for x in levels) > 5


@pytest.mark.parametrize("noop", [0.93, 0.75, 0.6])
def test_consolidation_with_vectors_as_a_plain_loop(spark, noop):
    from mnemolake.functions.scoring import FactThresholds

    r = random.Random(6)

    def fact(name, i):
        text = "".join(sorted(set("abcdefgh") ^ set(r.sample("abcdefghijkl", r.randint(0, 3)))))
        vec = r.choice([None, [], [1.0, 0.0], [0.9, 0.1], [0.0, 1.0], [0.0, 0.0], [1.0, 0.0, 0.0]])
        return "t", f"u{i % 2}", f"{name}{i:02d}", text, i, vec

    new, old = [fact("n", i) for i in range(40)], [fact("o", i) for i in range(6)]

    def similar(a, b):
        j = jaccard(set(a[3]), set(b[3]))
        if not a[5]:
            return round(j, 9)
        cos = 0.0
        if b[5] and len(b[5]) == len(a[5]):
            length = (sum(x * x for x in a[5]) * sum(x * x for x in b[5])) ** 0.5
            cos = sum(x * y for x, y in zip(a[5], b[5])) / length if length else 0.0
        return round(0.4 * j + 0.6 * cos, 9)

    kept = []
    for a in new:
        if all(similar(a, b) < noop for b in [*old, *kept] if b[1] == a[1]):
            kept.append(a)
    schema = FACTS + ", embedding array<double>"
    got = facts.consolidate_facts(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema), FactThresholds(noop=noop), block=8)
    assert sorted(x["semantic_id"] for x in got.collect()) == sorted(a[2] for a in kept)
