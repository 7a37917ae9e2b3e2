import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from mnemolake.functions import answers, scoring, text, vectors
from mnemolake.functions.core import hash_bucket


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return frame.select(column.alias("x")).first()["x"]


def on_text(spark, fn, value):
    return one(spark, fn(F.col("t")), t=value)


def test_entities(spark):
    got = on_text(spark, text.extract_entities, 'We met "Project Alpha" with Alice Smith; the thing for users today')
    assert got[:2] == ["Project Alpha", "Alice Smith"]
    assert not {"thing", "users", "today", "the"} & {e.lower() for e in got}
    assert on_text(spark, text.extract_entities, "我们在北京吃烤鸭") == ["我们在北京吃烤鸭"]
    assert on_text(spark, text.extract_entities, "什么") == []
    assert on_text(spark, text.extract_entities, "  ") == []
    # a part of a longer entity of the same kind goes, one of another kind stays
    assert on_text(spark, text.extract_entities, "planning plan Plans") == ["Plans", "planning"]
    many = " ".join("w" + chr(97 + i // 26) + chr(97 + i % 26) + "qz" for i in range(60))
    assert len(on_text(spark, text.extract_entities, many)) == 20


def test_word_border_is_unicode(spark):
    assert on_text(spark, text.extract_entities, "éclair noél") == []


def test_tokens(spark):
    assert on_text(spark, text.tokens, "Hello, 北京 v2!") == ["hello", "北", "京", "v2"]
    counts = on_text(spark, text.term_counts, "b a b")
    assert [(c["term"], c["tf"], c["dl"]) for c in counts] == [("a", 1, 3), ("b", 2, 3)]
    assert on_text(spark, text.term_counts, "!!") == []
    assert on_text(spark, text.fallback_tokens, "Foo foo ab 北京 京 BAR") == ["Foo", "北京", "BAR"]


def test_small_text(spark):
    assert on_text(spark, text.approx_tokens, "abcdefghi") == 2
    lines = F.array(F.lit(" a\nb "), F.lit("c"))
    assert one(spark, text.numbered_text(lines)) == "[0] a b\n[1] c"
    assert one(spark, text.char_jaccard(F.lit("abc"), F.lit("a bd"))) == pytest.approx(0.5)
    assert one(spark, text.char_jaccard(F.lit(" "), F.lit(""))) == 0
    assert one(spark, text.char_jaccard(F.lit("ABCDE"), F.lit("vwxyz"))) == 0


@pytest.mark.parametrize("answer, n", [
    ('[{"a":1},{"b":2}]', 2), ('{"a":1}', 1), ('```json\n[{"a":1}]\n```', 1), ('so: {"a":1} ok', 1),
    ('x [{"a":1}, 3, "s"] y', 1), ("nothing", 0), ("", 0), ("5", 0), ('has [] and {"a":1}', 0),
])
def test_parse_items(spark, answer, n):
    assert on_text(spark, lambda t: F.size(answers.parse_items(t)), answer) == n


def test_fields(spark):
    item = F.parse_json(F.lit('{"s":"  x ","n":"1.7","l":"a, b,,","m":["c"," "],"bad":"z"}'))
    assert one(spark, answers.text_field(item, "s")) == "x"
    assert one(spark, answers.number_field(item, "n", 0.0, 0.0, 1.0)) == 1.0
    assert one(spark, answers.number_field(item, "bad", 0.5, 0.0, 1.0)) == 0.5
    assert one(spark, answers.number_field(item, "none", None, 0.0, 1.0)) is None
    assert one(spark, answers.list_field(item, "l")) == ["a", "b"]
    assert one(spark, answers.list_field(item, "m")) == ["c"]
    assert one(spark, answers.list_field(item, "none")) == []


def test_score_parts(spark):
    parts = scoring.score_parts(F.lit(60.0), F.lit(3), F.lit(2.0), F.lit(1), F.lit("x" * 100))
    got = {k: one(spark, c) for k, c in parts.items()}
    assert got["cqa"] == pytest.approx(0.2) and got["bve"] == pytest.approx(0.8)
    assert got["trs"] == pytest.approx(0.25) and got["src"] == pytest.approx(0.3)
    assert got["composite"] == pytest.approx(0.25 * 0.2 + 0.3 * 0.8 + 0.25 * 0.25 + 0.2 * 0.3)


@pytest.mark.parametrize("access, age, state", [
    (10, 30, "ACTIVE"), (0, 2 / 24, "ACTIVE"), (2, 30, "WARM"), (0, 3, "WARM"), (0, 30, "COLD"), (0, 120, "ARCHIVED"),
])
def test_states(spark, access, age, state):
    assert one(spark, scoring.compute_state(F.lit(access), F.lit(float(age)))) == state


@pytest.mark.parametrize("sim, decision", [(0.97, "NOOP"), (0.95, "SUPERSEDE"), (0.9, "UPDATE"), (0.2, "ADD")])
def test_decide(spark, sim, decision):
    assert one(spark, scoring.decide(F.lit(sim))) == decision


def test_supersede_of_equal_text(spark):
    sim = vectors.composite_sim(F.lit(1.0), F.lit(0.917), F.lit(True))
    assert one(spark, scoring.decide(sim)) == "SUPERSEDE"
    assert one(spark, scoring.decide(F.lit(1.0), scoring.FactThresholds(noop=1.01))) == "SUPERSEDE"


def test_time(spark):
    a, b = dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 2, 12)
    assert one(spark, scoring.age_days(F.lit(a), F.lit(b))) == pytest.approx(1.5)
    assert one(spark, scoring.age_days(F.lit(b), F.lit(a))) == 0
    assert one(spark, scoring.retention(F.lit(0.0), F.lit(1.0), F.lit(10))) == pytest.approx(1.0)
    assert one(spark, scoring.retention(F.lit(8.0), F.lit(1.0), F.lit(0))) == pytest.approx(0.6 * math.exp(-2))
    phase = lambda d: one(spark, scoring.pick_phase(F.lit("all"), F.lit(d)))
    assert phase(dt.datetime(2026, 1, 4, 6)) == "rem" and phase(dt.datetime(2026, 1, 5, 4)) == "deep"
    assert phase(dt.datetime(2026, 1, 5, 6)) == "light"


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(i)).cast("float") for i in x])
    assert one(spark, vectors.cosine(v(1, 0), v(1, 1))) == pytest.approx(1 / math.sqrt(2))
    assert one(spark, vectors.cosine(v(0, 0), v(1, 1))) == 0
    assert one(spark, vectors.cosine(v(1), v(1, 1))) == 0
    assert one(spark, vectors.ip(v(2, 3), v(1, 1))) == 5
    assert one(spark, vectors.neg_l2(v(0, 3), v(4, 0))) == -5


def test_hash_bucket(spark):
    import hashlib

    for name in ("u1", "someone", "北京"):
        want = int.from_bytes(hashlib.md5(name.encode()).digest()[:4], "big") % 100
        assert one(spark, hash_bucket(F.lit(name))) == want


def test_plain_words_fill_what_other_entities_leave(spark):
    """Names come first; plain words are looked for only where names and quotes do not fill the list."""
    names = " ".join(f"meets Name{chr(97 + i)}" for i in range(20))
    assert len(on_text(spark, text.extract_entities, names)) == 20
    few = 'the gamma of Alpha Beta met “alpha beta” and gammas'
    assert on_text(spark, text.extract_entities, few) == ["alpha beta", "gammas", "Alpha", "Beta", "met"]
    plan = spark.range(1).select(text.extract_entities(F.lit("x").alias("t")))._jdf.queryExecution().analyzed().toString()
    assert "CASE WHEN (size(" in plan
