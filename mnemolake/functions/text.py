"""Text helpers: tokens, entities, numbered lines. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemolake.functions.core import first_per_key, let, strip

# Patterns and word list of the entity heuristics, the analyzer and the fallback tokenizer.
QUOTED = r'["「『“‘]([^"」』”’]{2,40})["」』”’]'
PROPER = r"(?U)\b([A-Z][a-zA-Z]+(?:[\s-][A-Z][a-zA-Z]+)*)\b"
COMPOUND = r"[一-鿿]{2,8}"
NOUN = r"(?U)\b([a-zA-Z]{3,20})\b"
ANALYZER = r"[一-鿿]|[\p{L}\p{N}&&[^一-鿿]]+"
FALLBACK = r"[一-鿿]{2,}|[A-Za-z]{3,}"
BLANKS = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"  # Unicode White_Space
ENTITY_KINDS = ("QUOTED", "PROPER", "COMPOUND", "NOUN")
ENTITY_CONFIDENCE = (0.95, 0.85, 0.75, 0.55)
STOP_WORDS = (
    "the", "and", "but", "for", "with", "from", "into", "onto",
    "thing", "stuff", "way", "time", "today", "yesterday",
    "tomorrow", "user", "users", "memory", "memories",
    "今天", "昨天", "明天", "什么", "怎么", "可以", "需要",
    "用户", "我们", "你们", "他们", "这个", "那个", "一个",
    "时间", "事情", "东西", "问题", "情况",
)


def approx_tokens(text: Column) -> Column:
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("bigint")


def numbered_text(lines: Column) -> Column:
    """`[i] line` per element, line breaks inside an element become blanks."""
    flat = F.transform(
        lines,
        lambda t, i: F.concat(
            F.lit("["), i.cast("string"), F.lit("] "), strip(F.replace(F.coalesce(t, F.lit("")), F.lit("\n"), F.lit(" ")))
        ),
    )
    return F.array_join(flat, "\n")


def needs_refine(n_turns: Column, threshold: int = 10) -> Column:
    return n_turns > threshold


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(ANALYZER), F.lit(0))


def term_counts(text: Column) -> Column:
    """array<struct<term, tf, dl>> of one text, counted inside the row (sort, then run lengths): no shuffle."""

    def runs(s: Column) -> Column:
        heads = F.filter(
            F.transform(s, lambda t, i: F.struct(t.alias("key"), i.alias("at"))),
            lambda x: (x["at"] == 0) | (F.get(s, x["at"] - 1) != x["key"]),
        )
        return let(
            heads,
            lambda h: F.transform(
                h,
                lambda x, j: F.struct(
                    x["key"].alias("term"),
                    (F.coalesce(F.get(h, j + 1)["at"], F.size(s)) - x["at"]).alias("tf"),
                    F.size(s).alias("dl"),
                ),
            ),
        )

    return let(F.sort_array(tokens(text)), runs)


def fallback_tokens(text: Column) -> Column:
    """Runs of CJK (2+) or Latin letters (3+), case-insensitive dedupe keeping the first form."""
    found = F.regexp_extract_all(text, F.lit(FALLBACK), F.lit(0))
    keyed = F.transform(found, lambda t, i: F.struct(F.lower(t).alias("key"), i.alias("pos"), t.alias("text")))
    back = F.transform(first_per_key(keyed), lambda x: F.struct(x["pos"], x["text"]))
    return F.transform(F.sort_array(back), lambda x: x["text"])


def entity_structs(text: Column, stop=STOP_WORDS, min_len: int = 2, max_n: int = 20) -> Column:
    """array<struct<kind, neg_len, pos, key, text>> in output order (kind rank, longest first, first seen).

    Plain words come after all other kinds, so they are looked for only where those do not fill the list."""
    quotes = QUOTED[1 : QUOTED.index("]")]

    def found(pattern: str, group: int, kind: int) -> Column:
        matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        if kind == 0:  # most texts have no quotes, which is told sooner than by the pattern
            matches = F.when(F.translate(text, quotes, "") == text, F.array().cast("array<string>")).otherwise(matches)
        return F.transform(
            F.array_distinct(matches),
            lambda t: F.struct(F.lit(kind).alias("kind"), (strip(t) if kind == 0 else t).alias("text")),
        )

    named = F.concat(found(QUOTED, 1, 0), found(PROPER, 1, 1), found(COMPOUND, 0, 2))
    return let(
        _longest(named, stop, min_len, max_n),
        lambda kept: F.when(F.size(kept) >= max_n, kept).otherwise(
            _longest(F.concat(named, found(NOUN, 1, 3)), stop, min_len, max_n)
        ),
    )


def _longest(every: Column, stop, min_len: int, max_n: int) -> Column:
    """The first `max_n` entities of array<struct<kind, text>>, which comes by kind."""
    keyed = F.transform(
        every,
        lambda e, i: F.struct(
            F.lower(e["text"]).alias("key"), i.alias("pos"), e["kind"].alias("kind"), e["text"].alias("text")
        ),
    )
    valid = F.filter(keyed, lambda e: (F.length(e["text"]) >= min_len) & ~e["key"].isin(*stop))
    # Candidates arrive by kind rank, so the first form per key is also its best kind.
    ordered = F.sort_array(
        F.transform(
            first_per_key(valid),
            lambda e: F.struct(
                e["kind"].alias("kind"),
                (-F.length(e["text"])).alias("neg_len"),
                e["pos"].alias("pos"),
                e["key"].alias("key"),
                e["text"].alias("text"),
            ),
        )
    )
    # Longest first: a part of a kept entity of the same kind is dropped, and at most max_n are ever held.
    return let(
        ordered,
        lambda s: F.aggregate(
            s,
            F.slice(s, 1, 0),
            lambda kept, e: F.when(
                (F.size(kept) >= max_n)
                | F.exists(kept, lambda k: (k["kind"] == e["kind"]) & F.contains(k["key"], e["key"])),
                kept,
            ).otherwise(F.concat(kept, F.array(e))),
        ),
    )


def extract_entities(text: Column, stop=STOP_WORDS, min_len: int = 2, max_n: int = 20) -> Column:
    return F.transform(entity_structs(text, stop, min_len, max_n), lambda e: e["text"])


def entity_kind(kind: Column) -> Column:
    return F.get(F.array(*map(F.lit, ENTITY_KINDS)), kind)


def entity_confidence(kind: Column) -> Column:
    return F.get(F.array(*map(F.lit, ENTITY_CONFIDENCE)), kind)


def char_set(text: Column) -> Column:
    """Sorted distinct non-blank characters of the whole text. Blanks go last: few distinct characters are left to test."""
    return F.sort_array(F.filter(F.array_distinct(F.split(text, "")), lambda c: (c != "") & ~F.contains(F.lit(BLANKS), c)))


def char_jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(char_set(a), char_set(b))


def set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two arrays of distinct elements; two empty ones give 0."""

    def ratio(x: Column, y: Column) -> Column:
        return let(
            F.size(F.array_intersect(x, y)),
            lambda both: F.coalesce(F.try_divide(both, F.size(x) + F.size(y) - both), F.lit(0.0)),
        )

    return let(a, lambda x: let(b, lambda y: ratio(x, y)))


__all__ = [
    "approx_tokens", "numbered_text", "needs_refine", "tokens", "term_counts", "fallback_tokens", "entity_structs",
    "extract_entities", "entity_kind", "entity_confidence", "char_set", "char_jaccard", "set_jaccard",
]
