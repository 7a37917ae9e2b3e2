"""Phrase collocations: counts of word n-grams by tries of hash containers, scored by their weakest cut.

A task counts the phrases of its texts in a shallow trie keyed by word numbers. Its nodes start as one hash container each
and burst into children by the next word when they grow. A trie that is full spills its largest subtrees whole, as runs of
phrases in order; the runs of a prefix partition are merged by one exchange. A phrase cannot be more frequent than its parts,
so longer phrases are only counted where a sieve, a bitmap of bounded size over the frequent parts, lets them pass; what the
sieve passes by accident is counted like the rest, and falls to the same threshold.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemolake.llm.registry import query, table
from mnemolake.session import materialize

LEAST = 30  # occurrences of a candidate
LONGEST = 4  # words of a candidate
COVERED = 80  # percent of a candidate's occurrences in a longer one from which on it is dropped
TOP = 2000  # phrases per language
SCALE = 2_000_000
BURST = 4096  # entries of a container
FULL = 1_000_000  # entries of a task's trie
WORDS = 1 << 19  # numbered words of a task; they start anew when full
STEP = 1 << 19  # words that are numbered in one go, so that numbers stay below 21 bits
SIEVE_BITS = 1 << 30  # at most; 16 bits a frequent phrase otherwise
BITS = 21
RUN_ROWS = 100_000
STOPS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz.........")
PREFIXES = 1 << 14  # prefix partitions of a language
RUNS = "lang string, prefix int, phrase string, f long"
_FOLD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def tokens(texts: list[str]) -> list[bytes]:
    """Words of texts, with b"." between pieces; after the translation only spaces and tabs are left as white space."""
    return b".".join(t.encode() for t in texts).translate(STOPS).replace(b".", b" . ").split()


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang.encode() + b"\0" + word, 42)


def fold(hashes: list[np.ndarray]) -> np.ndarray:
    """One 64-bit number per phrase from those of its words, by wrapping arithmetic."""
    out = hashes[0]
    for more in hashes[1:]:
        out = out * _FOLD + more
    return out


def places(folded: np.ndarray, bits: int) -> np.ndarray:
    mixed = (folded ^ folded >> np.uint64(32)) * _MIX
    return ((mixed ^ mixed >> np.uint64(29)) & np.uint64(bits - 1)).astype(np.int64)


class Sieve:
    """A bitmap over folded hashes: what it does not pass is surely not frequent."""

    def __init__(self, packed: np.ndarray):
        self.packed, self.bits = packed, len(packed) * 8

    def passes(self, folded: np.ndarray) -> np.ndarray:
        at = places(folded, self.bits)
        return (self.packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


class Node:
    """A container of packed word numbers and counts, or, once burst, children by the next word."""

    __slots__ = ("table", "children", "words")

    def __init__(self, words: int):
        self.table: dict[int, int] | None = {}
        self.children: dict[int, Node] | None = None
        self.words = words  # of the packed keys here

    def leaf(self, key: int) -> tuple[Node, int]:
        """The container of a key, and the first key that would be there."""
        at, base = self, 0
        while at.children is not None:
            shift = BITS * (at.words - 1)
            word = key - base >> shift
            base += word << shift
            below = at.children.get(word)
            if below is None:
                below = at.children[word] = Node(at.words - 1)
            at = below
        return at, base

    def burst(self) -> None:
        held, self.table, self.children = self.table, None, {}
        shift = BITS * (self.words - 1)
        for key, n in held.items():
            below = self.children.get(key >> shift)
            if below is None:
                below = self.children[key >> shift] = Node(self.words - 1)
            below.table[key & (1 << shift) - 1] = n

    def size(self) -> int:
        return len(self.table) if self.children is None else sum(c.size() for c in self.children.values())

    def columns(self, before: tuple[int, ...] = ()) -> Iterator[np.ndarray]:
        """Per container an array whose rows are the words of its phrases, one after the other, and the counts."""
        if self.children is not None:
            for word, below in self.children.items():
                yield from below.columns((*before, word))
        elif self.table:
            n, mask = len(self.table), (1 << BITS) - 1
            out = np.empty((len(before) + self.words + 1, n), np.int64)
            out[: len(before)] = np.array(before, np.int64)[:, None]
            if self.words > 3:  # too long for a number of 64 bits
                last = np.array([k & mask for k in self.table], np.int64)
                keys = np.array([k >> BITS for k in self.table], np.int64)
                rest, out[-2] = self.words - 1, last
            else:
                keys, rest = np.fromiter(self.table, np.int64, n), self.words
            for i in range(rest):
                out[len(before) + i] = keys >> BITS * (rest - 1 - i) & mask
            out[-1] = np.fromiter(self.table.values(), np.int64, n)
            yield out


class Trie:
    """Counts of phrases of one size; `spill` takes whole subtrees out."""

    def __init__(self, size: int):
        self.root, self.held = Node(size), 0

    def add(self, keys: list[int], counts: list[int]) -> None:
        """Keys come in order, so that neighbours mostly meet the same container."""
        end, base, at, table = -1, 0, self.root, {}
        for key, n in zip(keys, counts):
            if key >= end:
                at, base = self.root.leaf(key)
                table, end = at.table, base + (1 << BITS * at.words)
            own = key - base
            if own in table:
                table[own] += n
            else:
                table[own] = n
                self.held += 1
                if len(table) > BURST and at.words > 1:
                    at.burst()
                    end = -1

    def spill(self, keep: int) -> np.ndarray:
        """The largest subtrees, until at most `keep` entries are left: rows of words, and one of counts."""
        root = self.root
        if root.children is None or not keep:
            out, self.root, self.held = list(root.columns()), Node(root.words), 0
        else:
            out = []
            for word, _ in sorted(((w, c.size()) for w, c in root.children.items()), key=lambda x: -x[1]):
                if self.held <= keep:
                    break
                below = list(root.children.pop(word).columns((word,)))
                self.held -= sum(c.shape[1] for c in below)
                out += below
        return np.concatenate([np.empty((root.words + 1, 0), np.int64), *out], 1)


class Counting:
    """Phrases of some sizes in the texts of one language, in one task."""

    def __init__(self, lang: str, sizes: tuple[int, ...], words: Sieve | None, pairs: Sieve | None):
        self.lang, self.sizes, self.words, self.pairs = lang, sizes, words, pairs
        self.begin()

    def begin(self) -> None:
        self.tries = {s: Trie(s) for s in self.sizes}
        self.numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.names: list[bytes] = [b"."]
        self.hashes, self.known = np.zeros(1, np.uint64), np.zeros(1, bool)
        self.numbers[b"."]

    def read(self, texts: list[str]) -> Iterator[pa.RecordBatch]:
        """Count the phrases of texts; what does not fit comes out as runs."""
        found = tokens(texts)
        for at in range(0, len(found), STEP):
            self.count(found[at : at + STEP + LONGEST - 1])
            yield from self.runs(False)

    def count(self, found: list[bytes]) -> None:
        """Count the phrases that start within the first STEP of these words."""
        ids = np.fromiter(map(self.numbers.__getitem__, found), np.int64, len(found))
        fresh = list(islice(reversed(self.numbers), len(self.numbers) - len(self.names)))[::-1]
        if fresh:
            hashes = np.array([word_hash(self.lang, w) for w in fresh], np.uint64)
            self.names += fresh
            self.hashes = np.concatenate([self.hashes, hashes])
            self.known = np.concatenate([self.known, self.words.passes(hashes) if self.words else np.ones(len(fresh), bool)])
        if 1 in self.sizes:
            often = np.bincount(ids[:STEP], minlength=1)
            often[0] = 0
            self.keep(1, np.flatnonzero(often), often[often > 0])
        if self.sizes == (1,) or len(ids) < 2:
            return
        good = self.known[ids]
        pair = good[:-1] & good[1:]
        if 2 in self.sizes:
            at = np.flatnonzero(pair[:STEP])
            self.keep(2, *np.unique(ids[at] << BITS | ids[at + 1], return_counts=True))
        if self.pairs:
            at = np.flatnonzero(pair)
            pair[at] = self.pairs.passes(fold([self.hashes[ids[at]], self.hashes[ids[at + 1]]]))
        if 3 in self.sizes:
            triple = pair[:-1] & pair[1:]
            at = np.flatnonzero(triple[:STEP])
            threes = ids[at] << 2 * BITS | ids[at + 1] << BITS | ids[at + 2]
            held, name, often = np.unique(threes, return_inverse=True, return_counts=True)
            self.keep(3, held, often)
            if 4 in self.sizes:
                follows = np.flatnonzero(np.append(triple, False)[at + 1])
                codes, often = np.unique(name[follows] << BITS | ids[at[follows] + 3], return_counts=True)
                first, last = held[codes >> BITS].tolist(), (codes & (1 << BITS) - 1).tolist()
                self.keep(4, [t << BITS | w for t, w in zip(first, last)], often)

    def keep(self, size: int, keys, counts) -> None:
        self.tries[size].add(keys if isinstance(keys, list) else keys.tolist(), counts.tolist())

    def runs(self, all_of_it: bool) -> Iterator[pa.RecordBatch]:
        """What is over the bound, or everything, as runs in order of the phrases."""
        anew = all_of_it or len(self.names) > WORDS
        held = sum(t.held for t in self.tries.values())
        if not anew and held <= FULL:
            return
        for size, trie in self.tries.items():
            spilled = trie.spill(0 if anew else trie.held // 2)
            for at in range(0, spilled.shape[1], RUN_ROWS):
                yield self.run(spilled[:-1, at : at + RUN_ROWS], spilled[-1, at : at + RUN_ROWS])
        if anew:
            self.begin()

    def run(self, words: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        names = pa.array(self.names, pa.binary())
        phrases = pc.binary_join_element_wise(*(names.take(pa.array(w)) for w in words), b" ")
        order = pc.sort_indices(phrases)
        prefix = places(fold([self.hashes[w] for w in words[:3]]), PREFIXES).astype(np.int32)
        lang = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(counts), np.int32)), [self.lang]).cast(pa.string())
        return pa.RecordBatch.from_arrays(
            [lang, pa.array(prefix).take(order), phrases.take(order).cast(pa.string()), pa.array(counts).take(order)],
            names=["lang", "prefix", "phrase", "f"],
        )


def count_phrases(texts: DataFrame, sizes: tuple[int, ...], words: np.ndarray | None = None, pairs: np.ndarray | None = None) -> DataFrame:
    """(lang, text), without nulls, to lang, phrase and f, the number of its occurrences.

    With sieves (packed bitmaps of the frequent words and pairs) phrases that cannot be frequent are left out."""
    context = texts.sparkSession.sparkContext
    sent = {n: context.broadcast(b) for n, b in (("words", words), ("pairs", pairs)) if b is not None}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieves = {n: Sieve(b.value) for n, b in sent.items()}
        counting: dict[str, Counting] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, own in by.items():
                if lang not in counting:
                    counting[lang] = Counting(lang, sizes, sieves.get("words"), sieves.get("pairs"))
                yield from counting[lang].read(own)
            if len(counting) > 64:  # languages that a task keeps tries of
                for own in counting.values():
                    yield from own.runs(True)
                counting.clear()
        for own in counting.values():
            yield from own.runs(True)

    runs = texts.select("lang", "text").mapInArrow(each, RUNS)
    return runs.repartition("lang", "prefix").groupBy("lang", "prefix", "phrase").agg(F.sum("f").alias("f")).drop("prefix")


def sieve_of(frequent: DataFrame, most: int = SIEVE_BITS) -> np.ndarray:
    """The packed bitmap of (lang, phrase): 16 bits a phrase, between 2^15 and `most` bits in all. Spark builds it in blocks of
    32,768 bits, so what the driver takes together is bounded by `most`, not by the number of phrases."""
    bits = 1 << 15
    rows = frequent.count()
    while bits < min(16 * rows, most):
        bits *= 2

    @F.pandas_udf("long")
    def place(lang: pd.Series, phrase: pd.Series) -> pd.Series:
        folded = [fold([np.array([word_hash(a, w)], np.uint64) for w in p.encode().split(b" ")])[0] for a, p in zip(lang, phrase)]
        return pd.Series(places(np.array(folded, np.uint64), bits))

    at = frequent.select((place("lang", "phrase") + 1).alias("at"))
    blocks = at.groupBy(F.bitmap_bucket_number("at").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    packed = np.zeros(bits // 8, np.uint8)
    for row in blocks.toLocalIterator():
        packed[(row["block"] - 1) * 4096 : row["block"] * 4096] = np.frombuffer(row["bits"], np.uint8)
    return packed


def phrase_counts(documents: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, n) and the table of frequent phrases (lang, phrase, f) of 1 to 4 words, in three passes over the texts."""
    texts = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = materialize(count_phrases(texts, (1,)), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    words = words.filter(F.col("f") >= least)
    word_sieve = sieve_of(words)
    pairs = materialize(count_phrases(texts, (2,), word_sieve).filter(F.col("f") >= least), "pairs")
    longer = materialize(count_phrases(texts, (3, 4), word_sieve, sieve_of(pairs)).filter(F.col("f") >= least), "longer")
    return totals, words.unionByName(pairs).unionByName(longer)


def _part(first, size) -> F.Column:
    return F.array_join(F.slice("words", first, size), " ")


def collocations(documents: DataFrame, least: int = LEAST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of 2 to 4 words of each language.

    Texts are read whole; null ones are empty, a null lang is `und`. Repeated rows count each time, further columns are not
    read, an empty table gives no rows. The score is that of the cut with the least floor(2000000 a / (l + r)), ties to the
    shorter first part; ranks go by score and a, descending, then by the phrase's bytes, so they have no ties.
    """
    totals, counted = phrase_counts(documents, least)
    counted = counted.withColumn("size", F.length("phrase") - F.length(F.replace("phrase", F.lit(" "))) + 1)
    words = F.split("phrase", " ")
    candidates = counted.filter("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), words.alias("words"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("head"), _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    heads = counted.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = counted.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    both = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    score = F.expr(f"(CAST({SCALE} AS DECIMAL(38, 0)) * a) div (CAST(l AS DECIMAL(38, 0)) + r)")
    least_cut = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = both.groupBy("lang", "phrase", "a").agg(least_cut)
    # Every shorter phrase of two or more words within a candidate, with the candidate's count.
    inner = candidates.filter("size > 2").withColumn("inner_size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("first", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("inner_size") + 1)))
    inner = inner.select("lang", _part(F.col("first"), F.col("inner_size")).alias("phrase"), F.col("a").alias("longer"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").filter(
        F.expr(f"longer IS NULL OR CAST(100 AS DECIMAL(38, 0)) * longer < CAST({covered} AS DECIMAL(38, 0)) * a")
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    ranked = kept.withColumn("rank", place.cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents
), parts AS (
  SELECT lang, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM pieces, (SELECT unnest(range(1, {LONGEST + 1})) AS size) WHERE len(w) >= size
), counted AS (
  SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase, count(*) AS f FROM parts GROUP BY ALL
), totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE size = 1 GROUP BY lang
), candidates AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE size > 1 AND f >= {LEAST}
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k, h.f AS l, t.f AS r, CAST({SCALE} AS HUGEINT) * c.a // (CAST(h.f AS HUGEINT) + t.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
  JOIN counted h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1 : k], ' ')
  JOIN counted t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[k + 1 : c.size], ' ')
), scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, array_to_string(w[i : i + s - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, size - s + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS s FROM candidates WHERE size > 2)) GROUP BY ALL
), kept AS (
  SELECT s.* FROM scored s LEFT JOIN inside i USING (lang, phrase) WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST({COVERED} AS HUGEINT) * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= {TOP}
"""


@query("op11_phrases", SQL)
def op11_phrases(spark, folder):
    return collocations(table(spark, folder, "documents"))
