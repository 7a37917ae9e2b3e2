"""Toxicity: a subsequence string kernel with Nystrom landmarks and a linear support vector machine over them."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemolake.llm.quality import remainder
from mnemolake.llm.registry import query, table
from mnemolake.session import materialize

SAMPLE = 20_000  # labelled documents that are learned from, at most
LANDMARKS, PLAIN = 192, 64  # words of toxic and of other sentences that span the kernel's space
OTHERS, HARD = 12_000, 4_000  # words of other sentences that the machine is fitted on
DECAY, SPAN = 0.75, 6  # a gap costs DECAY, and the four signs of a subsequence lie within SPAN
GAPS = [(a, b, c) for c in range(3, SPAN) for b in range(2, c) for a in range(1, b)]
CLASSES, FIRST, LAST = 64, 62, 63  # letters fall into classes; 0 is anything else, a word's ends have their own
SLOTS = 2**20  # subsequences are numbered by a hash
CACHE = 400_000
SENTENCES = re.compile(r"[.!?\n]+(?=\s|$)")
SPACED = re.compile(r"(?<!\S)\S(?:[^\S\n]+\S(?!\S)){2,}")


@cache
def letter_classes() -> np.ndarray:
    """The class of each code point of the basic plane; a-z have one each, other letters share some."""
    out = np.zeros(65536, np.int32)
    for code in range(65536):
        char = chr(code)
        if "a" <= char <= "z":
            out[code] = ord(char) - 96
        elif char.isalpha():
            out[code] = 27 + ord(char) * 2654435761 % 2**32 * 25 // 2**32
        elif char.isdigit():
            out[code] = 52 + unicodedata.digit(char, 0)
    out[ord("\n")] = -1
    return out


def letters(words: list[str]) -> np.ndarray:
    """Classes of the words' letters and digits between the marks of their ends, -1 after each; other signs fall away."""
    codes = np.frombuffer(("\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    out = letter_classes()[np.minimum(codes, 65535)]
    out = out[out != 0]
    end = np.flatnonzero(out == -1)
    marked = np.insert(out, np.concatenate([[0], end[:-1] + 1]), FIRST)
    return np.insert(marked, np.flatnonzero(marked == -1), LAST)


def occurrences(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pattern of gaps: the word and the numbered four signs of its occurrences, and their weight."""
    word = np.cumsum(codes == -1)
    for a, b, c in GAPS:
        n = len(codes) - c
        if n <= 0:
            return
        at = np.flatnonzero((word[:n] == word[c:]) & (codes[:n] > 0))
        number = ((codes[at] * CLASSES + codes[at + a]) * CLASSES + codes[at + b]) * CLASSES + codes[at + c]
        yield word[at], (number.astype(np.uint64) * np.uint64(2654435761) % np.uint64(2**32) >> np.uint64(12)).astype(np.int64), DECAY ** (c - 3)


def feature_matrix(words: list[str], names: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of normalised weights of subsequences, and the subsequences' numbers; products of rows are kernel values."""
    parts = list(occurrences(letters(words)))
    who = np.concatenate([w for w, _, _ in parts])
    what = np.concatenate([c for _, c, _ in parts])
    weight = np.concatenate([np.full(len(w), g) for w, _, g in parts])
    norm = np.sqrt(np.bincount(who, weight**2, len(words)))
    names = np.unique(what) if names is None else names
    place = np.minimum(np.searchsorted(names, what), len(names) - 1)
    own = names[place] == what
    out = np.zeros((len(words), len(names)), np.float32)
    np.add.at(out, (who[own], place[own]), weight[own])
    return out / np.maximum(norm, 1e-9)[:, None], names


@dataclass(frozen=True)
class Machine:
    """Weights of subsequences, to which kernel, landmarks and the machine's weights collapse, and the calibration."""

    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def decide(self, words: list[str]) -> np.ndarray:
        """The machine's value of each word: the sum of its subsequences' weights over its norm."""
        total, norm = np.zeros(len(words)), np.zeros(len(words))
        for who, what, weight in occurrences(letters(words)):
            total += np.bincount(who, self.weights[what], len(words)) * weight
            norm += np.bincount(who, minlength=len(words)) * weight**2
        return total / np.sqrt(np.maximum(norm, 1e-9)) + self.bias

    def score(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * values + self.shift, -40, 40)))


def words_of(text: str | None) -> list[str]:
    """Words of a whole text, in lower case; single letters that stand in a row are one more word."""
    low = (text or "").lower()
    return low.split() + [" ".join(m.split()).replace(" ", "\0") for m in SPACED.findall(low)]


def sentence_words(text: str | None) -> Iterator[set[str]]:
    for sentence in SENTENCES.split(text or ""):
        yield {w.strip(".,;:!?\"'()") for w in words_of(sentence)} - {""}


def fit_svm(x: np.ndarray, y: np.ndarray, margin: np.ndarray, weight: np.ndarray, penalty: float = 3.0) -> np.ndarray:
    """Primal squared-hinge machine by Newton steps: y (x w) should reach the row's margin. The last column of x is the bias
    and is not shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.ones(x.shape[1])
    shrink[-1] = 1e-6
    for _ in range(40):
        inside = y * (x @ w) < margin
        xs = x[inside] * weight[inside, None]
        grad = shrink * w + penalty * xs.T @ (x[inside] @ w - y[inside] * margin[inside])
        step = np.linalg.solve(np.diag(shrink) + penalty * xs.T @ x[inside], grad)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w


def fit_machine(landmarks: list[str], toxic: list[str], changed: list[str], other: list[str]) -> Machine:
    """Nystrom map over the landmarks' kernel, then the machine on words of toxic sentences (1), changed forms of them
    (1, with less weight) and words of other sentences (-1)."""
    base, names = feature_matrix(landmarks)
    values, vectors = np.linalg.eigh((base @ base.T).astype(float))
    live = values > 1e-2
    root = vectors[:, live] / np.sqrt(values[live])
    kernel = np.concatenate([feature_matrix(part, names)[0] @ base.T for part in in_parts(toxic + changed + other)]).astype(float)
    mapped = np.column_stack([kernel @ root, np.ones(len(kernel))])
    y = np.concatenate([np.ones(len(toxic) + len(changed)), -np.ones(len(other))])
    # A text's value is that of its worst word, so toxic words have to stand clear of the largest of very many others.
    strong = np.arange(len(y)) < len(toxic)
    w = fit_svm(mapped, y, np.where(strong, 1.5, 1.0), np.where(strong, 2.0, 1.0))
    table = np.zeros(SLOTS, np.float32)
    table[names] = base.T @ (root @ w[:-1])
    return Machine(table, float(w[-1]))


def variants(word: str) -> list[str]:
    """The word with one letter put in, or one said twice, at each inner place: what the machine has to recognise too."""
    inner = range(1, len(word))
    extra = "xqjkzvw"
    return [word[:i] + extra[(i + len(word)) % len(extra)] + word[i:] for i in inner] + [word[:i] + word[i - 1 :] for i in inner]


def in_parts(words: list[str], size: int = 2000) -> Iterator[list[str]]:
    for at in range(0, len(words), size):
        yield words[at : at + size]


COUNTS = T.StructType([T.StructField("word", T.StringType()), T.StructField("toxic", T.LongType()), T.StructField("other", T.LongType())])
_VALUE = T.StructType([T.StructField("value", T.DoubleType()), T.StructField("witness", T.StringType())])


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        seen = Counter()
        for text, y in zip(batch["text"], batch["y"]):
            for words in sentence_words(text):
                seen.update((w, int(y)) for w in words if len(w) <= 64)
        words = list({w for w, _ in seen})
        yield pd.DataFrame({"word": words, "toxic": [seen[w, 1] for w in words], "other": [seen[w, 0] for w in words]}, columns=COUNTS.names)


def value_udf(machine: Machine):
    """Each whole text's largest value of a word, over all its sentences, and that word; texts without words have the
    machine's bias and no word."""
    cached: dict[str, float] = {}

    @F.pandas_udf(_VALUE)
    def value(texts: pd.Series) -> pd.DataFrame:
        out = []
        held = texts.tolist()
        for at in range(0, len(held), 64):
            lists = [words_of(t) for t in held[at : at + 64]]
            if len(cached) > CACHE:
                cached.clear()
            new = list({w for words in lists for w in words if w not in cached})
            for part in in_parts(new, 20_000):
                cached.update(zip(part, machine.decide(part).tolist()))
            for words in lists:
                best = max(words, key=cached.__getitem__, default=None)
                out.append((cached[best] if best is not None else machine.bias, best))
        return pd.DataFrame(out, columns=_VALUE.names)

    return value


def training_rows(documents: DataFrame, labels: DataFrame, column: str, held_out, rows: int) -> DataFrame:
    """(doc_id, text, y) of at most `rows` labelled documents, those of smallest hash; the rest is not looked at."""
    known = labels.filter(F.col(column).isin(0, 1)).select("doc_id", F.col(column).alias("y")).filter(~held_out)
    some = known.orderBy(F.xxhash64("doc_id"), "y").limit(rows)  # at most `rows` pairs of numbers are broadcast
    found = documents.select("doc_id", "text").join(F.broadcast(some), "doc_id").withColumn("same", F.xxhash64("text", "y"))
    return materialize(found.dropDuplicates(["same"]), "sample")  # a copied text teaches nothing more


def train(documents: DataFrame, labels: DataFrame, column: str = "toxic", rows: int = SAMPLE) -> Machine | None:
    """Learn from labelled sentences: each sentence has its document's label, rows with crc32(doc_id) mod 5 = 0 are left out.

    Words (up to 64 characters here, any length when scored) are counted by the sentences of either label that hold them. Landmarks are the words with the largest likelihood
    ratio towards toxic sentences, with some frequent others; the machine is fitted on such words and bounded samples of the
    others, a second time with those others that it ranked highest. None without words that tell toxic sentences apart.
    """
    sample = training_rows(documents, labels, column, remainder(F.col("doc_id"), 5) == 0, rows)
    counts = sample.select("text", "y").mapInPandas(_count, COUNTS)
    counts = materialize(counts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")), "words")
    whole = counts.agg(F.sum("toxic"), F.sum("other")).first()
    if not whole[0] or not whole[1]:
        return None
    base = whole[0] / (whole[0] + whole[1])
    n, rate = F.col("toxic") + F.col("other"), F.col("toxic") / (F.col("toxic") + F.col("other"))
    log = lambda k, p: F.when(k > 0, k * F.log(p)).otherwise(0.0)
    ratio = log(F.col("toxic"), rate / base) + log(F.col("other"), (1 - rate) / (1 - base))
    ranked = counts.withColumn("gain", F.when(rate > base, ratio).otherwise(-ratio)).withColumn("rate", rate)
    telling = ranked.filter("gain > 8 AND rate > 0.9").orderBy(F.desc("gain"), "word").limit(10 * LANDMARKS)
    toxic = [r["word"] for r in telling.collect()]
    if not toxic:
        return None
    harmless = ranked.filter("other > 0 AND gain < 2")
    common = [r["word"] for r in harmless.orderBy(F.desc("other"), "word").limit(PLAIN).collect()]
    some = [r["word"] for r in harmless.orderBy(F.xxhash64("word")).limit(OTHERS).collect()]
    landmarks = toxic[:LANDMARKS] + common
    known = set(some + common)
    changed = [v for w in toxic[:LANDMARKS] if len(w) > 3 for v in variants(w) if v not in known]
    machine = fit_machine(landmarks, toxic, changed, some + common)
    near: list[str] = []
    for _ in range(2):  # the others that the machine ranks highest, which it has to be fitted on too
        value = value_udf(machine)
        hard = harmless.withColumn("v", value("word")["value"]).orderBy(F.desc("v"), "word").limit(HARD).collect()
        near = list(dict.fromkeys(near + [r["word"] for r in hard]))
        machine = fit_machine(landmarks + near[:PLAIN], toxic, changed, some + common + near)
    pairs = sample.select(value_udf(machine)(F.col("text"))["value"].alias("v"), "y").collect()  # at most `rows` pairs of numbers
    return _calibrate(machine, np.array([r["v"] for r in pairs]), np.array([r["y"] for r in pairs], float))


def _calibrate(machine: Machine, v: np.ndarray, y: np.ndarray) -> Machine:
    """Scale and shift by logistic regression of the label on the value, with a slight pull to moderate slopes."""
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * v + b, -40, 40)))
        w = p * (1 - p) + 1e-9
        g = np.array([((y - p) * v).sum() - 0.1 * (a - 1), (y - p).sum()])
        h = np.array([[(w * v * v).sum() + 0.1, (w * v).sum()], [(w * v).sum(), w.sum()]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return Machine(machine.weights, machine.bias, float(a), float(b)) if a > 0 else machine


def score_documents(documents: DataFrame, machine: Machine | None) -> DataFrame:
    """doc_id, score and witness (the word that decided) of every row. Null and empty texts get the score of no word; without
    a machine all scores are 0. Repeated rows are scored each; other columns are not read."""
    if machine is None:
        return documents.select("doc_id", F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("witness"))

    @F.pandas_udf(T.DoubleType())
    def probability(values: pd.Series) -> pd.Series:
        return pd.Series(machine.score(values.to_numpy(float)))

    found = documents.select("doc_id", value_udf(machine)(F.col("text")).alias("v"))
    return found.select("doc_id", probability(F.col("v.value")).alias("score"), F.col("v.witness").alias("witness"))


@query("op1_toxicity")
def op1_toxicity(spark, folder):
    documents = table(spark, folder, "documents")
    machine = train(documents, table(spark, folder, "labels"))
    scored = score_documents(documents, machine)
    return scored.select(
        "doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "witness"
    )
