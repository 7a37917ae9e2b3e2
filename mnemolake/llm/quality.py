"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemolake.llm.registry import query, table
from mnemolake.session import materialize

KINDS = 7  # lower or uncased letter, upper, digit, space, line end, plain punctuation, other sign
PLAIN = set(".,;:!?'\"()-–—’“”«»¿¡")
SENTENCE_END = re.compile(r"[.!?\n]+")
STATISTICS = (
    "words", "mean_length", "spread_length", "upper", "digits", "signs", "punctuation", "line_ends", "richness",
    "new_sentences", "sentence_length", "top_word", "short_words", "long_words", "wordless", "packed",
)


@cache
def _kinds() -> np.ndarray:
    """The kind of each code point of the basic plane."""
    out = np.zeros(65536, np.uint8)
    for code in range(65536):
        char, category = chr(code), unicodedata.category(chr(code))
        if char == "\n":
            out[code] = 4
        elif char.isspace():
            out[code] = 3
        elif category[0] in "LM":
            out[code] = 1 if category in ("Lu", "Lt") else 0
        elif category[0] == "N":
            out[code] = 2
        else:
            out[code] = 5 if char in PLAIN else 6
    return out


def _share(part: float, whole: float, prior: float) -> float:
    """A share on a logarithmic scale, drawn towards 2% by `prior` more items, so that short texts are not extreme."""
    return float(np.log((part + 0.02 * prior) / (whole + prior)))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text; null counts as empty, and an empty text has finite values too."""
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.bincount(_kinds()[np.minimum(codes, 65535)], minlength=KINDS).astype(float)
    chars = max(len(text), 1)
    letters = max(kind[0] + kind[1], 1.0)
    words = text.split()
    n = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    bare = Counter(w.strip(".,;:!?").lower() for w in words)
    sentences = [s for s in map(str.strip, SENTENCE_END.split(text)) if s]
    packed = len(zlib.compress(text.encode("utf-8", "surrogatepass"), 1)) if text else 0
    return [
        float(np.log1p(len(words))),
        float(np.log1p(lengths.mean())),
        float(np.log1p(lengths.std())),
        _share(kind[1], letters, 100),
        _share(kind[2], chars, 100),
        _share(kind[6], chars, 100),
        _share(kind[5], chars, 100),
        _share(kind[4], chars, 100),
        float(np.log1p(len(bare)) / np.log1p(n)),
        _share(len(sentences) - len(set(sentences)), len(sentences), 8),
        float(np.log1p(n / max(len(sentences), 1))),
        _share(max(bare.values(), default=0), n, 20),
        float(((lengths <= 3).sum() + 4) / (len(lengths) + 10)),
        _share((lengths >= 14).sum(), n, 20),
        _share(sum(1 for w in bare if not any(map(str.isalpha, w))), n, 20),
        float(packed / (chars + 30)),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def statistics_of(texts: pd.Series) -> pd.Series:
    return pd.Series([statistics(t) for t in texts])


@dataclass(frozen=True)
class Discriminant:
    """Class means, the inverse Cholesky factors of the shrunk covariances and the constants of the log densities."""

    means: np.ndarray
    whiten: np.ndarray
    constants: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def ratio(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, from squared Mahalanobis distances."""
        logs = [c - 0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) for m, w, c in zip(self.means, self.whiten, self.constants)]
        return logs[1] - logs[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.scale * self.ratio(x) + self.shift, -40, 40)
        return 1 / (1 + np.exp(-z))


def _discriminant(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float, ridge: float) -> Discriminant:
    d = len(STATISTICS)
    total = sum(n for n, _, _ in sums.values())
    own, means, constants, whiten = {}, [], [], []
    for label in (0, 1):
        n, first, second = sums[label]
        mean = first / n
        own[label] = second / n - np.outer(mean, mean)
        means.append(mean)
    pooled = sum(sums[k][0] / total * own[k] for k in own)
    for label in (0, 1):
        cov = (1 - shrink) * own[label] + shrink * pooled
        cov = (1 - ridge) * cov + ridge * np.diag(np.maximum(np.diag(pooled), 1e-6))
        factor = np.linalg.cholesky(cov)
        whiten.append(np.linalg.inv(factor))
        constants.append(np.log(sums[label][0] / total) - np.log(np.diag(factor)).sum())
    assert len(means[0]) == d
    return Discriminant(np.array(means), np.array(whiten), np.array(constants))


def ratio_udf(model: Discriminant):
    @F.pandas_udf(T.DoubleType())
    def ratio(stats: pd.Series) -> pd.Series:
        return pd.Series(model.ratio(np.array(stats.tolist(), float)) if len(stats) else np.zeros(0))

    return ratio


def _calibrate(model: Discriminant, r: np.ndarray, y: np.ndarray) -> Discriminant:
    """Scale and shift of the log ratio by logistic regression, as statistics are not quite normal."""
    r = np.clip(r, -60, 60)
    a, b = 0.2, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * r + b, -40, 40)))
        w = p * (1 - p) + 1e-9
        g = np.array([((y - p) * r).sum() - 1e-3 * a, (y - p).sum()])
        h = np.array([[(w * r * r).sum() + 1e-3, (w * r).sum()], [(w * r).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    if a <= 0:
        return model
    return Discriminant(model.means, model.whiten, model.constants, float(a), float(b))


def fit(
    known: DataFrame, shrink: float = 0.1, ridge: float = 0.01, calibration_rows: int = 20_000
) -> Discriminant | None:
    """`known`: x (array of statistics), y (0 or 1). Means and covariances come from all of its rows, as sums on Spark;
    only the two numbers of the calibration use a bounded sample, the `calibration_rows` rows of smallest hash.
    None if a class has no row."""
    d = len(STATISTICS)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    wide = known.select("y", *[F.col("x")[i].alias(f"x{i}") for i in range(d)])
    aggs = [F.count("*").alias("n")] + [F.sum(f"x{i}").alias(f"s{i}") for i in range(d)]
    aggs += [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in pairs]
    sums = {}
    for row in wide.groupBy("y").agg(*aggs).collect():  # two rows
        second = np.zeros((d, d))
        for i, j in pairs:
            second[i, j] = second[j, i] = row[f"p{i}_{j}"]
        sums[row["y"]] = (row["n"], np.array([row[f"s{i}"] for i in range(d)]), second)
    if set(sums) != {0, 1}:
        return None
    model = _discriminant(sums, shrink, ridge)
    some = known.orderBy(F.xxhash64("x"), "y").limit(calibration_rows).select(ratio_udf(model)(F.col("x")).alias("r"), "y")
    pairs = np.array([(row["r"], row["y"]) for row in some.collect()])
    return _calibrate(model, pairs[:, 0], pairs[:, 1])


def remainder(doc_id: Column, base: int) -> Column:
    """crc32 of doc_id as text, modulo `base`; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % base


def labelled(stats: DataFrame, labels: DataFrame, column: str, held_out: Column) -> DataFrame:
    """(doc_id, x) with the labels 0 and 1 that may be learned from; null labels are left out."""
    known = labels.filter(F.col(column).isin(0, 1)).select("doc_id", F.col(column).alias("y"))
    return stats.filter(~held_out).join(known, "doc_id").select("x", "y")


def score_udf(model: Discriminant | None):
    """A column of scores from a column of statistics; one half where nothing could be learned."""

    @F.pandas_udf(T.DoubleType())
    def score(stats: pd.Series) -> pd.Series:
        if model is None or not len(stats):
            return pd.Series(np.full(len(stats), 0.5))
        return pd.Series(model.score(np.array(stats.tolist(), float)))

    return score


def train(documents: DataFrame, labels: DataFrame, column: str = "quality") -> tuple[Discriminant | None, DataFrame]:
    """The fitted discriminant and the written table (doc_id, x) of all documents' statistics.

    Statistics read the whole text and nothing else; rows whose crc32(doc_id) mod 4 is 2 are never learned from. A null
    text counts as empty, a null doc_id never meets a label, repeated rows are scored each, other columns are not read.
    """
    stats = materialize(documents.select("doc_id", statistics_of(F.col("text")).alias("x")), "statistics")
    return fit(labelled(stats, labels, column, remainder(F.col("doc_id"), 4) == 2)), stats


@query("op9_quality")
def op9_quality(spark, folder):
    model, stats = train(table(spark, folder, "documents"), table(spark, folder, "labels"))
    scored = stats.select(
        "doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), score_udf(model)(F.col("x")).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents that score at least `threshold`; columns and rows that stay are as they were. Without labels of both
    classes nothing can be told apart, so all stay."""
    model, _ = train(documents, labels)
    if model is None:
        return documents
    return documents.filter(score_udf(model)(statistics_of(F.col("text"))) >= threshold)
