"""Embedding near-dedup by product quantisation: inverted lists, residual codes, table distances, exact cosine rerank."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemolake.llm.components import connected_components
from mnemolake.llm.registry import query, table
from mnemolake.llm.vectors import in_blocks, matrix, sample, usable, width_of
from mnemolake.session import materialize

COSINE = 0.98
SAMPLE = 20_000  # vectors that the index is fitted on, at most; all vectors are indexed
SPACES, WORDS = 8, 64
BLOCK = 2048
MARGIN = 1e-9
_L = T.LongType()
CODED = T.StructType([
    T.StructField("label", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("form", _L),
    T.StructField("n", _L), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("list", T.IntegerType()),
    T.StructField("codes", T.BinaryType()), T.StructField("error", T.DoubleType()), T.StructField("probes", T.ArrayType(T.IntegerType())),
])
LINKED = T.StructType([T.StructField("form", _L), T.StructField("links", _L), T.StructField("root", _L)])


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None, :] - 2 * x @ y.T, 0)


def centres(points: np.ndarray, count: int, rounds: int = 12) -> np.ndarray:
    """k-means from evenly spaced rows; the same points give the same centres. Empty ones stay where they were."""
    out = points[np.linspace(0, len(points) - 1, min(count, len(points))).astype(int)].copy()
    for _ in range(rounds):
        near = squares(points, out).argmin(axis=1)
        total = np.zeros_like(out)
        np.add.at(total, near, points)
        size = np.bincount(near, minlength=len(out))
        out[size > 0] = total[size > 0] / size[size > 0, None]
    return out


@dataclass(frozen=True)
class Index:
    """Coarse centres and, for each subspace, code words of the residuals. `reach`: the distance of linked unit vectors."""

    coarse: np.ndarray
    words: list[np.ndarray]
    reach: float

    def spaces(self, x: np.ndarray) -> list[np.ndarray]:
        return np.array_split(x, len(self.words), axis=1)

    def encode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and length of what the codes leave out, for each vector."""
        lists = squares(units, self.coarse).argmin(axis=1)
        rest = units - self.coarse[lists]
        codes = np.stack([squares(p, w).argmin(axis=1) for p, w in zip(self.spaces(rest), self.words)], axis=1).astype(np.uint8)
        known = np.concatenate([w[codes[:, m]] for m, w in enumerate(self.words)], axis=1)
        return lists, codes, np.sqrt(((rest - known) ** 2).sum(axis=1))

    def probes(self, units: np.ndarray, lists: np.ndarray) -> list[np.ndarray]:
        """Every list that can hold a vector within reach: the plane between two centres is no farther than that."""
        away = squares(units, self.coarse)
        own = away[np.arange(len(units)), lists]
        between = np.sqrt(squares(self.coarse, self.coarse))[lists]
        return [np.flatnonzero(row) for row in away - own[:, None] <= 2 * self.reach * between + MARGIN]

    def table_distances(self, units: np.ndarray, centre: int, codes: np.ndarray) -> np.ndarray:
        """Distances of whole vectors to coded ones of one list, from one table of subspace distances a vector."""
        total = np.zeros((len(units), len(codes)))
        for m, (part, words) in enumerate(zip(self.spaces(units - self.coarse[centre]), self.words)):
            total += squares(part, words)[:, codes[:, m]]
        return np.sqrt(total)


def fit_index(forms: DataFrame, cosine: float, rows: int) -> Index:
    """The number of lists follows the square root of the number of rows; centres and code words fit a bounded sample."""
    some = unit(sample(forms, rows))
    coarse = centres(some, min(1024, max(8, math.isqrt(forms.count()) // 4)))
    rest = some - coarse[squares(some, coarse).argmin(axis=1)]
    words = [centres(p, WORDS) for p in np.array_split(rest, min(SPACES, rest.shape[1]), axis=1)]
    return Index(coarse, words, math.sqrt(max(0.0, 2 - 2 * cosine)) + MARGIN)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x**2).sum(axis=1))[:, None]


def linked_pairs(index: Index, x: np.ndarray, centre: int, codes: np.ndarray, errors: np.ndarray, y: np.ndarray, cosine: float):
    """(row of x, row of y) with a cosine of at least `cosine`. A table distance that exceeds the reach by more than the
    coded vector's error rules a pair out for sure; the others are compared exactly."""
    left, right = [], []
    ux, uy = unit(x), unit(y)
    nx, ny = np.sqrt((x**2).sum(axis=1)), np.sqrt((y**2).sum(axis=1))
    for at in range(0, len(x), 256):
        may = index.table_distances(ux[at : at + 256], centre, codes) <= index.reach + errors[None, :] + 1e-7
        a, b = np.nonzero(may)
        a = a + at
        for part in range(0, len(a), 50_000):
            i, j = a[part : part + 50_000], b[part : part + 50_000]
            hit = np.einsum("ij,ij->i", x[i], y[j]) / (nx[i] * ny[j]) >= cosine
            left.append(i[hit])
            right.append(j[hit])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that links (a, b) reach from each of n rows."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            return label


def near_vectors(embeddings: DataFrame, cosine: float = COSINE, rows: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row: links join vectors of one label, and of one length, whose cosine
    is at least `cosine` (above 0).

    Null vectors, zero vectors, those with null or non-finite components, and rows without a label link with nothing: no
    links, a component of their own, kept. Equal vectors of one label are one form that counts for all of them, so copies
    cost one row. Lists are probed as far as a link can reach and codes only rule out what cannot link, so no link is lost.
    """
    vector = F.col("embedding")
    live = usable(vector) & F.col("label").isNotNull() & F.exists(vector, lambda x: x != 0)
    plain = embeddings.select("vec_id", F.col("label").cast("int").alias("label"), vector.cast("array<float>").alias("embedding"))
    marked = plain.withColumn("form", F.when(live, F.xxhash64("label", "embedding")))
    alive = marked.filter("form IS NOT NULL")
    forms = alive.groupBy("form", "label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    forms = materialize(forms.withColumn("size", F.size("embedding")), "forms")
    if forms.isEmpty():
        return embeddings.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    width, index = width_of(forms), fit_index(forms, cosine, rows)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.iloc[at : at + 2048]
                units = unit(matrix(part["embedding"], width))
                lists, codes, errors = index.encode(units)
                yield part[["label", "size", "form", "n", "embedding"]].assign(
                    list=lists, codes=[c.tobytes() for c in codes], error=errors, probes=index.probes(units, lists)
                )

    coded = materialize(forms.select("label", "size", "form", "n", "embedding").mapInPandas(encode, CODED), "codes")
    # A pair across two lists is found from the lower one and counts for both sides.
    upward = F.filter("probes", lambda p: p >= F.col("list"))
    asking = coded.select("label", "size", "form", "n", "embedding", F.col("list").alias("own"), F.explode(upward).alias("list"))
    keys = ["label", "size", "list"]
    held = coded.select(*[F.col(c).alias(c) for c in coded.columns if c != "probes"])  # columns of its own, beside `asking`
    left, right = in_blocks(asking, held, keys, BLOCK, BLOCK, "form", "form")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=LINKED.names)
        x, y = matrix(left["embedding"], width), matrix(right["embedding"], width)
        codes = np.frombuffer(b"".join(right["codes"]), np.uint8).reshape(len(right), -1)
        mine, theirs = left["form"].to_numpy(np.int64), right["form"].to_numpy(np.int64)
        a, b = linked_pairs(index, x, int(right["list"].iloc[0]), codes, right["error"].to_numpy(), y, cosine)
        other = mine[a] != theirs[b]
        a, b = a[other], b[other]
        across = left["own"].to_numpy()[a] != right["list"].iloc[0]
        links = np.bincount(a, right["n"].to_numpy(float)[b], len(left)).astype(np.int64)
        back = np.bincount(b[across], left["n"].to_numpy(float)[a[across]], len(right)).astype(np.int64)
        names = np.concatenate([mine, theirs])
        root = names[roots(len(names), a, b + len(left))]
        links = np.concatenate([links, back])
        hit = (root != names) | (links > 0)
        return pd.DataFrame({"form": names[hit], "links": links[hit], "root": root[hit]})

    group = [*keys, "l", "r"]
    found = materialize(left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(meet, LINKED), "links")
    links = found.groupBy("form").agg(F.sum("links").alias("links"))
    reached = connected_components(found.select(F.col("form").alias("a"), F.col("root").alias("b")))
    classed = forms.select("form", "n", "least").join(links, "form", "left").join(reached.withColumnRenamed("node", "form"), "form", "left")
    classed = classed.withColumn("root", F.coalesce("root", "form"))
    least = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    known = materialize(classed.join(least, "root").select("form", F.coalesce("links", F.lit(0)).alias("links"), "n", "component_id"), "forms")
    alive = marked.select("vec_id", "form").join(known, "form", "left")
    number = F.coalesce(F.col("links") + F.col("n") - 1, F.lit(0)).cast("long")
    component = F.when(F.col("form").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return alive.select("vec_id", number.alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


SQL = f"""
WITH RECURSIVE valid AS (
  SELECT row_number() OVER () AS r, vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0
), normed AS (SELECT r, vec_id, label, v, sqrt(list_inner_product(v, v)) AS n FROM valid
), links AS (
  SELECT a.r, a.vec_id, b.vec_id AS other FROM normed a JOIN normed b
    ON a.label = b.label AND len(a.v) = len(b.v) AND a.r <> b.r AND list_inner_product(a.v, b.v) / (a.n * b.n) >= {COSINE}
), reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION
  SELECT reach.vec_id, links.other FROM reach JOIN links ON reach.other = links.vec_id
), least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
), number AS (SELECT vec_id, count(*) AS n FROM links GROUP BY vec_id)
SELECT e.vec_id, coalesce(number.n, 0) AS n_links, least.component_id, e.vec_id = least.component_id AS kept
FROM embeddings e JOIN least USING (vec_id) LEFT JOIN number USING (vec_id)
"""


@query("op6_quantised", SQL)
def op6_quantised(spark, folder):
    return near_vectors(table(spark, folder, "embeddings"))
