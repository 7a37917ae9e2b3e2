"""Exact top-k by inner product: a table of distances to pivots bounds every score, candidates come in order of bound."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mnemolake.llm.registry import query, table
from mnemolake.llm.vectors import in_blocks, matrix, sample, usable, width_of
from mnemolake.session import materialize

K, SCALE = 5, 256
PIVOTS, SAMPLE = 48, 4096
CANDIDATES, QUERIES = 8192, 1024  # rows of a block of candidates and of queries
EXACT = 2**20  # components up to this size keep products exact in doubles
HITS = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


def whole_numbers(vectors: pd.Series, width: int) -> np.ndarray:
    """floor(SCALE * x) for every component, as doubles that hold whole numbers."""
    return np.floor(SCALE * matrix(vectors, width))


def pick_pivots(points: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Far points one after the other, from the first one on; fewer if the points are fewer."""
    if not len(points):
        return points
    chosen, away = [0], ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(points)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (points**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * points @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def products(query_row: np.ndarray, rows: np.ndarray) -> list[int] | np.ndarray:
    """Exact inner products of whole numbers; in Python integers where doubles could round. They must fit a long."""
    if max(np.abs(query_row).max(initial=0), np.abs(rows).max(initial=0)) <= EXACT:
        return (rows @ query_row).astype(np.int64)
    exact = [int(x) for x in query_row]
    return np.array([sum(a * int(b) for a, b in zip(exact, row)) for row in rows], np.int64)


def upper_bounds(queries: np.ndarray, rows: np.ndarray, to_queries: np.ndarray, to_rows: np.ndarray) -> np.ndarray:
    """No score is above it: <q, x> = (|q|^2 + |x|^2 - d(q, x)^2) / 2, and d is at least the largest difference of the
    distances to any pivot. A part in 10^9 of the squares is added for rounding."""
    least = np.zeros((len(queries), len(rows)))
    for p in range(to_rows.shape[1]):
        np.maximum(least, np.abs(to_queries[:, p, None] - to_rows[None, :, p]), out=least)
    squares = (queries**2).sum(axis=1)[:, None] + (rows**2).sum(axis=1)[None, :]
    return (squares * (1 + 2e-9) - least**2) / 2 + 1e-6


def search(
    ids: np.ndarray, queries: np.ndarray, to_queries: np.ndarray, floors: np.ndarray, row_ids: np.ndarray, rows: np.ndarray,
    to_rows: np.ndarray, k: int,
) -> list[tuple[int, int, int]]:
    """Best k rows of each query with scores of at least its floor; evaluated by bound until no bound reaches the k-th."""
    out = []
    bounds = upper_bounds(queries, rows, to_queries, to_rows)
    for q in range(len(ids)):
        order = np.flatnonzero((bounds[q] >= floors[q]) & (row_ids != ids[q]))
        order = order[np.argsort(-bounds[q][order], kind="stable")]
        best = np.empty((0, 2), np.int64)  # (-score, vec_id), sorted
        at, step = 0, 32
        while at < len(order) and (len(best) < k or bounds[q][order[at]] >= -best[-1, 0]):
            now = order[at : at + step]
            scores = products(queries[q], rows[now])
            best = np.concatenate([best, np.stack([-np.asarray(scores), row_ids[now]], axis=1)])
            best = best[np.lexsort((best[:, 1], best[:, 0]))][:k]
            at, step = at + step, min(2 * step, 1024)
        out += [(int(ids[q]), int(v), int(-s)) for s, v in best if -s >= floors[q]]
    return out


def top_k(embeddings: DataFrame, is_query, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows for which the column `is_query` holds, against all rows of another
    vec_id; ties go to the smaller vec_id. Vectors of different length are not compared.

    Null vectors, and those with null or non-finite components, take no part, nor do rows without a vec_id; repeated rows
    each count as candidates, and as one query. An empty table gives no rows; other columns are not read.
    """
    rows = embeddings.select("vec_id", "embedding").filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = rows.withColumn("size", F.size("embedding"))
    width = width_of(rows)
    some = np.floor(SCALE * sample(rows, SAMPLE))
    pivots = pick_pivots(some)
    probe = rows.orderBy(F.xxhash64("embedding", "vec_id")).limit(SAMPLE).toPandas()  # bounded: SAMPLE rows
    probe_ids, probe_sizes = probe["vec_id"].to_numpy(np.int64), probe["size"].to_numpy(np.int64)
    probe_rows = whole_numbers(probe["embedding"], width)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def to_pivots(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(distances(whole_numbers(vectors, width), pivots)))

    @F.pandas_udf(T.DoubleType())
    def floor_of(ids: pd.Series, sizes: pd.Series, vectors: pd.Series) -> pd.Series:
        """The k-th best score within the sample: a row below it is not among the best k of all."""
        out = np.full(len(ids), -np.inf)
        points = whole_numbers(vectors, width)
        for i, (own, size) in enumerate(zip(ids.to_numpy(), sizes.to_numpy())):
            mine = probe_rows[(probe_ids != own) & (probe_sizes == size)]
            if len(mine) >= k:
                out[i] = np.partition(products(points[i], mine), len(mine) - k)[len(mine) - k]
        return pd.Series(out)

    candidates = materialize(rows.withColumn("pivots", to_pivots("embedding")), "pivots")
    queries = candidates.filter(is_query).dropDuplicates(["vec_id", "embedding"])
    queries = materialize(queries.withColumn("floor", floor_of("vec_id", "size", "embedding")), "queries")
    left, right = in_blocks(queries, candidates, ["size"], QUERIES, CANDIDATES, "vec_id", "vec_id")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=HITS.names)
        hits = []
        mine, theirs = whole_numbers(left["embedding"], width), whole_numbers(right["embedding"], width)
        to_mine, to_theirs = matrix(left["pivots"], len(pivots)), matrix(right["pivots"], len(pivots))
        ids, floors = left["vec_id"].to_numpy(np.int64), left["floor"].to_numpy(float)
        for at in range(0, len(left), 128):
            now = slice(at, at + 128)
            hits += search(ids[now], mine[now], to_mine[now], floors[now], right["vec_id"].to_numpy(np.int64), theirs, to_theirs, k)
        return pd.DataFrame(hits, columns=HITS.names)

    group = ["size", "l", "r"]
    hits = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(meet, HITS)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


# Written with list_inner_product, as products of whole numbers of this size are exact in doubles.
SQL = f"""
WITH valid AS (
  SELECT vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM valid q JOIN valid c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= {K}
"""


@query("op3_topk", SQL)
def op3_topk(spark, folder):
    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)
