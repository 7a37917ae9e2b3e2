"""Recall channels: text (BM25), vector (exact and approximate), entity and graph.

Every channel returns query_id, scope, channel, memory_id, score and rank from 0.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.functions.core import significant, unnest
from mnemolake.functions.text import term_counts, tokens
from mnemolake.operators.blocks import blocked
from mnemolake.operators.graph import MEMORY_PREFIX, entity_node_id, graph_traverse
from mnemolake.operators.store import HELD, WANT, held_columns
from mnemolake.schemas import QUERY, SCOPE
from mnemolake.session import materialize, sized


def ranked(hits: DataFrame, channel: str, k: int) -> DataFrame:
    """Top k per query and scope: score down, then id; the score itself stays untouched. Spark cuts before its shuffle."""
    order = Window.partitionBy(*QUERY).orderBy(significant(F.col("score")).desc(), "memory_id")
    return (
        hits.withColumn("rank", F.row_number().over(order) - 1)
        .filter(F.col("rank") < k)
        .select("query_id", *SCOPE, F.lit(channel).alias("channel"), "memory_id", "score", "rank")
    )


# --- text ---------------------------------------------------------------------------------------------------------


def text_index(cells: DataFrame, text: str = "text", filters: Sequence[str] = ()) -> DataFrame:
    """scope, mem_cell_id, terms array<struct<term, tf, dl>>: one row per cell, counted inside the row, no shuffle. Columns
    that requests filter by stay beside the terms, so that no join is needed to test them."""
    return cells.select(*SCOPE, "mem_cell_id", *held_columns(filters), term_counts(F.col(text)).alias("terms"))


def postings_of(index: DataFrame) -> DataFrame:
    own = [c for c in index.columns if c != "terms"]
    return unnest(index, own, F.col("terms"), "_i", "_t").select(*own, "_t.*")


def stats_of(index: DataFrame) -> DataFrame:
    """Documents, terms and average length of the whole index (not per tenant)."""
    length = F.coalesce(F.get("terms", F.lit(0))["dl"], F.lit(0))
    return index.agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(length).alias("n_terms"), F.avg(length).alias("avg_len")
    )


def bm25_postings(cells: DataFrame, text: str = "text") -> DataFrame:
    """scope, mem_cell_id, term, tf, dl."""
    return postings_of(text_index(cells, text))


def corpus_stats(cells: DataFrame, text: str = "text") -> DataFrame:
    n_terms = F.size(tokens(F.col(text)))
    return cells.agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(n_terms).alias("n_terms"), F.avg(n_terms).alias("avg_len")
    )


def doc_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bm25_topk(
    queries: DataFrame, postings: DataFrame, stats: DataFrame, k: int, k1: float = 1.2, b: float = 0.75,
    filters: Sequence[str] = (),
) -> DataFrame:
    """OR-match of the query terms inside the query's scope; a repeated query term counts as often as it occurs.

    `filters`: names as `request_filters` gives them, with their columns in queries and postings. They are tested where a
    posting meets its query, before sums are shuffled and cut; document frequencies stay those of the whole index.
    """
    own = ["query_id", *SCOPE, *(WANT + c for c in filters)]
    rows = unnest(queries, own, term_counts(F.col("query")), "_i", "_t")
    asked = rows.select(*own, F.col("_t.term"), F.col("_t.tf").alias("qtf"))
    terms = sized(asked.select("term").distinct())
    df = doc_frequency(postings.join(terms, "term", "left_semi"))
    corpus = stats.select(F.struct("n_docs", "avg_len")).scalar()
    rare = F.log1p((corpus["n_docs"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # With a small query side the postings are scored where they lie; only (query, cell) sums are shuffled.
    weighted = sized(asked.join(df, "term").withColumn("idf", rare).drop("df"))
    saturation = F.col("tf") + k1 * (1 - b + b * F.col("dl") / corpus["avg_len"])
    part = F.col("qtf") * F.col("idf") * F.col("tf") / saturation
    met = postings.join(weighted, [*SCOPE, "term"])
    for c in filters:
        met = met.filter(F.col(WANT + c).isNull() | (F.col(WANT + c) == F.col(HELD + c)))
    hits = (
        met
        .groupBy("query_id", *SCOPE, F.col("mem_cell_id").alias("memory_id"))
        .agg(F.sum(part).alias("score"))
    )
    return ranked(hits, "bm25", k)


# --- vector -------------------------------------------------------------------------------------------------------

HIT = "query_id string, tenant_id string, user_id string, memory_id string, score double"


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack([np.asarray(v, dtype="float64") for v in column])


def _similarity(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    inner = a @ b.T
    if metric == "IP":
        return inner
    if metric == "L2":
        square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * inner
        return -np.sqrt(np.maximum(square, 0.0))
    length = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
    return np.divide(inner, length, out=np.zeros_like(inner), where=length > 0)


def _significant(scores: np.ndarray, digits: int = 12) -> np.ndarray:
    size = np.floor(np.log10(np.abs(scores), out=np.zeros_like(scores), where=scores != 0))
    return np.sign(scores) * np.round(np.abs(scores) * 10.0 ** (digits - 1 - size)) * 10.0 ** (size - digits + 1)


def _allowed(queries: pd.DataFrame, cells: pd.DataFrame, filters: Sequence[str]) -> np.ndarray:
    """Which cells (columns) pass the filters of which queries (rows)."""
    out = np.ones((len(queries), len(cells)), bool)
    for c in filters:
        codes, _ = pd.factorize(pd.concat([queries[WANT + c], cells[HELD + c]], ignore_index=True))  # a null is -1
        want, held = codes[: len(queries), None], codes[None, len(queries) :]
        out &= (want < 0) | (want == held)
    return out


def _best_vectors(k: int, metric: str, filters: Sequence[str] = ()):
    def best(queries: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(cells):
            ids = cells["mem_cell_id"].to_numpy()
            sizes = cells["embedding"].map(len).to_numpy()
            wide = queries["query_vec"].map(lambda v: 0 if v is None else len(v)).to_numpy()
            scores = np.zeros((len(queries), len(cells)))
            for size in set(wide[wide > 0]) & set(sizes):
                rows, cols = np.flatnonzero(wide == size), np.flatnonzero(sizes == size)
                scores[np.ix_(rows, cols)] = _similarity(
                    _matrix(queries["query_vec"].iloc[rows]), _matrix(cells["embedding"].iloc[cols]), metric
                )
            by_id, allowed = np.argsort(ids), _allowed(queries, cells, filters)
            for i, row in enumerate(queries[["query_id", *SCOPE]].itertuples()):
                open_ = by_id[allowed[i, by_id]]
                order = open_[np.argsort(-_significant(scores[i, open_]), kind="stable")][:k]
                out.extend((row.query_id, row.tenant_id, row.user_id, ids[j], scores[i, j]) for j in order)
        return pd.DataFrame(out, columns=["query_id", "tenant_id", "user_id", "memory_id", "score"])

    return best


def vector_topk(
    queries: DataFrame, cells: DataFrame, k: int, metric: str = "COSINE", block: int = 4096, filters: Sequence[str] = (),
) -> DataFrame:
    """Exact top k inside the scope, by blocks; unequal or zero vectors score 0, cells without a vector are absent.

    `filters`: names as `request_filters` gives them; a block leaves out what a query excludes before it takes the best.
    """
    asked = queries.filter(F.size("query_vec") > 0).select("query_id", *SCOPE, "query_vec", *(WANT + c for c in filters))
    stored = cells.filter(F.size("embedding") > 0).select(*SCOPE, "mem_cell_id", "embedding", *held_columns(filters))
    local = blocked(asked, stored, SCOPE, "query_id", "mem_cell_id", _best_vectors(k, metric, filters), HIT, block)
    return ranked(local, "vector", k)


def vector_ann(
    queries: DataFrame, cells: DataFrame, k: int, n_cells: int | None = None, nprobe: int | None = None, seed: int = 7,
    block: int = 4096,
) -> DataFrame:
    """Approximate top k: coarse k-means lists, the `nprobe` nearest lists per query, exact scores inside them.

    The centroids are trained on all vectors. Their number follows the square root of the vectors' (at most 4096), and a
    quarter of the lists is probed, unless given. Queries without a vector find nothing.
    """
    stored = materialize(cells.filter(F.size("embedding") > 0).select(*SCOPE, "mem_cell_id", "embedding"), "vectors")
    points = stored.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    total = points.count()
    wanted = n_cells or max(8, min(4096, math.isqrt(total)))
    probed = nprobe or math.ceil(wanted / 4)
    model = KMeans(k=min(wanted, max(1, total)), seed=seed, maxIter=10).fit(points.select("features"))
    listed = model.transform(points).select(
        *SCOPE, "mem_cell_id", "embedding", F.col("prediction").alias("list")
    )
    centers = np.vstack(model.clusterCenters())  # n_cells rows, a fixed number

    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        gaps = -_similarity(_matrix(vectors), centers, "L2")
        return pd.Series(list(np.argsort(gaps, axis=1, kind="stable")[:, :probed].astype("int32")))

    probes = queries.filter(F.size("query_vec") > 0).select(
        "query_id", *SCOPE, "query_vec", F.explode(nearest(F.col("query_vec").cast("array<double>"))).alias("list")
    )
    local = blocked(
        probes, listed, [*SCOPE, "list"], "query_id", "mem_cell_id", _best_vectors(k, "COSINE"), HIT, block
    )
    return ranked(local, "vector", k)


# --- entity and graph ---------------------------------------------------------------------------------------------


def query_entities(queries: DataFrame, entities, text: str = "query") -> DataFrame:
    """query_id, scope, pos, entity; `entities` maps a text Column to an array Column."""
    return unnest(queries, ["query_id", *SCOPE], entities(F.col(text)), "pos", "entity")


def entity_topk(asked: DataFrame, postings: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """Entities of a query through the inverted index to cells.

    score = max(1, entities that occur in the cell's text) / max(1, entities of the query); case-sensitive.
    """
    asked = sized(asked)
    per_query = asked.groupBy("query_id", *SCOPE).agg(F.collect_set("entity").alias("_all"))
    found = (
        postings.select(*SCOPE, "entity", "mem_cell_id").join(asked, [*SCOPE, "entity"])
        .select("query_id", *SCOPE, "mem_cell_id")
        .distinct()
    )
    # The query's entities travel with the pair, so the text is read in one join and goes no further.
    pairs = sized(found.join(per_query, ["query_id", *SCOPE]))
    inside = F.size(F.filter("_all", lambda e: F.contains("text", e)))
    score = F.greatest(F.lit(1), inside) / F.greatest(F.lit(1), F.size("_all"))
    hits = cells.select(*SCOPE, "mem_cell_id", "text").join(pairs, [*SCOPE, "mem_cell_id"]).select(
        "query_id", *SCOPE, F.col("mem_cell_id").alias("memory_id"), score.alias("score")
    )
    return ranked(hits, "entity", k)


def graph_topk(
    asked: DataFrame, nodes: DataFrame, edges: DataFrame, cells: DataFrame, k: int, max_depth: int = 2,
    hop_decay: float | None = None,
) -> DataFrame:
    """Entities of a query through the graph to memories, first 2k by (entity position, hop, id), then top k."""
    seeds = asked.select("query_id", *SCOPE, "pos", entity_node_id("entity").alias("node_id"))
    seeds = seeds.withColumn("seed_id", F.concat_ws("|", "query_id", "pos"))
    reached, _ = graph_traverse(
        seeds.select(F.col("seed_id").alias("query_id"), *SCOPE, "node_id"), nodes, edges, max_depth, last_prefix=MEMORY_PREFIX
    )
    back = seeds.select(F.col("seed_id").alias("query_id"), *SCOPE, F.col("query_id").alias("_q"), "pos")
    memories = (
        reached.filter(F.col("node_type") == "memory")
        .join(back, QUERY)
        .groupBy(F.col("_q").alias("query_id"), *SCOPE, "memory_id")
        .agg(F.min(F.struct("pos", "hop")).alias("_at"))
    )
    first = Window.partitionBy(*QUERY).orderBy("_at", "memory_id")
    chosen = memories.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= 2 * k)
    ids = cells.select(*SCOPE, F.col("mem_cell_id").alias("memory_id"))
    known = ids.join(sized(chosen), [*SCOPE, "memory_id"])
    score = F.lit(1.0) if hop_decay is None else F.pow(F.lit(hop_decay), F.col("_at.hop") - 1)
    return (
        known.withColumn("rank", F.row_number().over(Window.partitionBy(*QUERY).orderBy("_r")) - 1)
        .filter(F.col("rank") < k)
        .select("query_id", *SCOPE, F.lit("graph").alias("channel"), "memory_id", score.alias("score"), "rank")
    )
