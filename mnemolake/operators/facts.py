"""Deciding new facts against known ones, and writing the decisions back."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.functions.scoring import FactThresholds, decide
from mnemolake.functions.text import char_set
from mnemolake.operators.blocks import blocked
from mnemolake.operators.setjoin import candidates as set_candidates
from mnemolake.schemas import SCOPE
from mnemolake.session import cut, materialize

BLOCK = 8192  # forms of one side that a task holds
W_JACCARD, W_COSINE = 0.4, 0.6

# Facts that share scope, character set and vector compare alike, so they are collapsed to one "form" first:
# a group of copies of any size is one row in every comparison below.


def self_similarity(vectors: bool, w_jaccard: float = W_JACCARD, w_cosine: float = W_COSINE) -> Column:
    """Composite similarity of a form with an equal one: below 1 for zero vectors and texts without characters."""
    jaccard = F.when(F.col("chars") != "", 1.0).otherwise(0.0)
    if not vectors:
        return jaccard
    cosine = F.when(F.exists("vec", lambda x: x != 0), 1.0).otherwise(0.0)
    mixed = (w_jaccard * jaccard + w_cosine * cosine) / (w_jaccard + w_cosine)
    return F.when(F.size("vec") > 0, mixed).otherwise(jaccard)


def fact_forms(facts: DataFrame, order: str | None = None, fold_from: float = 0.0) -> DataFrame:
    """scope, form id, characters, vector, number of facts, first id (and first order).

    Equal facts are one form if their similarity is at least `fold_from`; else each is a form of its own."""
    vector = "embedding" if "embedding" in facts.columns else None
    packed = facts.select(
        *SCOPE, "semantic_id", *([order] if order else []),
        F.array_join(char_set(F.col("content")), "").alias("chars"),
        (F.col(vector).cast("array<double>") if vector else F.lit(None).cast("array<double>")).alias("vec"),
    )
    first = F.min(F.struct(*([order] if order else []), "semantic_id")).alias("_first")
    apart = F.when(self_similarity(vector is not None) < fold_from, F.col("semantic_id")).alias("_apart")
    grouped = packed.groupBy(*SCOPE, "chars", "vec", apart).agg(first, F.count(F.lit(1)).alias("n"))
    return grouped.select(
        *SCOPE, "chars", "vec", "n", F.col("_first.semantic_id").alias("form_id"),
        *([F.col(f"_first.{order}").alias("at")] if order else []),
    )


def _forms_of(facts: DataFrame) -> DataFrame:
    vector = "embedding" in facts.columns
    return facts.select(
        *SCOPE, "semantic_id", F.array_join(char_set(F.col("content")), "").alias("chars"),
        (F.col("embedding").cast("array<double>") if vector else F.lit(None).cast("array<double>")).alias("vec"),
    )


def _incidence(a: pd.Series, b: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Rows of both sides as 0/1 over the characters that occur on both; others are never common."""
    codes = [np.frombuffer("".join(x).encode("utf-32-le", "surrogatepass"), dtype="<u4") for x in (a, b)]
    letters = np.intersect1d(*codes)

    def rows(texts: pd.Series, own: np.ndarray) -> np.ndarray:
        out = np.zeros((len(texts), max(1, len(letters))), dtype="float32")
        at = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
        known = np.isin(own, letters)
        out[at[known], np.searchsorted(letters, own[known])] = 1
        return out

    return rows(a, codes[0]), rows(b, codes[1])


STRIP = 512  # new rows a task compares at a time, so that its matrices stay small beside a block of any size


def similarity_strips(new: pd.DataFrame, old: pd.DataFrame, w_jaccard: float = W_JACCARD, w_cosine: float = W_COSINE) -> Iterator[np.ndarray]:
    """Composite similarities of STRIP new forms after the other with every old form of one block pair."""
    a, b = _incidence(new["chars"], old["chars"])
    sizes = [f["chars"].str.len().to_numpy(dtype="float64") for f in (new, old)]
    own, width = (np.array([0 if v is None else len(v) for v in f["vec"]], dtype="int64") for f in (new, old))
    shared = sorted(set(own[own > 0]) & set(width))
    columns = {size: np.flatnonzero(width == size) for size in shared}
    vectors = {size: np.vstack(old["vec"].iloc[columns[size]]).astype("float64") for size in shared}
    lengths = {size: np.linalg.norm(vectors[size], axis=1) for size in shared}
    for at in range(0, len(new), STRIP):
        part = slice(at, at + STRIP)
        both = (a[part] @ b.T).astype("float64")
        either = sizes[0][part, None] + sizes[1][None, :] - both
        jaccard = np.divide(both, either, out=np.zeros_like(both), where=either > 0)
        has = own[part] > 0
        if not has.any():
            yield jaccard
            continue
        cosine = np.zeros_like(jaccard)
        for size in shared:
            r, c = np.flatnonzero(own[part] == size), columns[size]
            if not len(r):
                continue
            x = np.vstack(new["vec"].iloc[at + r]).astype("float64")
            length = np.linalg.norm(x, axis=1)[:, None] * lengths[size][None, :]
            found = np.divide(x @ vectors[size].T, length, out=np.zeros(length.shape), where=length > 0)
            if found.shape == cosine.shape:
                cosine = found
            else:
                cosine[np.ix_(r, c)] = found
        mixed = (w_jaccard * jaccard + w_cosine * cosine) / (w_jaccard + w_cosine)
        yield mixed if has.all() else np.where(has[:, None], mixed, jaccard)


def similarities(new: pd.DataFrame, old: pd.DataFrame, w_jaccard: float = W_JACCARD, w_cosine: float = W_COSINE) -> np.ndarray:
    """Composite similarity of every new form with every old form of one block pair (stays inside the task)."""
    strips = list(similarity_strips(new, old, w_jaccard, w_cosine))
    return np.vstack(strips) if strips else np.zeros((0, len(old)))


PAIR = "tenant_id string, user_id string, form_id string, target_id string, sim double"
PAIR_COLUMNS = ["tenant_id", "user_id", "form_id", "target_id", "sim"]


def _pairs(new: pd.DataFrame, old: pd.DataFrame, at: tuple[np.ndarray, np.ndarray], sims: np.ndarray) -> pd.DataFrame:
    i, j = at
    return pd.DataFrame(
        {
            "tenant_id": new["tenant_id"].to_numpy()[i], "user_id": new["user_id"].to_numpy()[i],
            "form_id": new["form_id"].to_numpy()[i], "target_id": old["target_id"].to_numpy()[j], "sim": sims,
        },
        columns=PAIR_COLUMNS,
    )


def _earlier(new: pd.DataFrame, old: pd.DataFrame) -> np.ndarray:
    """Which old rows come before which new rows; without an order every old row does."""
    if "at" not in new or "at" not in old:
        return np.ones((len(new), len(old)), dtype=bool)
    return old["at"].to_numpy()[None, :] < new["at"].to_numpy()[:, None]


def _has_vector(forms: pd.DataFrame) -> np.ndarray:
    return np.array([v is not None and len(v) > 0 for v in forms["vec"]], dtype=bool)


def _sorted_sets(forms: pd.DataFrame, row_id: str) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows by number of characters, then id, and these numbers."""
    sizes = forms["chars"].str.len().to_numpy(dtype="int64")
    order = np.lexsort((forms[row_id].rank(method="first").to_numpy(), sizes))
    return forms.iloc[order].reset_index(drop=True), sizes[order]


def _best_sets(new: pd.DataFrame, old: pd.DataFrame, weight: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Best old set of each new one as (new row, old row, similarity) arrays, the similarity being `weight` times Jaccard's.

    Among sets of one size the one with most common characters is best, so a row is reduced to one number a size before
    anything is divided. Old rows come by size, then id."""
    a, b = _incidence(new["chars"], old["chars"])
    own, theirs = (f["chars"].str.len().to_numpy(dtype="int64") for f in (new, old))
    sizes, starts = np.unique(theirs, return_index=True)
    ends = np.append(starts[1:], len(theirs))
    rank = old["target_id"].rank(method="first").to_numpy()
    out = []
    for at in range(0, len(new), STRIP):
        part = slice(at, at + STRIP)
        both = a[part] @ b.T
        if "at" in new and "at" in old:
            both[~_earlier(new.iloc[part], old)] = -1
        top = np.maximum.reduceat(both, starts, axis=1)
        either = own[part, None] + sizes[None, :] - top.astype("float64")
        sims = weight * np.divide(top, either, out=np.zeros(top.shape), where=either > 0)
        rounded = np.where(top < 0, -2.0, np.round(sims, 9))
        best = rounded.max(axis=1)
        found = np.full(len(best), -1)
        for size in np.flatnonzero((rounded == best[:, None]).any(axis=0)):
            rows = np.flatnonzero((rounded[:, size] == best) & (best >= 0))
            first = starts[size] + (both[rows, starts[size] : ends[size]] == top[rows, size, None]).argmax(axis=1)
            better = (found[rows] < 0) | (rank[first] < rank[found[rows]])
            found[rows[better]] = first[better]
        rows = np.flatnonzero(found >= 0)
        size = np.searchsorted(sizes, theirs[found[rows]])
        out.append((rows + at, found[rows], sims[rows, size]))
    return out


def _mixed_strips(new: pd.DataFrame, old: pd.DataFrame):
    """(first new row, composite similarities of STRIP new rows with all old ones), where both sides have vectors."""
    for number, sims in enumerate(similarity_strips(new, old)):
        at = number * STRIP
        if "at" in new and "at" in old:
            sims[~_earlier(new.iloc[at : at + STRIP], old)] = -2.0
        yield at, sims


def _best_mixed(new: pd.DataFrame, old: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    rank = old["target_id"].rank(method="first").to_numpy()
    out = []
    for at, sims in _mixed_strips(new, old):
        # Only what may round to the best is rounded.
        rows, cols = np.nonzero((sims >= sims.max(axis=1)[:, None] - 2e-9) & (sims > -1.5))
        first = np.lexsort((rank[cols], -np.round(sims[rows, cols], 9), rows))
        rows, cols = rows[first], cols[first]
        least = np.append(True, rows[1:] != rows[:-1])[: len(rows)]
        rows, cols = rows[least], cols[least]
        out.append((rows + at, cols, sims[rows, cols]))
    return out


def _close_sets(new: pd.DataFrame, old: pd.DataFrame, weight: float, min_sim: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs of at least this similarity. Both sides come by size, so a strip meets the sizes only that can reach it."""
    a, b = _incidence(new["chars"], old["chars"])
    own, theirs = (f["chars"].str.len().to_numpy(dtype="int64") for f in (new, old))
    floor = max(0.0, min_sim / weight - 1e-8)
    share = np.float32(floor / (1 + floor))
    out = []
    for at in range(0, len(new), STRIP):
        part = slice(at, at + STRIP)
        low = np.searchsorted(theirs, own[part][0] * floor - 1e-6)
        high = np.searchsorted(theirs, own[part][-1] / floor + 1e-6, "right") if floor > 0 else len(theirs)
        if low >= high:
            continue
        both = a[part] @ b[low:high].T
        total = (own[part, None] + theirs[None, low:high]).astype("float32")
        rows, cols = np.nonzero(both >= share * total - np.float32(1e-2))
        common = both[rows, cols].astype("float64")
        either = own[part][rows] + theirs[low:high][cols] - common
        sims = weight * np.divide(common, either, out=np.zeros(len(rows)), where=either > 0)
        keep = np.round(sims, 9) >= min_sim
        out.append((rows[keep] + at, cols[keep] + low, sims[keep]))
    return out


def _close_mixed(new: pd.DataFrame, old: pd.DataFrame, min_sim: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    out = []
    for at, sims in _mixed_strips(new, old):
        rows, cols = np.nonzero(sims >= min_sim - 1e-9)
        keep = np.round(sims[rows, cols], 9) >= min_sim
        rows, cols = rows[keep], cols[keep]
        out.append((rows + at, cols, sims[rows, cols]))
    return out


def _compared(new: pd.DataFrame, old: pd.DataFrame, of_sets, of_both) -> pd.DataFrame:
    """Pairs of a block pair. New rows without a vector, and those with one against old rows without, go by characters."""
    if new.empty or old.empty:
        return pd.DataFrame(columns=PAIR_COLUMNS)
    (new, _), (old, _) = _sorted_sets(new, "form_id"), _sorted_sets(old, "target_id")
    own, theirs = _has_vector(new), _has_vector(old)
    parts = []
    for rows, cols, compare in (
        (~own, np.ones(len(old), dtype=bool), lambda x, y: of_sets(x, y, 1.0)),
        (own, ~theirs, lambda x, y: of_sets(x, y, W_JACCARD / (W_JACCARD + W_COSINE))),
        (own, theirs, of_both),
    ):
        if not rows.any() or not cols.any():
            continue
        x, y = new[rows].reset_index(drop=True), old[cols].reset_index(drop=True)
        for i, j, sims in compare(x, y):
            if "at" in x and "at" in y:
                keep = y["at"].to_numpy()[j] < x["at"].to_numpy()[i]
                i, j, sims = i[keep], j[keep], sims[keep]
            parts.append(_pairs(x, y, (i, j), sims))
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=PAIR_COLUMNS)


def _best(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    return _compared(new, old, _best_sets, _best_mixed)


def _close(min_sim: float):
    def close(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        return _compared(new, old, lambda x, y, w: _close_sets(x, y, w, min_sim), lambda x, y: _close_mixed(x, y, min_sim))

    return close


def _compare(new_forms: DataFrame, old_forms: DataFrame, best, block: int) -> DataFrame:
    old = old_forms.withColumnRenamed("form_id", "target_id")
    return blocked(new_forms, old, SCOPE, "form_id", "target_id", best, PAIR, block)


def candidate_pairs(new_forms: DataFrame, old_forms: DataFrame, floor: float) -> DataFrame:
    """Pairs of forms of one user whose character sets may be alike enough, each new form with earlier old ones only."""
    a, b = (f.withColumn("elements", F.split("chars", "")).filter("chars <> ''") for f in (new_forms, old_forms))
    ordered = "at" in new_forms.columns and "at" in old_forms.columns
    own = ["form_id", "vec", *(["at"] if ordered else [])]
    pairs = set_candidates(a, b, SCOPE, floor, (own, own))
    return pairs.filter(F.col("r_at") < F.col("l_at")) if ordered else pairs


def close_forms(new_forms: DataFrame, old_forms: DataFrame, min_sim: float, block: int = BLOCK) -> DataFrame:
    """All pairs of forms of one user with at least this similarity: tenant_id, user_id, form_id, target_id, sim.

    Texts of some length use most of an alphabet, so parts of character sets select almost nothing; blocks compare forms by
    matrix products, and only sizes that can reach the similarity meet."""
    return _compare(new_forms, old_forms, _close(min_sim), block)


LIKELY = 0.88  # similarity that the best match of most forms reaches


def best_forms(new_forms: DataFrame, old_forms: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per new form its most similar old form (ties: least id): tenant_id, user_id, form_id, target_id, sim."""
    pairs = _compare(new_forms, old_forms, _best, block)
    first = F.min(F.struct((-F.round("sim", 9)).alias("far"), "target_id", "sim")).alias("_top")
    return pairs.groupBy(*SCOPE, "form_id").agg(first).select(*SCOPE, "form_id", "_top.target_id", "_top.sim")


def fact_pairs(new: DataFrame, existing: DataFrame, min_sim: float = 0.85, block: int = BLOCK) -> DataFrame:
    """Pairs of forms that can matter (similarity at least `min_sim`), with the number of facts on both sides."""
    # Written once: blocks, their comparison and the counts read them, and each would parse all texts again.
    a, b = materialize(fact_forms(new), "forms"), materialize(fact_forms(existing), "forms")
    close = close_forms(a, b, min_sim, block)
    sizes_a = a.select(*SCOPE, "form_id", F.col("n").alias("n_new"))
    sizes_b = b.select(*SCOPE, F.col("form_id").alias("target_id"), F.col("n").alias("n_old"))
    return close.join(sizes_a, [*SCOPE, "form_id"]).join(sizes_b, [*SCOPE, "target_id"])


def best_match(new: DataFrame, existing: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per new fact the most similar existing fact of its user (ties: lowest id)."""
    forms = materialize(fact_forms(new), "forms")
    top = best_forms(forms, materialize(fact_forms(existing), "forms"), block)
    by_form = forms.join(top, [*SCOPE, "form_id"], "left").select(*SCOPE, "chars", "vec", "target_id", "sim")
    return _join_forms(_forms_of(new), by_form).select(*SCOPE, "semantic_id", "target_id", "sim")


def _join_forms(facts: DataFrame, by_form: DataFrame) -> DataFrame:
    """Equi-join on scope, characters and (null-safe) vector."""
    b = by_form.select(*[F.col(c).alias(f"_b_{c}") for c in by_form.columns])
    same = [facts[c] == b[f"_b_{c}"] for c in (*SCOPE, "chars")] + [facts["vec"].eqNullSafe(b["_b_vec"])]
    condition = same[0]
    for more in same[1:]:
        condition = condition & more
    rest = [c for c in by_form.columns if c not in (*SCOPE, "chars", "vec")]
    return facts.join(b, condition).select(*facts.columns, *[F.col(f"_b_{c}").alias(c) for c in rest])


def decide_facts(
    new: DataFrame, existing: DataFrame, thresholds: FactThresholds = FactThresholds(), block: int = BLOCK,
) -> DataFrame:
    """One-shot decision per new fact: ADD, UPDATE, SUPERSEDE or NOOP, with its target."""
    sim = F.coalesce(F.round("sim", 9), F.lit(0.0))
    decision = decide(sim, thresholds)
    return best_match(new, existing, block).select(
        *SCOPE, "semantic_id", F.when(decision != "ADD", F.col("target_id")).alias("target_id"),
        sim.alias("sim"), decision.alias("decision"),
    )


def consolidate_facts(
    candidates: DataFrame, existing: DataFrame, thresholds: FactThresholds = FactThresholds(), order: str = "seq",
    block: int = BLOCK,
) -> DataFrame:
    """Sequential consolidation per user: a candidate also meets the candidates accepted before it.

    A candidate is dropped (NOOP) when a known fact or an earlier accepted candidate is close enough. Only the first of equal
    candidates can survive (unless even equal ones are not close enough), so the rule runs on forms: forms close to a known
    fact go first, then rounds settle every form whose earlier close forms are all settled. A round writes what it settles and
    what stays open, so rounds shrink; their number is the longest chain of close forms, not the number of candidates.
    """
    key = [*SCOPE, "form_id"]
    forms = cut(fact_forms(candidates, order, thresholds.noop))
    known = cut(fact_forms(existing))
    stopped = close_forms(forms, known, thresholds.noop, block).select(*key).distinct()
    open_forms = cut(forms.select(*key).join(stopped, key, "left_anti"))
    as_target = lambda df: df.withColumnRenamed("form_id", "target_id")
    target = [*SCOPE, "target_id"]
    links = close_forms(forms, forms, thresholds.noop, block).select(*key, "target_id").filter(F.col("form_id") != F.col("target_id"))
    links = cut(links.join(open_forms, key, "left_semi").join(as_target(open_forms), target, "left_semi"))
    settled: list[DataFrame] = []
    while True:
        # Open links lead to earlier forms that are not settled: a form without one meets no accepted form.
        fresh = cut(open_forms.join(links.select(*key).distinct(), key, "left_anti"))
        if fresh.isEmpty():
            break
        settled.append(fresh)
        dropped = cut(links.join(as_target(fresh), target, "left_semi").select(*key).distinct())
        gone = fresh.unionByName(dropped)
        open_forms = cut(open_forms.join(gone, key, "left_anti"))
        links = cut(links.join(gone, key, "left_anti").join(as_target(dropped), target, "left_anti"))
    kept = reduce(DataFrame.unionByName, settled) if settled else open_forms
    accepted = cut(forms.join(kept, key, "left_semi"))
    before = F.when(F.col("n") > 0, F.lit(-1)).cast(forms.schema["at"].dataType)
    pool = known.withColumn("at", before).unionByName(
        accepted.select(*known.columns, "at")
    )
    top = best_forms(accepted, pool, block)
    sim = F.coalesce(F.round("sim", 9), F.lit(0.0))
    decision = decide(sim, thresholds)
    return accepted.select(*key).join(top.select(*key, "target_id", "sim"), key, "left").select(
        *SCOPE, F.col("form_id").alias("semantic_id"),
        F.when(decision != "ADD", F.col("target_id")).alias("target_id"), sim.alias("sim"), decision.alias("decision"),
    )


def apply_decisions(facts: DataFrame, new: DataFrame, decisions: DataFrame) -> DataFrame:
    """SUPERSEDE: the old fact becomes invalid and the new one is stored; UPDATE: evidence of the old one grows;
    ADD: the new one is stored; NOOP: nothing."""
    hits = decisions.filter(F.col("target_id").isNotNull()).groupBy(*SCOPE, F.col("target_id").alias("semantic_id")).agg(
        F.count_if(F.col("decision") == "UPDATE").alias("_up"), F.bool_or(F.col("decision") == "SUPERSEDE").alias("_over")
    )
    old = facts.join(hits, [*SCOPE, "semantic_id"], "left").select(
        *SCOPE, "semantic_id", "content",
        (F.col("is_valid") & ~F.coalesce("_over", F.lit(False))).alias("is_valid"),
        (F.col("evidence_count") + F.coalesce("_up", F.lit(0))).cast("int").alias("evidence_count"),
    )
    stored = decisions.filter(F.col("decision").isin("ADD", "SUPERSEDE"))
    fresh = new.join(stored, [*SCOPE, "semantic_id"], "left_semi").select(
        *SCOPE, "semantic_id", "content", F.lit(True).alias("is_valid"), F.lit(1).alias("evidence_count")
    )
    return old.unionByName(fresh)


def mature_scenes(scenes: DataFrame, cells: DataFrame, min_members: int = 3) -> DataFrame:
    """Scenes with enough members and the joined texts of their cells (a scene has a bounded number of members)."""
    grown = scenes.filter(F.size("member_episode_ids") >= min_members)
    members = grown.select(*SCOPE, "scene_id", F.posexplode("member_episode_ids").alias("pos", "mem_cell_id"))
    texts = members.join(cells.select(*SCOPE, "mem_cell_id", "text"), [*SCOPE, "mem_cell_id"]).filter(
        F.coalesce("text", F.lit("")) != ""
    )
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda r: r["text"]), "\n---\n")
    out = texts.groupBy(*SCOPE, "scene_id").agg(F.count(F.lit(1)).alias("n_members"), joined.alias("memories"))
    return out.filter(F.regexp_like("memories", F.lit(r"\S")))
