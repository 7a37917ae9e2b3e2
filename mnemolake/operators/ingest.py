"""Turns to raw records, raw records to segments, segments to memory cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.operators.ordered import rank_in_key, runs_in_key, split_hot_keys
from mnemolake.schemas import REQUEST, SCOPE


def _sessions(requests: DataFrame) -> DataFrame:
    return requests.select("*", F.posexplode("history_sessions").alias("session_pos", "session"))


def _layer(**fields: Column) -> Column:
    """Map of the given fields without the absent or empty ones."""
    pairs = [x for name, value in fields.items() for x in (F.lit(name), value.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull() & (v != ""))


def _over(base: Column, top: Column) -> Column:
    """Union of two maps in which `top` wins."""
    return F.map_zip_with(base, top, lambda _, low, high: F.coalesce(high, low))


def request_metadata() -> Column:
    own = _layer(
        agent_id=F.col("agent_id"), agent_role=F.col("agent_role"), adiu=F.col("adiu"),
        request_session_id=F.col("session_id"), idempotency_key=F.col("idempotency_key"),
        min_read_consistency=F.col("min_read_consistency"),
    )
    return _over(F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>")), own)


def session_metadata(session: Column) -> Column:
    own = _layer(
        speaker_a=session["speaker_a"], speaker_b=session["speaker_b"],
        session_summary=session["session_summary"], session_observation=session["session_observation"],
        session_extra=session["extra"],
    )
    return _over(request_metadata(), own)


def turn_metadata(session: Column, turn: Column) -> Column:
    own = _layer(
        dia_id=turn["dia_id"], turn_index=turn["turn_index"],
        has_answer=F.when(turn["has_answer"], F.lit("true")), token_count=turn["token_count"],
        img_url=turn["img_url"], caption=turn["caption"], turn_extra=turn["extra"],
    )
    return _over(session_metadata(session), own)


def raw_per_turn(requests: DataFrame) -> DataFrame:
    """One raw record per turn, content `role: text`."""
    session, turn = F.col("session"), F.col("turn")
    turns = _sessions(requests).select("*", F.posexplode("session.turns").alias("turn_pos", "turn"))
    return turns.select(
        F.concat_ws(":", "request_id", "session_pos", "turn_pos").alias("raw_id"),
        "request_id", "tenant_id", "user_id", session["session_id"].alias("session_id"), "raw_data_type",
        (F.col("session_pos").cast("bigint") * (1 << 31) + F.col("turn_pos")).alias("pos"),
        F.concat(turn["role"], F.lit(": "), turn["content"]).alias("content"),
        F.coalesce(
            turn["timestamp"], session["session_date"], session["session_start"], F.col("event_time")
        ).alias("event_time"),
        turn_metadata(session, turn).alias("metadata"),
    )


def raw_per_session(requests: DataFrame) -> DataFrame:
    """One raw record per session: its turns as `speaker: text` lines. Built inside the row, no shuffle."""
    session = F.col("session")
    lines = F.transform(
        session["turns"],
        lambda t: F.concat(F.coalesce(F.nullif(t["speaker_name"], F.lit("")), t["role"]), F.lit(": "), t["content"]),
    )
    return _sessions(requests).select(
        F.concat_ws(":", "request_id", "session_pos").alias("raw_id"),
        "request_id", "tenant_id", "user_id", session["session_id"].alias("session_id"), "raw_data_type",
        F.col("session_pos").cast("bigint").alias("pos"),
        F.array_join(lines, "\n").alias("content"),
        F.coalesce(session["session_date"], session["session_start"], F.col("event_time")).alias("event_time"),
        session_metadata(session).alias("metadata"),
    )


def event_minutes(moment: Column) -> Column:
    return F.unix_micros(moment.cast("timestamp")) / F.lit(60_000_000.0)


# --- segmentation -------------------------------------------------------------------------------------------------


def gap_segments(raws: DataFrame, gap_min: float = 30, rows_per_chunk: int = 1_000_000) -> DataFrame:
    """Segments by the time rule alone: a gap above `gap_min` minutes starts a new one."""
    return runs_in_key(
        raws, REQUEST, [F.col("pos"), F.col("raw_id")], F.col("event_min"),
        lambda before, now: (now - before) > gap_min, "segment", rows_per_chunk,
    )


def _fold_small(raws: DataFrame, gap_min: float, max_turns: int, max_tokens: int) -> DataFrame:
    """The sequential rule as one array fold per request."""
    rest = [c for c in raws.columns if c not in (*REQUEST, "pos", "raw_id")]
    place = lambda r: F.struct(r["pos"], r["raw_id"])
    by_pos = lambda a, b: F.when(place(a) < place(b), -1).when(place(a) > place(b), 1).otherwise(0)
    grouped = raws.groupBy(*REQUEST).agg(
        F.array_sort(F.collect_list(F.struct("pos", "raw_id", *rest)), by_pos).alias("_rows")
    )
    slim = F.transform(
        "_rows",
        lambda r: F.struct(r["event_min"].cast("double").alias("at"), F.coalesce(F.length(r["content"]), F.lit(0)).alias("chars")),
    )
    start = F.struct(
        F.lit(-1).alias("segment"), F.lit(0).alias("turns"), F.lit(0).alias("chars"),
        F.lit(None).cast("double").alias("last"), F.array().cast("array<int>").alias("out"),
    )

    def step(acc, r):
        cut = (
            (acc["segment"] < 0)
            | F.coalesce(r["at"] - acc["last"] > gap_min, F.lit(False))
            | (acc["turns"] >= max_turns)
            | (F.floor(acc["chars"] / 4) >= max_tokens)
        )
        number = acc["segment"] + cut.cast("int")
        return F.struct(
            number.alias("segment"),
            (F.when(cut, 0).otherwise(acc["turns"]) + 1).alias("turns"),
            (F.when(cut, 0).otherwise(acc["chars"]) + r["chars"]).alias("chars"),
            F.coalesce(r["at"], F.lit(None).cast("double")).alias("last"),
            F.concat(acc["out"], F.array(number)).alias("out"),
        )

    numbers = F.aggregate(slim, start, step, lambda acc: acc["out"])
    pairs = F.explode(F.arrays_zip(F.col("_rows").alias("row"), numbers.alias("segment")))
    return (
        grouped.select(*REQUEST, pairs.alias("_p"))
        .select(*REQUEST, "_p.row.*", F.col("_p.segment").cast("bigint").alias("segment"))
        .select(*raws.columns, "segment")
    )


def _walk(rows: pd.DataFrame, first: int, begin: int, gap_min: float, max_turns: int, max_tokens: int, known=None):
    """Open-segment start per row from index `first`, when the segment open there began at index `begin`.

    Stops early where the walk meets `known`, an earlier walk of the same rows.
    """
    at, chars = rows["at"].to_numpy(float), rows["chars"].to_numpy("int64")
    held = int(chars[begin:first].sum())
    out = []
    for i in range(first, len(rows)):
        gap = i > 0 and at[i] - at[i - 1] > gap_min
        if i > begin and (gap or i - begin >= max_turns or held // 4 >= max_tokens):
            begin, held = i, 0
        held += int(chars[i])
        out.append(begin)
        if known is not None and known[i - first] == begin:
            return out + known[i - first + 1:]
    return out


def _fold_large(raws: DataFrame, gap_min, max_turns, max_tokens, rows_per_chunk) -> DataFrame:
    """The same rule for requests of any length: chunk maps, then one tiny composition, then a replay.

    The open segment at a chunk border began at one of the last `max_turns` rows before it, so each chunk is
    walked from every such start; chaining these maps gives the true start of each chunk.
    """
    slim = raws.select(
        *REQUEST, "pos", "raw_id", F.col("event_min").cast("double").alias("at"),
        F.coalesce(F.length("content"), F.lit(0)).alias("chars"),
    )
    chunks, _ = split_hot_keys(
        slim, REQUEST, [F.col("pos"), F.col("raw_id")], rows_per_chunk, min_rows=4 * max_turns
    )
    tail = Window.partitionBy(*REQUEST, "_chunk").orderBy(F.col("pos").desc(), F.col("raw_id").desc())
    halo = (
        chunks.withColumn("_r", F.row_number().over(tail)).filter(F.col("_r") <= max_turns).drop("_r")
        .withColumn("_chunk", F.col("_chunk") + 1).withColumn("halo", F.lit(True))
    )
    # A halo without own rows (after the last chunk) yields nothing below.
    framed = chunks.withColumn("halo", F.lit(False)).unionByName(halo)

    def split(pdf):
        pdf = pdf.sort_values(["pos", "raw_id"], kind="stable").reset_index(drop=True)
        return pdf, int(pdf["halo"].sum())

    def maps(key, pdf):
        rows, first = split(pdf)
        if first == len(rows):
            return pd.DataFrame(columns=[*group, "start_in", "start_out", "cuts"])
        out, known = [], None
        for begin in range(first) if first else [0]:
            walk = _walk(rows, first, begin, gap_min, max_turns, max_tokens, known)
            known = walk
            cuts = len({b for b in walk if b >= first})
            out.append((*key, rows["raw_id"][begin], rows["raw_id"][walk[-1]], cuts))
        return pd.DataFrame(out, columns=[*group, "start_in", "start_out", "cuts"])

    def compose(key, pdf):
        pdf = pdf.sort_values("_chunk")
        out, open_at, done = [], None, 0
        for chunk, part in pdf.groupby("_chunk", sort=True):
            row = part if open_at is None else part[part["start_in"] == open_at]
            if len(row) != 1:
                raise ValueError(f"open segment of {key} is older than the rows kept before chunk {chunk}")
            out.append((*key, chunk, row["start_in"].iloc[0], done))
            open_at, done = row["start_out"].iloc[0], done + int(row["cuts"].iloc[0])
        return pd.DataFrame(out, columns=[*group, "start_in", "done"])

    def replay(key, pdf):
        rows, first = split(pdf)
        if first == len(rows):
            return pd.DataFrame(columns=[*REQUEST, "pos", "raw_id", "segment"])
        begin = int(rows.index[rows["raw_id"] == rows["start_in"]][0])
        walk = pd.Series(_walk(rows, first, begin, gap_min, max_turns, max_tokens))
        fresh = walk != walk.shift(fill_value=-1 if first == 0 else begin)
        number = fresh.cumsum().to_numpy() + int(rows["done"].iloc[0]) - 1
        return rows.iloc[first:][[*REQUEST, "pos", "raw_id"]].assign(segment=number)

    group = [*REQUEST, "_chunk"]
    named = "".join(f"{c} string, " for c in REQUEST)
    ends = framed.groupBy(*group).applyInPandas(
        maps, named + "_chunk bigint, start_in string, start_out string, cuts bigint"
    )
    starts = ends.groupBy(*REQUEST).applyInPandas(
        compose, named + "_chunk bigint, start_in string, done bigint"
    )
    numbered = framed.join(starts, group).groupBy(*group).applyInPandas(
        replay, named + "pos bigint, raw_id string, segment bigint"
    )
    return raws.join(numbered, [*REQUEST, "pos", "raw_id"]).select(*raws.columns, "segment")


def segment(
    raws: DataFrame, gap_min: float = 30, max_turns: int = 20, max_tokens: int = 512,
    fold_rows: int = 500, rows_per_chunk: int = 50_000,
) -> DataFrame:
    """Full segmentation per request of a scope: time gap, number of turns, or size of the open segment starts a new one.

    Rows are ordered by pos and raw_id, which is unique within a request; null content counts as no characters. Requests
    above `fold_rows` rows are worked off in chunks by the same rule, with the same result.
    """
    counts = raws.groupBy(*REQUEST).count().filter(F.col("count") > fold_rows)
    if counts.isEmpty():
        return _fold_small(raws, gap_min, max_turns, max_tokens)
    long_ids = counts.select(*REQUEST)
    small = _fold_small(raws.join(long_ids, REQUEST, "left_anti"), gap_min, max_turns, max_tokens)
    large = _fold_large(
        raws.join(long_ids, REQUEST, "left_semi"), gap_min, max_turns, max_tokens, rows_per_chunk
    )
    return small.unionByName(large)


def split_at(segmented: DataFrame, answers: DataFrame) -> DataFrame:
    """Cut segments once more at a model's boundary index (0 < index < size), then renumber per request.

    `answers`: scope, request_id, segment, boundary_index.
    """
    part = [*REQUEST, "segment"]
    place = Window.partitionBy(*part).orderBy("pos", "raw_id")
    joined = (
        segmented.withColumn("_i", F.row_number().over(place) - 1)
        .join(answers.select(*part, "boundary_index"), part, "left")
    )
    valid = F.coalesce(F.col("boundary_index") > 0, F.lit(False)) & (F.col("_i") >= F.col("boundary_index"))
    halves = joined.withColumn("_half", valid.cast("int"))
    per_part = halves.select(*part, "_half").distinct()
    order = [F.col("segment"), F.col("_half")]
    renumbered = rank_in_key(per_part, REQUEST, order, "_rank").withColumn("_new", F.col("_rank") - 1)
    return (
        halves.join(renumbered, [*part, "_half"])
        .withColumn("segment", F.col("_new"))
        .select(*segmented.columns)
    )


def segment_sizes(segmented: DataFrame) -> DataFrame:
    return segmented.groupBy(*REQUEST, "segment").agg(F.count(F.lit(1)).alias("n_turns"))


def scoped_request() -> Column:
    """tenant/user/request, with empty text for what is null."""
    return F.array_join(F.array(*REQUEST), "/", "")


def build_cells(segmented: DataFrame) -> DataFrame:
    """One cell per segment (a segment is bounded by the segmentation limits); session and time of its first raw.

    The cell's id holds the scope: request ids are unique within a tenant and user only.
    """
    first = F.struct("pos", "raw_id", "session_id", "event_min")
    rows = F.sort_array(F.collect_list(F.struct("pos", "raw_id", "content")))
    grouped = segmented.groupBy(*REQUEST, "segment").agg(F.min(first).alias("_f"), rows.alias("_r"))
    return grouped.select(
        F.concat(scoped_request(), F.lit("#"), F.col("segment").cast("string")).alias("mem_cell_id"),
        *SCOPE, F.col("_f.session_id"), "request_id", "segment",
        F.transform("_r", lambda r: r["raw_id"]).alias("raw_data_ids"),
        F.array_join(F.transform("_r", lambda r: r["content"]), "\n").alias("text"),
        F.col("_f.event_min"),
    )


__all__ = [
    "raw_per_turn", "raw_per_session", "request_metadata", "session_metadata", "turn_metadata", "event_minutes",
    "gap_segments", "segment", "split_at", "segment_sizes", "build_cells",
]
