"""Stateful stream operators; each equals its batch form on ordered input.

Rows of one key that arrive in one micro-batch are sorted first; across micro-batches arrival order counts.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mnemolake.functions.scoring import signal_map
from mnemolake.operators import store
from mnemolake.operators.lifecycle import ACCESS_FEEDBACK, targeted, touched_at
from mnemolake.operators.scenes import TIMELESS, SceneState, cell_days, scene_key
from mnemolake.schemas import REQUEST, SCOPE
from mnemolake.session import scratch_path
from mnemolake.streaming.runs import run_available
from mnemolake.streaming.sinks import Ledger, Retry, deliver, to_folder


def stream_dedupe(stream: DataFrame, key: Sequence[str], ts: str, ttl: str = "24 hours") -> DataFrame:
    """The first row per key within `ttl` of event time; the watermark bounds the kept keys.

    A row with a null in its key claims nothing: each gets a claim of its own, so none is lost."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, ttl)
    absent = F.lit(False)
    for name in key:
        absent = absent | F.col(name).isNull()
    return timed.filter(~absent).dropDuplicatesWithinWatermark(list(key)).unionByName(timed.filter(absent))


class _Expiring(StatefulProcessor):
    """State that goes by event time: one timer per key, moved with the key's last event; when the watermark passes it, nothing
    that may still arrive can reach the state, so all of it is cleared."""

    expires = False

    def expire_at(self, millis: int) -> None:
        if not self.expires:
            return
        for old in self._handle.listTimers():
            if (old := old if isinstance(old, int) else int(old[0])) != millis:
                self._handle.deleteTimer(old)
        self._handle.registerTimer(millis)

    def drop(self) -> None:
        raise NotImplementedError

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: ANN001, N802, N803
        self.drop()
        return iter(())

    def close(self) -> None:
        pass


def _keyed(stream: DataFrame, keys: Sequence[str], micros: Column, delay: str | None, processor: _Expiring, schema: str) -> DataFrame:
    """Without a delay state stays for ever. With one, event time has a watermark: state expires, and rows behind the watermark
    or without a time are dropped."""
    if delay is None:
        return stream.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "None")
    processor.expires = True
    timed = stream.withColumn("_time", F.timestamp_micros(micros.cast("bigint"))).withWatermark("_time", delay)
    return timed.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime")


class _Folding(StatefulProcessor):
    """One binary value per key: `start()` a state, `step(state, sorted rows)` gives output rows."""

    order: list[str] = []
    columns: list[str] = []

    def start(self, first):  # noqa: ANN001
        raise NotImplementedError

    def step(self, key, state, row):  # noqa: ANN001
        raise NotImplementedError

    def finish(self, key, state) -> list[tuple]:  # noqa: ANN001
        return []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._value = handle.getValueState("state", "data binary")

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues):  # noqa: ANN001, N802, N803
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        held = self._value.get() if self._value.exists() else None
        state = pickle.loads(held[0]) if held else None
        out = []
        for row in batch.itertuples(index=False):
            if state is None:
                state = self.start(row)
            made = self.step(key, state, row)
            if made is not None:
                out.append(made)
        out.extend(self.finish(key, state))
        self._value.update((pickle.dumps(state),))
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


class _Segmenter(_Expiring):
    columns = [*REQUEST, "raw_id", "pos", "segment"]

    def __init__(self, gap_min: float, max_turns: int, max_tokens: int, forget_min: float) -> None:
        self.gap_min, self.max_turns, self.max_tokens, self.forget_min = gap_min, max_turns, max_tokens, forget_min

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getValueState("open", "segment bigint, turns int, chars bigint, last double")

    def drop(self) -> None:
        self._open.clear()

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, N802, N803
        batch = pd.concat([r[["pos", "raw_id", "event_min", "chars"]] for r in rows]).sort_values(["pos", "raw_id"], kind="stable")
        segment, turns, chars, last = self._open.get() if self._open.exists() else (-1, 0, 0, None)
        numbers = []
        for at, size in zip(batch["event_min"].tolist(), batch["chars"].tolist()):
            gap = last is not None and at - last > self.gap_min
            if segment < 0 or gap or turns >= self.max_turns or chars // 4 >= self.max_tokens:
                segment, turns, chars = segment + 1, 0, 0
            turns, chars, last = turns + 1, chars + int(size), at
            numbers.append(segment)
        self._open.update((segment, turns, chars, last))
        if last is not None and last == last:
            self.expire_at(int((last + self.forget_min) * 60_000) + 1)
        out = pd.DataFrame({"raw_id": batch["raw_id"].to_numpy(), "pos": batch["pos"].to_numpy(), "segment": numbers})
        yield out.assign(**dict(zip(REQUEST, key)))[self.columns]


def stream_segment(
    raws: DataFrame, gap_min: float = 30, max_turns: int = 20, max_tokens: int = 512, forget_min: float = 1440, delay: str | None = None,
) -> DataFrame:
    """Rows with the number of their segment. A segment that is idle for `gap_min` is closed by whatever comes next; a request
    that is idle for `forget_min` of event time is over if a `delay` is given: its state goes once the watermark, `delay` behind
    the newest row, is past that, and an id that comes again is a new request. Times must then be those of one clock."""
    chars = F.coalesce(F.length("content"), F.lit(0)).alias("chars")
    slim = raws.select(*REQUEST, "raw_id", "pos", "event_min", chars)
    schema = "tenant_id string, user_id string, request_id string, raw_id string, pos bigint, segment bigint"
    processor = _Segmenter(gap_min, max_turns, max_tokens, max(forget_min, gap_min))
    return _keyed(slim, REQUEST, F.col("event_min") * 60_000_000, delay, processor, schema)


class _Clusterer(_Folding):
    order = ["at", "mem_cell_id"]
    columns = ["tenant_id", "user_id", "mem_cell_id", "at", "scene_id", "similarity", "is_new"]

    def __init__(self, sim: float, gap_days: float, max_size: int, max_scenes: int | None) -> None:
        self.limits = (sim, gap_days, max_size, max_scenes)

    def start(self, first):
        return SceneState(*self.limits)

    def step(self, key, scenes, row):
        first, score, new = scenes.place(row.mem_cell_id, row.embedding, row.at)
        at = row.at if row.at < TIMELESS else None
        return row.tenant_id, row.user_id, row.mem_cell_id, at, f"{key[0]}#{first}", score, new


def stream_cluster(
    cells: DataFrame, sim: float = 0.65, gap_days: float = 7, max_size: int = 50, max_scenes: int | None = None,
) -> DataFrame:
    keyed = cells.select(
        F.concat_ws("|", *SCOPE, scene_key(cells)).alias("scene_key"), *SCOPE, "mem_cell_id",
        cell_days(cells).alias("at"), "embedding",
    )
    return keyed.groupBy("scene_key").transformWithStateInPandas(
        _Clusterer(sim, gap_days, max_size, max_scenes),
        "tenant_id string, user_id string, mem_cell_id string, at double, scene_id string, similarity double,"
        "is_new boolean", "Append", "None",
    )


class _Strength(_Folding):
    order = ["at", "event_id"]
    columns = ["tenant_id", "user_id", "mem_cell_id", "old_strength", "strength", "access_count", "n_events"]

    def __init__(self, eta: float, lam: float, s_max: float, delta: float) -> None:
        self.eta, self.lam, self.s_max, self.delta = eta, lam, s_max, delta

    def start(self, first):
        return {"old": first.strength, "s": first.strength, "access": first.access_count, "n": 0, "at": None, "hit": None}

    def step(self, key, s, row):
        if row.kind == "hit":
            if row.batch_day != s["hit"]:  # one hit per batch
                s.update(s=min(s["s"] + self.delta, self.s_max), access=s["access"] + 1, hit=row.batch_day)
            return None
        before = row.updated if s["at"] is None else s["at"]
        days = max(0.0, (row.at - before) / 86_400_000_000.0) if before == before and before is not None else 0.0
        value = s["s"] + self.eta * row.signal - self.lam * days
        s.update(s=max(0.0, min(self.s_max, value)), access=s["access"] + row.used, n=s["n"] + 1, at=row.at)
        return None

    def finish(self, key, s):
        return [(*key, s["old"], s["s"], int(s["access"]), s["n"])]


def feedback_events(feedback: DataFrame, cells: DataFrame) -> DataFrame:
    """Feedback as strength events; unknown cells and foreign scopes fall out in the join."""
    base = cells.select(*SCOPE, "mem_cell_id", "strength", "access_count", touched_at(cells).alias("updated"))
    return targeted(feedback).join(base, [*SCOPE, "mem_cell_id"]).select(
        *SCOPE, "mem_cell_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        F.lit("feedback").alias("kind"), signal_map(F.col("feedback_type"), F.col("signal_value")).alias("signal"),
        F.col("feedback_type").isin(*ACCESS_FEEDBACK).cast("int").alias("used"), F.lit("").alias("batch_day"),
        F.coalesce("strength", F.lit(0.0)).alias("strength"), "access_count", "updated",
    )


def hit_events(hits: DataFrame, cells: DataFrame) -> DataFrame:
    base = cells.select(*SCOPE, "mem_cell_id", "strength", "access_count", touched_at(cells).alias("updated"))
    day = F.col("batch_day").cast("string")
    key = [*(c for c in SCOPE if c in hits.columns), "mem_cell_id"]
    return hits.join(base, key).select(
        *SCOPE, "mem_cell_id", "event_id", F.unix_micros(F.col("batch_day").cast("timestamp")).alias("at"),
        F.lit("hit").alias("kind"), F.lit(0.0).alias("signal"), F.lit(0).alias("used"), day.alias("batch_day"),
        F.coalesce("strength", F.lit(0.0)).alias("strength"), "access_count", "updated",
    )


def stream_feedback(
    events: DataFrame, eta: float = 0.3, lam: float = 0.01, s_max: float = 5.0, delta: float = 0.1,
) -> DataFrame:
    """Running strength per cell (update mode: the newest row of a cell is its state)."""
    return events.groupBy(*SCOPE, "mem_cell_id").transformWithStateInPandas(
        _Strength(eta, lam, s_max, delta),
        "tenant_id string, user_id string, mem_cell_id string, old_strength double, strength double, access_count int,"
        "n_events bigint", "Update", "None",
    )


SLICE = 100_000  # rows of one answer


class _Limit(_Expiring):
    """The last n accepted times stand in a ring: an event looks at the one n places back and, if accepted, replaces it."""

    def __init__(self, n: int, seconds: float) -> None:
        self.n, self.width = n, int(seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._taken = handle.getMapState("taken", "slot int", "at bigint")
        self._count = handle.getValueState("count", "accepted bigint")

    def drop(self) -> None:
        self._taken.clear()
        self._count.clear()

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, N802, N803
        # A key may hold a large share of a batch: two numbers a row stay, as arrays; the rest goes in slices.
        parts = [(r["at"].to_numpy(), r["event_id"].to_numpy()) for r in rows]
        at, event_id = (np.concatenate(x) for x in zip(*parts))
        del parts
        order = np.lexsort((event_id, at))
        count = self._count.get()[0] if self._count.exists() else 0
        ring: dict[int, int] = {}  # entries this batch has looked at or written, n at most
        written, newest = set(), None
        for start in range(0, len(order), SLICE):
            here, accepted = order[start : start + SLICE], []
            for now in at[here].tolist():
                slot = count % self.n if self.n else 0
                if self.n and count >= self.n and slot not in ring:
                    ring[slot] = self._taken.getValue((slot,))[0]
                free = self.n > 0 and (count < self.n or ring[slot] <= now - self.width)
                if free:
                    ring[slot], newest, count = now, now, count + 1
                    written.add(slot)
                accepted.append(free)
            yield pd.DataFrame({"key": key[0], "event_id": event_id[here], "accepted": accepted})
        for slot in written:
            self._taken.updateValue((slot,), (ring[slot],))
        if newest is not None:
            self._count.update((count,))
            self.expire_at((newest + self.width) // 1000 + 1)


def stream_limit(events: DataFrame, key: str, ts: str, n: int = 120, seconds: float = 60, delay: str | None = None) -> DataFrame:
    """key, event_id, accepted, as the batch form on ordered input. A key's state is n times at most. With a `delay` it
    goes once the watermark, `delay` behind the newest event, is a full window past its last accepted event."""
    slim = events.select(
        F.col(key).cast("string").alias("key"), "event_id", (F.unix_micros(F.col(ts).cast("timestamp"))).alias("at")
    )
    return _keyed(slim, ["key"], F.col("at"), delay, _Limit(n, seconds), "key string, event_id bigint, accepted boolean")


TARGETS = {"text": "es", "vector": "milvus"}  # names that dead letters give to the sinks


def stream_fanout(
    stream: DataFrame, paths: dict[str, str], at: Column, checkpoint: str | None = None, retry: Retry = Retry(),
    writers: dict[str, Callable[[DataFrame, int], None]] | None = None, ledger: str | None = None, **rules,
) -> None:
    """Each micro-batch of cells to the text, vector and dead-letter sinks, by default one directory per batch id in `paths`.

    A sink that fails is tried again (`retry`); after the last try its rows become dead letters of that sink, and the other
    sinks complete. A replayed batch writes no sink again that the ledger knows to have ended. Only dead letters that cannot
    be written fail the batch. `writers` replaces the folders of single sinks."""
    write_to = {name: to_folder(path) for name, path in paths.items()} | (writers or {})
    kept = Ledger(stream.sparkSession, ledger or scratch_path(stream.sparkSession, "ledger"))

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        docs, vectors, dead = store.index_fanout(batch, at, **rules)
        for name, rows in (("text", docs), ("vector", vectors)):
            tries, error = deliver(rows, number, name, write_to[name], kept, retry)
            if error is not None:
                lost = rows.select(
                    F.lit(TARGETS[name]).alias("target"), "mem_cell_id", F.lit("index").alias("operation"),
                    F.lit(error).alias("error"), F.lit(tries).alias("retry_count"), at.alias("ts"),
                )
                dead = dead.unionByName(lost)
        write_to["dlq"](dead, number)
        batch.unpersist()

    run_available(stream, write, checkpoint=checkpoint)
