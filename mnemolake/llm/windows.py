"""Repeated byte windows by depth-limited radix passes, and their removal.

The most significant digit of a window is the least hash of its grams, which depends on the window's bytes alone. As
neighbouring windows mostly have the same digit, a text is a short list of runs of windows, and the first pass moves runs,
not suffixes. Runs of one digit whose bytes are equal fold to one content with a count. Only contents that share a digit
with another one go through the further passes, digit by digit, up to the window's length; windows alone in their group
leave after each pass. Hashes only deal the work out: what is left in a group at full depth is compared byte by byte, runs
are told apart by 128 bits of BLAKE2b, and so is a whole window where it is its own digit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemolake.llm.registry import query, table
from mnemolake.session import materialize

WINDOW = 400
GRAMS = (128, 336, 384, 400)  # bytes that the first digit of each level looks at; the last one is the whole window
DEPTH = 100  # bytes of a later digit
PIECE = 1 << 20  # bytes of a text that are hashed in one go
LOCAL = 500  # contents of one digit that one task sorts; beyond that they are dealt out by a longer digit
BATCH = 1 << 21  # bytes that are sorted in one go
CHECKED = 1 << 22  # bytes that are compared in one go
BASE = 0x9E3779B97F4A7C15 | 1
_L, _B = T.LongType(), T.BinaryType()


def _schema(**columns) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


RANGES = T.ArrayType(_schema(first=_L, last=_L))
RUNS = _schema(a=_L, b=_B, lo=_L, hi=_L, digit=_L, content=_B, tied=T.BooleanType())
PARTS = _schema(digit=_L, content=_B, bytes=_B)
MARKS = _schema(digit=_L, content=_B, ranges=RANGES)
KEPT = _schema(doc_id=_L, n_bytes=_L, n_removed=_L, n_spans=_L, kept_sha256=T.StringType())


def block_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the `size` bytes from each place on; by doubling, so with some ten passes over the array."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    out, have, width, at = None, data.astype(np.uint64) + np.uint64(1), 1, 0
    n = len(data) - size + 1
    while True:
        if size & width:
            part = have[at : at + n]
            out = part if out is None else out * np.uint64(pow(BASE, width, 2**64)) + part
            at += width
        if width * 2 > size:
            break
        have = have[: len(have) - width] * np.uint64(pow(BASE, width, 2**64)) + have[width:]
        width *= 2
    out = (out ^ out >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return (out ^ out >> np.uint64(29)) * np.uint64(0xA0761D6478BD642F) ^ out >> np.uint64(31)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    step, have = 1, values
    while step * 2 <= width:
        have = np.minimum(have[: len(have) - step], have[step:])
        step *= 2
    return np.minimum(have[: len(values) - width + 1], have[width - step :]) if width > step else have


def content_name(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def runs_of(data: bytes, gram: int = GRAMS[0], window: int = WINDOW) -> Iterator[tuple[int, int, int, bytes, bool]]:
    """(first start, last start, digit, content name, tied) of each run of windows of one digit. Tied: the digit stands at
    several places of the run, which a repeat within it needs. Long texts go piece by piece; a run ends where a piece does.
    With grams of a whole window, a run is one window or one repeated byte, and its name is that of its first window."""
    wide = window - gram + 1
    for offset in range(0, max(len(data) - window + 1, 0), PIECE):
        piece = np.frombuffer(data, np.uint8, min(len(data) - offset, PIECE + window - 1), offset)
        grams = block_hashes(piece, gram)
        least = sliding_least(grams, wide)
        starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        lasts = np.concatenate([starts[1:] - 1, [len(least) - 1]])
        digits = least[starts]
        names, rank = np.unique(digits, return_inverse=True)
        place = np.searchsorted(names, grams)
        where = np.flatnonzero(names[np.minimum(place, len(names) - 1)] == grams)
        code = np.sort(place[where] * len(piece) + where)
        at = np.searchsorted(code, rank * len(piece) + starts) + 1
        tied = (at < len(code)) & (code[np.minimum(at, len(code) - 1)] < rank * len(piece) + lasts + wide)
        for lo, hi, digit, tie in zip(starts.tolist(), lasts.tolist(), digits.view(np.int64).tolist(), tied.tolist()):
            lo, hi = offset + lo, offset + hi
            if gram < window:
                yield lo, hi, digit, content_name(data[lo : hi + window]), tie
            elif data.count(data[lo : lo + 1], lo, hi + window) == hi + window - lo:
                yield lo, hi, digit, content_name(data[lo : lo + window]), tie
            else:
                for at in range(lo, hi + 1):
                    yield at, at, digit, content_name(data[at : at + window]), False


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    ranges = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    columns = list(zip(*rows)) or [()] * len(schema)
    arrays = [pa.array(c, kinds.get(f.dataType.simpleString(), ranges)) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, names=schema.names)


def _texts(batch: pa.RecordBatch, step: int = 64) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def _runs(gram: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _texts(batch):
                out = []
                for a, b, data in zip(*(part.column(c).to_pylist() for c in ("a", "b", "data"))):
                    out += [(a, b, *run) for run in runs_of(data, gram)]
                yield _batch(out, RUNS)

    return each


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _texts(batch):
            out = []
            for data, asked in zip(part.column("data").to_pylist(), part.column("asked").to_pylist()):
                out += [(a["digit"], a["content"], data[a["lo"] : a["hi"] + WINDOW]) for a in asked]
            yield _batch(out, PARTS)


def window_digits(data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    hashes = block_hashes(data, DEPTH)
    return [hashes[starts + d] for d in range(0, WINDOW, DEPTH)]


def repeated_windows(data: np.ndarray, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The rows of `starts` whose windows still are in a group of two or more after the passes over all digits and the
    comparison of bytes; `group` deals them at first."""
    digits = window_digits(data, starts)
    rows = np.arange(len(group))
    for digit in digits:
        code = (group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ digit[rows]
        order = np.lexsort((digit[rows], group)) if len(rows) < 3 else np.argsort(code, kind="stable")
        ranked, who, own = code[order], group[order], digit[rows][order]
        new = np.concatenate([[True], (ranked[1:] != ranked[:-1]) | (who[1:] != who[:-1]) | (own[1:] != own[:-1])])
        name = np.cumsum(new) - 1
        stays = np.bincount(name, minlength=1)[name] > 1
        rows, group = rows[order][stays], name[stays]
        if not len(rows):
            return rows
    return rows[equal_windows(data, starts[rows], group)]


def equal_windows(data: np.ndarray, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which windows equal another one of their group in all bytes.

    Each is compared with the first of its group. Windows that follow each other, as their firsts do, share their bytes,
    so a stretch of them is compared once. A group with a difference is told apart by the bytes of its windows.
    """
    order = np.argsort(starts, kind="stable")
    at, who = starts[order], group[order]
    names, first, number = np.unique(who, return_index=True, return_inverse=True)
    other = at[first][number]
    cuts = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(other) != 1)]))
    ends = np.concatenate([cuts[1:], [len(at)]])
    sizes = ends - cuts + WINDOW - 1
    differs = np.zeros(len(names), bool)
    block = np.cumsum(sizes) // CHECKED
    for part in np.split(np.arange(len(cuts)), np.flatnonzero(np.diff(block)) + 1):
        inner = np.arange(sizes[part].sum()) - np.repeat(np.cumsum(sizes[part]) - sizes[part], sizes[part])
        wrong = data[np.repeat(at[cuts[part]], sizes[part]) + inner] != data[np.repeat(other[cuts[part]], sizes[part]) + inner]
        if wrong.any():
            for stretch in part[np.logical_or.reduceat(wrong, np.cumsum(sizes[part]) - sizes[part])]:
                differs[number[cuts[stretch] : ends[stretch]]] = True
    keep = np.ones(len(at), bool)
    doubtful = np.flatnonzero(differs[number])
    seen: dict[tuple[int, bytes], list[int]] = {}
    for row in doubtful.tolist():
        seen.setdefault((int(number[row]), content_name(data[at[row] : at[row] + WINDOW].tobytes())), []).append(row)
    for alike in seen.values():
        keep[alike] = len(alike) > 1
    out = np.zeros(len(at), bool)
    out[order] = keep
    return out


def _sort_contents(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    """Ranges of repeated windows of contents that come with all others of their digit."""
    data = np.frombuffer(b"".join(b for _, _, b in held), np.uint8)
    sizes = np.array([len(b) for _, _, b in held])
    begin = np.cumsum(sizes) - sizes
    number = sizes - WINDOW + 1
    starts = np.repeat(begin - np.cumsum(number) + number, number) + np.arange(number.sum())
    owner = np.repeat(np.arange(len(held)), number)
    name = np.unique([d for d, _, _ in held], return_inverse=True)[1]
    found = np.sort(repeated_windows(data, starts, name[owner]))
    if not len(found):
        return _batch([], MARKS)
    at, who = starts[found], owner[found]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(who) != 0)]))
    last = np.concatenate([new[1:], [len(found)]]) - 1
    out: dict[int, list] = {}
    for a, z in zip(new.tolist(), last.tolist()):
        w = int(who[a])
        out.setdefault(w, []).append({"first": int(at[a] - begin[w]), "last": int(at[z] - begin[w])})
    return _batch([(held[w][0], held[w][1], ranges) for w, ranges in out.items()], MARKS)


def _sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by digit; whole groups are gathered up to BATCH bytes and then sorted together."""
    held: list[tuple[int, int, bytes]] = []
    size, digit = 0, None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("digit", "content", "bytes"))):
            if row[0] != digit and size > BATCH:
                yield _sort_contents(held)
                held, size = [], 0
            digit = row[0]
            held.append(row)
            size += len(row[2])
    if held:
        yield _sort_contents(held)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _texts(batch):
            out = []
            for doc, data, spans in zip(*(part.column(c).to_pylist() for c in ("a", "data", "spans"))):
                kept, at, number = [], 0, 0
                for lo, hi in merged([(s["first"], s["last"] + WINDOW) for s in spans or ()]):
                    kept.append(data[at:lo])
                    at, number = hi, number + 1
                rest = b"".join([*kept, data[at:]])
                out.append((doc, len(data), len(data) - len(rest), number, hashlib.sha256(rest).hexdigest()))
            yield _batch(out, KEPT)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch become one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def _keyed(documents: DataFrame) -> DataFrame:
    data = F.coalesce("text", F.lit("")).cast("binary")
    name = F.substring(F.unhex(F.sha2(data, 256)), 1, 16)
    return documents.select(F.col("doc_id").alias("a"), name.alias("b"), data.alias("data"))


def _same(left: str, right: str):
    return F.col(f"{left}.a").eqNullSafe(F.col(f"{right}.a")) & (F.col(f"{left}.b") == F.col(f"{right}.b"))


def _gathered(hit: DataFrame) -> DataFrame:
    return hit.groupBy("a", "b").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def spans_of(items: DataFrame, level: int = 0) -> DataFrame:
    """(a, b, data: bytes) to (a, b, spans): ranges of the starts of repeated windows, for items that have any.

    One level is a pass over runs by a digit of GRAMS[level] bytes. A digit of up to LOCAL contents is sorted to full depth
    by one task; the contents of a hot one are the items of the next level, whose digits are longer. At the last level a
    digit is a whole window, and what counts is only how often it comes.
    """
    runs = materialize(items.mapInArrow(_runs(GRAMS[level]), RUNS), "runs")
    all_of_it = F.array(F.struct(F.col("lo").alias("first"), F.col("hi").alias("last")))
    if GRAMS[level] == WINDOW:
        twice = runs.groupBy("digit", "content").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("windows")).filter("windows > 1")
        return _gathered(runs.join(twice, ["digit", "content"]).select("a", "b", all_of_it.alias("spans")))
    first = F.min(F.struct("a", "b", "lo", "hi")).alias("first")
    contents = runs.groupBy("digit", "content").agg(F.count("*").alias("n"), F.max("tied").alias("tied"), first)
    contents = materialize(contents, "contents")
    sizes = contents.groupBy("digit").agg(F.count("*").alias("contents"), F.max("tied").alias("any_tied"))
    sizes = materialize(sizes.filter("contents > 1 OR any_tied").select("digit", "contents"), "digits")
    asked = contents.join(sizes, "digit").select("digit", "content", "first.*")
    asked = asked.groupBy("a", "b").agg(F.collect_list(F.struct("digit", "content", "lo", "hi")).alias("asked"))
    # An item that stands in several equal rows is fetched for each; its contents have n > 1 and are marked as a whole.
    fetched = items.alias("d").join(asked.alias("s"), _same("d", "s")).select("d.data", "s.asked").mapInArrow(_slices, PARTS)
    parts = materialize(fetched, "parts").join(sizes, "digit")
    cold = parts.filter(F.col("contents") <= LOCAL).select("digit", "content", "bytes")
    marks = cold.repartition("digit").sortWithinPartitions("digit").mapInArrow(_sort_groups, MARKS)
    hot = parts.filter(F.col("contents") > LOCAL)
    hot = hot.select(F.col("digit").alias("a"), F.col("content").alias("b"), F.col("bytes").alias("data")).repartition("a", "b")
    hot = materialize(hot, "hot")
    if not hot.isEmpty():
        deeper = spans_of(hot, level + 1)
        marks = marks.unionByName(deeper.select(F.col("a").alias("digit"), F.col("b").alias("content"), F.col("spans").alias("ranges")))
    whole = contents.filter("n > 1").select("digit", "content", F.lit(True).alias("whole"), F.lit(None).cast(RANGES).alias("ranges"))
    some = marks.select("digit", "content", F.lit(False).alias("whole"), "ranges")
    marks = materialize(whole.unionByName(some), "marks")
    moved = F.transform("ranges", lambda r: F.struct((F.col("lo") + r["first"]).alias("first"), (F.col("lo") + r["last"]).alias("last")))
    hit = runs.join(marks, ["digit", "content"])
    return _gathered(hit.select("a", "b", F.when(F.col("whole"), all_of_it).otherwise(moved).alias("spans")))


def remove_repeats(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that no repeated window covers.

    Null texts count as empty, and texts shorter than the window keep all. Rows are told apart by doc_id and text, and
    equal rows count as repeats of each other. Further columns are not read; an empty table gives no rows.
    """
    spans = materialize(spans_of(_keyed(documents)), "spans")
    joined = _keyed(documents).alias("d").join(spans.alias("s"), _same("d", "s"), "left").select("d.a", "d.data", "s.spans")
    return joined.mapInArrow(_remove, KEPT)


@query("op10_windows")
def op10_windows(spark, folder):
    return remove_repeats(table(spark, folder, "documents"))
