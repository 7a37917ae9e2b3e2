"""SimHash near-dedup: fingerprints of word shingles, joined through Golay codewords of their segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mnemolake.llm.components import connected_components
from mnemolake.llm.golay import nearby
from mnemolake.llm.registry import query, table
from mnemolake.session import materialize

BITS, SEGMENTS, DISTANCE = 64, 4, 3
SHINGLE, SEED = 3, 42
BLOCK = 4096  # fingerprints of one key that are compared in one piece
_KEYS = T.StructType([T.StructField("key", T.LongType()), T.StructField("fp", T.LongType())])
_LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def simhash(text: str | None, words: int = SHINGLE) -> int:
    """The fingerprint of a whole text: a bit is 1 if it is set in over half of the shingles' hashes."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return 0
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[: max(1, len(parts) - words + 1)], ends[words - 1 :] if len(parts) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first.tolist(), last.tolist())), np.uint64, len(first))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        block = hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    """The 64 bits as a signed long."""
    return pd.Series(np.array([simhash(t) for t in texts], np.uint64).view(np.int64))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def segment_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the row of each, for fingerprints as unsigned 64-bit numbers.

    Four segments of 16 bits; a key is one segment as it is and the codeword indices near the next one, in a ring. Three
    errors leave some segment free of errors whose follower has at most one: with errors in all others each has one; else
    two segments are free, and not both can be followed by a segment with two errors. The pair then shares an index.
    """
    part = [(fps >> np.uint64(16 * i) & np.uint64(0xFFFF)).astype(np.int64) for i in range(SEGMENTS)]
    keys, rows = [], []
    for i in range(SEGMENTS):
        near = nearby()[part[(i + 1) % SEGMENTS]]
        row, slot = np.nonzero(near >= 0)
        keys.append((i << 28) | (part[i][row] << 12) | near[row, slot])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy()
        for at in range(0, len(fps), 20_000):
            own = fps[at : at + 20_000]
            keys, rows = segment_keys(own.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own[rows])], names=["key", "fp"])


def forest(fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the fingerprints within `distance`; at most one link a fingerprint, never all pairs."""
    left, right, rest = [], [], fps
    front = fps[:0]
    while len(rest):
        if not len(front):
            front, rest = rest[:1], rest[1:]
            continue
        now, front = front[:256], front[256:]
        close = np.bitwise_count(now[:, None] ^ rest[None, :]) <= distance
        hit = close.any(axis=0)
        found = rest[hit]
        left.append(found)
        right.append(now[close.argmax(axis=0)[hit]])
        front, rest = np.concatenate([front, found]), rest[~hit]
    none = fps[:0]
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; a group that goes on in the next batch is held back, and groups have at most 2 BLOCK."""
    held: list[np.ndarray] = []

    def links(group: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.any(group[1:] != group[:-1], axis=1)) + 1
        start, size = np.concatenate([[0], edge]), np.diff(np.concatenate([[0], edge, [len(fps)]]))
        two = start[size == 2]
        near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= DISTANCE
        a, b = [fps[two][near]], [fps[two + 1][near]]
        for s, n in zip(start[size > 2], size[size > 2]):
            x, y = forest(fps[s : s + n])
            a.append(x)
            b.append(y)
        ends = [pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)]
        return pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    for batch in batches:
        columns = [batch.column(n).to_numpy() for n in ("key", "low", "high", "fp")]
        held = [np.concatenate([x, y]) for x, y in zip(held, columns)] if held else columns
        group = np.stack(held[:3], axis=1)
        whole = len(group) - int(np.argmax(np.any(group[::-1] != group[-1], axis=1))) if np.any(group != group[-1]) else 0
        if whole:
            yield links(group[:whole], held[3][:whole].view(np.uint64))
            held = [x[whole:] for x in held]
    if held and len(held[0]):
        yield links(np.stack(held[:3], axis=1), held[3].view(np.uint64))


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect the different fingerprints `fp` as all pairs within DISTANCE bits would.

    Keys of one fingerprint leave; the others form groups, of which one above BLOCK is dealt to pairs of blocks by a hash,
    so no task holds a whole hot key. Each group gives a spanning forest of verified links.
    """
    keys = materialize(fps.select("fp").mapInArrow(_expand, _KEYS), "keys")
    shared = keys.groupBy("key").count().filter("count > 1")
    parts = F.ceil(F.col("count") / BLOCK).cast("long")
    slot = F.pmod(F.xxhash64("fp"), F.col("parts"))
    dealt = keys.join(shared, "key").withColumn("parts", parts).withColumn("slot", slot)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    dealt = dealt.withColumn("other", other).select(
        "key", F.least("slot", "other").alias("low"), F.greatest("slot", "other").alias("high"), "fp"
    )
    grouped = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return grouped.mapInArrow(_verify, _LINKS)


def fingerprint_classes(prints: DataFrame) -> DataFrame:
    """(doc_id, fp) to (fp, root, component_id): a fingerprint that names the class, and the smallest doc_id in it."""
    least = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    roots = connected_components(fingerprint_links(least)).withColumnRenamed("node", "fp")
    rooted = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(classes, "root").select("fp", "root", "component_id")


def near_classes(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, fp, root (a fingerprint that names the class), component_id.

    Null and word-less texts have fingerprint zero and link like any other. Rows that share a doc_id are classed each by
    its own text; a null doc_id is never the smallest unless its class has no other. An empty table gives no rows, further
    columns are not read.
    """
    prints = materialize(documents.select("doc_id", fingerprint(F.col("text")).alias("fp")), "prints")
    return prints.join(materialize(fingerprint_classes(prints), "classes"), "fp").select("doc_id", "fp", "root", "component_id")


def dedup(documents: DataFrame) -> DataFrame:
    """The documents with one row of each class kept: that of the smallest doc_id (then fingerprint, then text hash).

    A class of null ids keeps one of them too. The columns of the input stay as they are."""
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp")).alias("first")
    keep = materialize(near_classes(documents).groupBy("root").agg(first).select("first.doc_id", "first.fp"), "keep")
    keep = keep.select(F.col("doc_id").alias("__id"), F.col("fp").alias("__keep"))
    marked = documents.withColumn("__fp", fingerprint(F.col("text")))
    joined = marked.join(keep, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__fp") == F.col("__keep")))
    order = Window.partitionBy("doc_id", "__fp").orderBy(F.xxhash64("text"))
    return joined.withColumn("__n", F.row_number().over(order)).filter("__n = 1").select(*documents.columns)


@query("op2_simhash")
def op2_simhash(spark, folder):
    classes = near_classes(table(spark, folder, "documents"))
    return classes.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
