"""Best-fit packing of documents into token sequences by exact-complement hashing over their lengths.

Documents become pieces of at most `capacity` tokens. Only the count of each length decides which lengths share a sequence:
a table of lengths, and one of sums of two, find one, two or three pieces that fill a gap exactly, and a combination is
used as often as the counts allow; what finds no exact partners is packed best-fit. The result is a list of ranges of ranks
per length, which all pieces look up by their rank among the pieces of their length.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mnemolake.llm.registry import query, table
from mnemolake.session import materialize, sized

CAPACITY = 2048
END_ID = 0  # closes every document
# tiktoken takes quadratic time on long runs, and the special token is an id of its own: such texts go through tokenizers.
LONG_RUN = re.compile(r"\S{1000}|\s{1000}")


@cache
def encoders(path: str, ranks: str | None):
    """The tokenizer of a JSON file and, where the rank file of the same vocabulary is given, its faster equal."""
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    exact.no_truncation()
    exact.no_padding()
    if ranks is None:
        return exact, None
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as file:
        held = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return exact, tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=held, special_tokens={})


def vocabulary_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(text: str, paths: tuple[str, str | None]) -> np.ndarray:
    """Ids of a whole text as the tokenizers library gives them without special tokens added."""
    exact, fast = encoders(*paths)
    if fast and "<|" not in text and not LONG_RUN.search(text):
        return np.array(fast.encode_ordinary(text), "<u4")
    return np.array(exact.encode(text, add_special_tokens=False).ids, "<u4")


def token_pieces(
    documents: DataFrame, capacity: int = CAPACITY, keep_ids: bool = True, paths: tuple[str, str | None] | None = None
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, with `keep_ids` ids (little-endian 32-bit numbers), and part and nth: the
    task that read the document, and the piece's number among those of its length there.

    The result must be written before it is used, as part and nth belong to one run of a task. `paths`: the JSON file and
    rank file of a vocabulary (the latter may be None), by default the public byte-level one on each machine.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
    kinds = [to_arrow_type(documents.schema["doc_id"].dataType), pa.int32(), *[pa.int64()] * 5]
    fields = [documents.schema["doc_id"], T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in names[2:])]
    if keep_ids:
        names, kinds, fields = [*names, "ids"], [*kinds, pa.binary()], [*fields, T.StructField("ids", T.BinaryType())]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seen = paths or vocabulary_paths(), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                few = batch.slice(at, 64)
                rows = []
                for doc, text in zip(few.column("doc_id").to_pylist(), few.column("text").to_pylist()):
                    ids = np.append(encode(text or "", own), np.uint32(END_ID)).astype("<u4", copy=False)
                    start, piece = 0, 0
                    while start < len(ids):
                        end = start + ((len(ids) - start) % capacity or capacity)
                        held = ids[start:end].tobytes()
                        row = (doc, piece, start, end - start, zlib.crc32(held), part, seen[end - start])
                        seen[end - start] += 1
                        rows.append((*row, held) if keep_ids else row)
                        start, piece = end, piece + 1
                columns = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return documents.select("doc_id", "text").mapInArrow(each, T.StructType(fields))


class Plan:
    """Which ranks of each length go where. A row: length, first rank, number of sequences, pieces in each, first sequence,
    offset. The r-th piece of a row stands in sequence first + r // pieces, at offset + r % pieces * length."""

    def __init__(self, counts: dict[int, int], capacity: int, partners: int = 3):
        self.capacity, self.partners = capacity, partners  # pieces that may fill a gap exactly
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.used = np.zeros(capacity + 1, np.int64)
        self.sequences = 0
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.pair = np.zeros(capacity + 1, np.int64)  # per sum: the larger part of two available lengths, or 0
        lengths = np.flatnonzero(self.left)
        for a in lengths.tolist():
            small = lengths[(lengths <= min(a, capacity - a))]
            if len(small) and small[-1] == a and self.left[a] < 2:
                small = small[:-1]
            self.pair[small + a] = a
        if partners:
            self.exact()
        self.best_fit()

    def put(self, length: int, sequences: int, each: int, first: int, offset: int) -> None:
        self.rows.append((length, int(self.used[length]), sequences, each, first, offset))
        self.used[length] += sequences * each
        self.left[length] -= sequences * each

    def free(self, length: int, taken: Counter) -> bool:
        return self.left[length] > taken[length]

    def two(self, total: int, taken: Counter) -> list[int] | None:
        """Two available lengths of this sum, the larger one as large as can be; a stale entry of the table is renewed."""
        a = int(self.pair[total])
        if not a:
            return None
        if self.free(a, taken) and self.left[total - a] > taken[total - a] + (2 * a == total):
            return [a, total - a]
        low, high = (total + 1) // 2, min(total - 1, self.capacity)
        large = np.arange(high, low - 1, -1)
        good = (self.left[large] > 0) & (self.left[total - large] > (2 * large == total))
        self.pair[total] = large[good][0] if good.any() else 0
        for a in large[good].tolist():
            if self.free(a, taken) and self.left[total - a] > taken[total - a] + (2 * a == total):
                return [a, total - a]
        return None

    def filling(self, gap: int, taken: Counter) -> list[int] | None:
        """One, two or three available lengths whose sum is the gap."""
        if self.free(gap, taken):
            return [gap]
        if self.partners > 1 and (both := self.two(gap, taken)):
            return both
        if self.partners < 3:
            return None
        third = np.arange(gap - 1, 0, -1)
        for c in third[(self.left[third] > 0) & (self.pair[gap - third] > 0)].tolist():
            if self.free(c, taken):
                if rest := self.two(gap - c, taken + Counter((c,))):
                    return [c, *rest]
        return None

    def exact(self) -> None:
        """Sequences without a gap. From the largest length down: pieces that fit best are put beside it until one, two or
        three more fill the rest; the combination is used as often as all its lengths allow."""
        for head in range(self.capacity, 0, -1):
            while self.left[head]:
                taken, gap = Counter({head: 1}), self.capacity - head
                while gap:
                    if rest := self.filling(gap, taken):
                        taken.update(rest)
                        gap = 0
                        break
                    fits = np.flatnonzero(self.left[: gap + 1])[::-1]
                    nearest = next((n for n in fits.tolist() if self.free(n, taken)), None)
                    if nearest is None:
                        break
                    taken[nearest] += 1
                    gap -= nearest
                if gap:
                    break
                times, offset = min(int(self.left[n]) // k for n, k in taken.items()), 0
                for n, k in sorted(taken.items(), reverse=True):
                    self.put(n, times, k, self.sequences, offset)
                    offset += n * k
                self.sequences += times

    def best_fit(self) -> None:
        """What is left, longest first, each into the smallest gap that holds it; equal gaps are handled together."""
        gaps: list[int] = []  # gaps that open sequences have, in order
        open_at: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap to (first sequence, how many)

        def leave(gap: int, first: int, many: int) -> None:
            if gap and many:
                if not open_at[gap]:
                    insort(gaps, gap)
                open_at[gap].append((first, many))

        for length in range(self.capacity, 0, -1):
            while n := int(self.left[length]):
                at = bisect_left(gaps, length)
                if at < len(gaps):
                    gap = gaps[at]
                    first, many = open_at[gap].pop()
                    if not open_at[gap]:
                        gaps.pop(at)
                else:
                    gap, first = self.capacity, self.sequences
                    many = -(-n // (gap // length))
                    self.sequences += many
                each, offset = gap // length, self.capacity - gap
                whole = min(many, n // each)
                if whole:
                    self.put(length, whole, each, first, offset)
                    leave(gap - each * length, first, whole)
                    first, many = first + whole, many - whole
                if many and (n := min(int(self.left[length]), each)) and not whole:
                    self.put(length, 1, n, first, offset)
                    leave(gap - n * length, first, 1)
                    first, many = first + 1, many - 1
                if gap == self.capacity and many:  # the last new sequence, not full
                    self.put(length, 1, int(self.left[length]), first, 0)
                    leave(gap - self.rows[-1][3] * length, first, 1)
                elif many:
                    leave(gap, first, many)

    def arrays(self) -> np.ndarray:
        """Rows by length and first rank, as columns."""
        return np.array(sorted(self.rows) or np.empty((0, 6)), np.int64).reshape(-1, 6).T


def best_plan(counts: dict[int, int], capacity: int) -> Plan:
    """The plan with fewest sequences of those whose gaps take up to three, two or one exact partners. Where long pieces are
    many, exact triples can use up what others need; so that it is never worse than best-fit alone, that is tried too."""
    return min((Plan(counts, capacity, partners) for partners in (3, 2, 1, 0)), key=lambda p: p.sequences)


def place_udf(plan: np.ndarray):
    """(length, rank) to sequence_id and offset by the rows of a plan: at most 64 for each combination of lengths."""
    schema = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    key = plan[0] << 48 | plan[1]

    @F.pandas_udf(schema)
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        row = np.searchsorted(key, length.to_numpy() << 48 | rank.to_numpy(), "right") - 1
        size, first, _, each, sequence, offset = plan[:, row]
        r = rank.to_numpy() - first
        return pd.DataFrame({"sequence_id": sequence + r // each, "offset": offset + r % each * size})

    return place


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a written table of `token_pieces`; part and nth go.

    The driver sees `capacity` counts at most, one per length, and plans on them; pieces stay where they are and are not
    shuffled unless the counts per part and length are too many to send to every task. Equal pieces are interchangeable.
    """
    counts = materialize(pieces.groupBy("part", "length").agg((F.max("nth") + 1).alias("pieces")), "lengths")
    totals = {r["length"]: r["pieces"] for r in counts.groupBy("length").agg(F.sum("pieces").alias("pieces")).collect()}
    before = F.sum("pieces").over(Window.partitionBy("length").orderBy("part")) - F.col("pieces")
    begins = sized(counts.select("part", "length", before.alias("begin")))
    place = place_udf(best_plan(totals, capacity).arrays())
    joined = pieces.join(begins, ["part", "length"]).withColumn("at", place("length", F.col("begin") + F.col("nth")))
    return joined.select(*(c for c in pieces.columns if c not in ("part", "nth")), "at.*")


def pack_documents(
    documents: DataFrame, capacity: int = CAPACITY, keep_ids: bool = True, paths: tuple[str, str | None] | None = None
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, ids (with `keep_ids`), sequence_id, offset.

    A null or empty text is one piece with the closing id alone; a text longer than `capacity` is cut, its first piece being
    the shorter one. Rows that share a doc_id, or are equal, are packed each for itself. Further columns are not read, and an
    empty table gives no rows.
    """
    return pack(materialize(token_pieces(documents, capacity, keep_ids, paths), "pieces"), capacity)


@query("op13_packing")
def op13_packing(spark, folder):
    packed = pack_documents(table(spark, folder, "documents"), keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
