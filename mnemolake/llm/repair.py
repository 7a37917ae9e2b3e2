"""Conversation structure repair: cheapest edits over a suffix-shared automaton of role and fault signatures.

A conversation is a word of letters, one per row, for its role's initial and its fault. The words of all conversations are
sorted from their ends, so those with a common suffix stand together and share its nodes: a node is one distinct suffix.
Cost-to-go and the first edit of the best audit suffix are computed once per node and grammar state; each conversation
only walks its edits. Memory is one word and its nodes, however many conversations there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mnemolake.llm.registry import query, table
from mnemolake.session import materialize

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
# States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a. The first and the last may end.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT_TURN = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}  # a user or assistant turn comes
ROLES = {AFTER_U: "user", AFTER_A: "assistant"}
INITIALS = {"s": {START: AFTER_S}, "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}}
GONE = "x"  # the letter of a row that must be deleted; others are s, u, a, o, as capitals where the text is truncated
SPACE = r"\x20\x09-\x0D"

Choice = tuple[int, str, int, int]  # cost-to-go, first edit, state after it, rows it consumes
STATS = "gaps long, blank long, duplicate long, truncated long, illegal long"


def _inserting(own: dict[int, Choice]) -> list[Choice]:
    """The best choice of each state, an insertion before the row included. First edits differ, so they settle ties."""
    best = dict(own)
    for _ in range(3):
        for state in range(4):
            after = best.get(NEXT_TURN[state])
            if after:
                tried = (after[0] + INSERT_COST, INSERT, NEXT_TURN[state], 0)
                best[state] = min(best.get(state, tried), tried)
    return [best[s] for s in range(4)]


END_NODE = _inserting({START: (0, "", START, 0), AFTER_A: (0, "", AFTER_A, 0)})


def node(letter: str, rest: list[Choice]) -> list[Choice]:
    """The node of a suffix: its first letter and the node of what follows, to the best choice of each grammar state."""
    own = {}
    for state in range(4):
        tried = [(rest[state][0] + DELETE_COST, DELETE, state, 1)]
        if letter != GONE:
            extra = TRUNCATED_COST if letter.isupper() else 0
            new = NEXT_TURN[state]
            tried.append((rest[new][0] + REROLE_COST + extra, REROLE, new, 1))
            kept = INITIALS.get(letter.lower(), {}).get(state)
            if kept is not None:
                tried.append((rest[kept][0] + extra, KEEP, kept, 1))
        own[state] = min(tried)
    return _inserting(own)


class SuffixNodes:
    """Nodes along the last word; a word that comes in order of its end keeps those of the suffix it shares with it."""

    def __init__(self):
        self.word, self.nodes = "", [END_NODE]

    def read(self, word: str) -> tuple[int, str]:
        """(cost, audit) of a word."""
        old, n = self.word, len(word)
        shared, most = 0, min(len(old), n)
        while shared < most and old[len(old) - 1 - shared] == word[n - 1 - shared]:
            shared += 1
        del self.nodes[shared + 1 :]
        for at in range(shared, n):
            self.nodes.append(node(word[n - 1 - at], self.nodes[-1]))
        self.word = word
        edits, left, state = [], n, START
        while True:
            _, edit, state, step = self.nodes[left][state]
            if not edit:
                return self.nodes[n][START][0], "".join(edits)
            edits.append(edit)
            left -= step


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _out(rows: Iterator[tuple], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def plain_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text; a null role or text is one space."""
    space = F.lit(" ")
    return turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
    )


def damage(turns: DataFrame) -> DataFrame:
    """Damage `plain_turns` by CRC-32 of `conv_id:turn` modulo 20. A dropped row stays as one whose role and text are null,
    so that its conversation is still known."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    code = F.crc32(key.cast("binary")) % 20
    text = F.when(code == 0, None).when(code == 1, "").when(code == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(code == 0, None).when(code == 4, "user").otherwise(F.col("role"))
    changed = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(code == 3, 2).otherwise(1).alias("often"))
    return changed.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("often")))).drop("often", "copy")


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{SPACE}]")


def is_truncated(text: Column) -> Column:
    return ~text.rlike(rf"[.!?][{SPACE}]*\z")


PLACE = ("turn", "role", "text")  # ascending, nulls first


def marked_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, fault: blank, duplicate, truncated (a row's first one) or null; in order, and with each
    conversation's rows together. One exchange serves the search for duplicates and the order."""
    same = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    nth = turns.repartition("conv_id").withColumn("nth", F.row_number().over(same))
    fault = (
        F.when(F.col("role").isNull(), None).when(is_blank(F.col("text")), "blank").when(F.col("nth") > 1, "duplicate")
        .when(is_truncated(F.col("text")), "truncated")
    )
    return nth.withColumn("fault", fault).sortWithinPartitions("conv_id", *PLACE, "nth").drop("nth")


def signatures(marked: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal and signature: one row per conversation of `marked_turns`."""
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    slim = marked.select("conv_id", "turn", initial.alias("initial"), "fault", F.when(F.col("role").isNotNull(), letter).alias("letter"))
    schema = T.StructType([marked.schema["conv_id"]]).simpleString()[7:-1].replace(":", " ", 1)
    ids = _arrow_type(marked, "conv_id")
    fields = pa.schema([("conv_id", ids), *((c.split()[0], pa.int64()) for c in STATS.split(", ")), ("signature", pa.string())])

    def told(rows: Iterator[tuple]) -> tuple:
        """One conversation from (conv_id, turn, initial, fault, letter) of its rows in order."""
        faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        word, before, first, last, distinct, illegal = [], None, None, None, 0, 0
        for _, turn, initial, fault, letter in rows:
            if letter is None:
                continue
            if fault:
                faults[fault] += 1
            illegal += before is not None and before + initial not in ("su", "ua", "au")
            before = initial
            if turn is not None:
                distinct += turn != last
                first, last = turn if first is None else first, turn
            word.append(letter)
        gaps = 0 if first is None else last - first + 1 - distinct
        return gaps, *faults.values(), illegal, "".join(word)

    def each(batches):
        def rows():
            for (conv,), group in groupby(_stream(batches), key=lambda r: r[:1]):
                yield conv, *told(group)

        return _out(rows(), fields)

    return slim.mapInArrow(each, f"{schema}, {STATS}, signature string")


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def with_audit(signed: DataFrame) -> DataFrame:
    """Adds cost and audit to `signatures`. Words go by range of their reversed letters, equal words by conv_id too, so a
    word that most conversations share is dealt out as well."""
    types = signed.schema
    ids = _arrow_type(signed, "conv_id")
    names = signed.columns
    fields = pa.schema(
        [("conv_id", ids), *((c.split()[0], pa.int64()) for c in STATS.split(", ")), ("signature", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]
    )

    def each(batches):
        nodes, word = SuffixNodes(), names.index("signature")
        return _out(((*row, *nodes.read(row[word])) for row in _stream(batches)), fields)

    ordered = signed.withColumn("ending", F.reverse("signature")).repartitionByRange("ending", "conv_id")
    wide = T.StructType([*types.fields, T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())])
    return ordered.sortWithinPartitions("ending").drop("ending").mapInArrow(each, wide)


def _edited(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows of (conv_id, audit or null, role, text), the audit first, to (conv_id, edit, role, text) of every edit."""
    conv, edits, state = None, iter(()), START

    def inserts():
        nonlocal state
        for edit in edits:
            if edit != INSERT:
                return edit
            state = NEXT_TURN[state]
            pending.append((conv, INSERT, ROLES[state], ""))
        return None

    pending: list[tuple] = []
    for row in rows:
        if row[1] is not None:
            inserts()
            yield from pending
            pending.clear()
            conv, edits, state = row[0], iter(row[1]), START
            yield conv, "", None, None
            continue
        edit = inserts()
        yield from pending
        pending.clear()
        role = row[2]
        if edit == REROLE:
            state = NEXT_TURN[state]
            role = ROLES[state]
        elif edit == KEEP:
            state = INITIALS[role[0]][state]
        yield conv, edit, role, row[3]
    inserts()
    yield from pending


def _with_rows(audits: DataFrame, turns: DataFrame) -> DataFrame:
    """The audit of every conversation, followed by its rows in order."""
    head = audits.select("conv_id", "audit", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    rows = turns.filter("role IS NOT NULL").select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "text")
    both = head.unionByName(rows).repartition("conv_id")
    return both.sortWithinPartitions("conv_id", F.col("audit").isNull(), *PLACE).select("conv_id", "audit", "role", "text")


def repaired_turns(audits: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit, role, text: the turns of every conversation after its edits, deleted rows left out."""
    ids = _arrow_type(turns, "conv_id")
    fields = pa.schema([("conv_id", ids), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def each(batches):
        def rows():
            place = 0
            for conv, edit, role, text in _edited(_stream(batches)):
                if not edit:
                    place = 0
                elif edit != DELETE:
                    yield conv, place, edit, role, text
                    place += 1

        return _out(rows(), fields)

    own = T.StructType([turns.schema["conv_id"], T.StructField("place", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("edit", "role", "text"))])
    return _with_rows(audits, turns).mapInArrow(each, own)


def repaired_digests(audits: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its repaired `role:text`, newline-joined; rows go through the digest one by one."""
    ids = _arrow_type(turns, "conv_id")
    fields = pa.schema([("conv_id", ids), ("repaired_sha256", pa.string())])

    def each(batches):
        def rows():
            now, sha, first = None, None, True
            for conv, edit, role, text in _edited(_stream(batches)):
                if not edit:
                    if sha:
                        yield now, sha.hexdigest()
                    now, sha, first = conv, hashlib.sha256(), True
                elif edit != DELETE:
                    sha.update(b"" if first else b"\n")
                    sha.update(f"{role}:{text}".encode())
                    first = False
            if sha:
                yield now, sha.hexdigest()

        return _out(rows(), fields)

    own = T.StructType([turns.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])
    return _with_rows(audits, turns).mapInArrow(each, own)


def plan_repairs(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, signature, cost, audit.

    `turns` as `plain_turns` or `damage` give them. Rows are ordered by turn (nulls first), then role and text, so ties do
    not matter; repeated rows are duplicates. Rows without a conv_id are one conversation. A conversation whose rows are all
    dropped gets zeros and an empty audit. Further columns are not read; an empty table gives no rows. A text is looked at
    whole, whatever its length; of a conversation only one letter a row is held at a time.
    """
    # Written once: the range exchange looks at its input twice.
    return with_audit(materialize(signatures(marked_turns(turns)), "signatures"))


SQL = r"""
WITH RECURSIVE plain AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), crc_table AS (
  SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM (SELECT unnest(range(256)) AS b)
), crc_list AS (SELECT list(CAST(v AS BIGINT) ORDER BY b) AS t FROM crc_table
), coded AS (
  SELECT k, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda c, x: xor(c >> 8, t[1 + xor(c & 255, x)])), 4294967295) % 20 AS code
  FROM (SELECT DISTINCT k FROM plain), crc_list
), damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy
  FROM plain JOIN coded USING (k) WHERE code <> 0
), counted AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM damaged
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS p, count(*) OVER (PARTITION BY conv_id) AS rows,
    left(role, 1) AS f FROM counted
), marked AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN nth > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault,
    lag(f) OVER (PARTITION BY conv_id ORDER BY p) AS before FROM placed
), convs AS (SELECT row_number() OVER () AS c, conv_id, rows FROM (SELECT DISTINCT conv_id, rows FROM placed)
), lines AS (
  SELECT c, p, f, fault IN ('b', 'd') AS gone, CASE WHEN fault = 't' THEN 5 ELSE 0 END AS extra, role, text
  FROM marked m JOIN convs v ON m.conv_id IS NOT DISTINCT FROM v.conv_id
), -- a value is cost (12 digits), audit, chr(1), repaired turns with chr(10) before each
walk AS (
  SELECT c, rows AS p, '000000000000' || chr(1) AS s0, '000000000010II' || chr(1) || chr(10) || 'user:' || chr(10) || 'assistant:' AS s1,
    '000000000005I' || chr(1) || chr(10) || 'assistant:' AS s2, '000000000000' || chr(1) AS s3 FROM convs
  UNION ALL
  SELECT c, p, least(q0, i2u), least(q1, i2u), least(q2, i3a), least(q3, i2u)
  FROM (
    SELECT *, format('{:012d}', CAST(left(least(q2, i3), 12) AS BIGINT) + 5) || 'I' || replace(substr(least(q2, i3), 13), chr(1), chr(1) || chr(10) || 'user:') AS i2u,
      i3 AS i3a
    FROM (
      SELECT *, format('{:012d}', CAST(left(q3, 12) AS BIGINT) + 5) || 'I' || replace(substr(q3, 13), chr(1), chr(1) || chr(10) || 'assistant:') AS i3
      FROM (
        SELECT c, p, least(d0, r0, CASE WHEN NOT gone AND f = 's' THEN k1 WHEN NOT gone AND f = 'u' THEN k2 ELSE '~' END) AS q0,
          least(d1, r0, CASE WHEN NOT gone AND f = 'u' THEN k2 ELSE '~' END) AS q1,
          least(d2, r3, CASE WHEN NOT gone AND f = 'a' THEN k3 ELSE '~' END) AS q2,
          least(d3, r0, CASE WHEN NOT gone AND f = 'u' THEN k2 ELSE '~' END) AS q3
        FROM (
          SELECT w.c, w.p - 1 AS p, l.f, l.gone,
            format('{:012d}', CAST(left(s0, 12) AS BIGINT) + 2) || 'D' || substr(s0, 13) AS d0,
            format('{:012d}', CAST(left(s1, 12) AS BIGINT) + 2) || 'D' || substr(s1, 13) AS d1,
            format('{:012d}', CAST(left(s2, 12) AS BIGINT) + 2) || 'D' || substr(s2, 13) AS d2,
            format('{:012d}', CAST(left(s3, 12) AS BIGINT) + 2) || 'D' || substr(s3, 13) AS d3,
            CASE WHEN gone THEN '~' ELSE format('{:012d}', CAST(left(s2, 12) AS BIGINT) + 1 + extra) || 'R' || replace(substr(s2, 13), chr(1), chr(1) || chr(10) || 'user:' || text) END AS r0,
            CASE WHEN gone THEN '~' ELSE format('{:012d}', CAST(left(s3, 12) AS BIGINT) + 1 + extra) || 'R' || replace(substr(s3, 13), chr(1), chr(1) || chr(10) || 'assistant:' || text) END AS r3,
            format('{:012d}', CAST(left(s1, 12) AS BIGINT) + extra) || 'K' || replace(substr(s1, 13), chr(1), chr(1) || chr(10) || role || ':' || text) AS k1,
            format('{:012d}', CAST(left(s2, 12) AS BIGINT) + extra) || 'K' || replace(substr(s2, 13), chr(1), chr(1) || chr(10) || role || ':' || text) AS k2,
            format('{:012d}', CAST(left(s3, 12) AS BIGINT) + extra) || 'K' || replace(substr(s3, 13), chr(1), chr(1) || chr(10) || role || ':' || text) AS k3
          FROM walk w JOIN lines l ON w.c = l.c AND w.p = l.p WHERE w.p > 0
        )
      )
    )
  )
), best AS (SELECT conv_id, s0, instr(s0, chr(1)) AS cut FROM walk JOIN convs USING (c) WHERE p = 0
), stats AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
    count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL AND before || f NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(CAST(left(s0, 12) AS BIGINT), 0) AS cost, coalesce(substr(s0, 13, cut - 13), '') AS audit,
  sha256(coalesce(substr(s0, cut + 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best b ON o.conv_id IS NOT DISTINCT FROM b.conv_id
LEFT JOIN stats s ON o.conv_id IS NOT DISTINCT FROM s.conv_id
"""


@query("op12_repair", SQL)
def op12_repair(spark, folder):
    turns = damage(plain_turns(table(spark, folder, "conversations")))
    plans = materialize(plan_repairs(turns), "audits")
    digests = repaired_digests(plans.select("conv_id", "audit"), turns).withColumnRenamed("conv_id", "of_conv")
    joined = plans.join(digests, F.col("conv_id").eqNullSafe(F.col("of_conv")))
    return joined.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
