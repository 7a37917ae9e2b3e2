r"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of the output, one turn after the other: `<s>` role `[INST]` text `[/INST]</s>`. Neither role nor text holds a
control string (`<s>`, `</s>`, `[INST]`, `[/INST]`). A control string in content gets a backslash after its first character,
and one with backslashes there gets one more, so that taking one away gives the content back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.registry import query, table

TAG, MARK = r"<(\\*)(/?s>)", r"\[(\\*)(/?INST\])"
RAW = r"</?s>|\[/?INST\]"
TURN = r"(?s)^<s>(.*?)\[INST\](.*)\[/INST\]$"
END = "</s>"
PARSED = "struct<role:string,text:string>"


def escape(content: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(content, TAG, r"<\\$1$2"), MARK, r"[\\$1$2")


def unescape(content: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(content, r"<\\(\\*)(/?s>)", "<$1$2"), r"\[\\(\\*)(/?INST\])", "[$1$2")


def render(role: Column, text: Column, escaped: Column | bool) -> Column:
    flag = F.lit(escaped) if isinstance(escaped, bool) else escaped
    content = lambda c: F.when(flag, escape(c)).otherwise(c)
    return F.concat(F.lit("<s>"), content(role), F.lit("[INST]"), content(text), F.lit("[/INST]" + END))


def pieces(formatted: Column) -> Column:
    """The output cut after every turn; without the empty rest at the end."""
    parts = F.split(formatted, END, -1)
    return F.slice(parts, 1, F.size(parts) - 1)


def parse_piece(piece: Column) -> Column:
    """Role and text of one turn as they were before escaping; null where the piece does not fit the grammar."""
    role, text = F.regexp_extract(piece, TURN, 1), F.regexp_extract(piece, TURN, 2)
    fits = F.regexp_like(piece, F.lit(TURN)) & ~F.regexp_like(role, F.lit(RAW)) & ~F.regexp_like(text, F.lit(RAW))
    return F.when(fits, F.struct(unescape(role).alias("role"), unescape(text).alias("text"))).otherwise(F.lit(None).cast(PARSED))


def parse(formatted: Column) -> Column:
    return F.transform(pieces(formatted), parse_piece)


def loss_spans(formatted: Column, trained: str = "assistant") -> Column:
    """Character ranges (start, end exclusive) of the output that carry loss: the texts of one role, without marks."""
    kind = "struct<at:long,spans:array<struct<start:long,end:long>>>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans")).cast(kind)

    def step(state, piece):
        begin = (state["at"] + F.instr(piece, "[INST]") + 5).cast("long")
        after = state["at"] + F.length(piece)
        span = F.struct(begin.alias("start"), (after - 7).cast("long").alias("end"))
        mine = parse_piece(piece)["role"] == trained
        spans = F.when(mine, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((after + len(END)).cast("long").alias("at"), spans.alias("spans"))

    return F.aggregate(pieces(formatted), start, step)["spans"]


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, recovered (role and text of each turn, parsed from `formatted`): one row per conversation.

    Rows are ordered by turn, then role and text, nulls first; null roles and texts count as empty, rows without a conv_id
    are one conversation, repeated rows are turns of their own. Each turn is rendered as it is and parsed; where that does
    not give the turn back, its content is escaped. A whole conversation that still differs is escaped in all turns, and
    one that differs then would be an error. An empty table gives no rows, further columns are not read.
    """
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    plain = turns.select("conv_id", "turn", role, text)
    same = F.array(F.struct("role", "text")).eqNullSafe(parse(render(F.col("role"), F.col("text"), False)))
    marked = plain.withColumn("conflict", ~same)
    whole = marked.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "conflict"))).alias("turns"))
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    some = F.array_join(F.transform("turns", lambda t: render(t["role"], t["text"], t["conflict"])), "")
    every = F.array_join(F.transform("turns", lambda t: render(t["role"], t["text"], True)), "")
    tried = whole.withColumn("source", source).withColumn("formatted", some).withColumn("recovered", parse(F.col("formatted")))
    again = F.when(F.col("recovered").eqNullSafe(F.col("source")), F.col("formatted")).otherwise(every)
    done = tried.withColumn("formatted", again).withColumn("recovered", parse(F.col("formatted")))
    sure = F.when(F.col("recovered").eqNullSafe(F.col("source")), F.col("recovered")).otherwise(F.raise_error(F.lit("no round trip")))
    return done.select("conv_id", "formatted", sure.alias("recovered"))


def with_loss(formatted: DataFrame) -> DataFrame:
    """Adds the loss spans of every conversation and the text under them, unescaped."""
    mine = F.filter(F.transform(pieces(F.col("formatted")), parse_piece), lambda t: t["role"] == "assistant")
    return formatted.withColumn("loss", loss_spans(F.col("formatted"))).withColumn(
        "loss_text", F.array_join(F.transform(mine, lambda t: t["text"]), "")
    )


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *, len(role) + len(text) + 20 + len(regexp_extract_all(role, '<\\*/?s>|\[\\*/?INST\]')) + len(regexp_extract_all(text, '<\\*/?s>|\[\\*/?INST\]')) AS chars FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query("op5_chat", SQL)
def op5_chat(spark, folder):
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    told = F.array_join(F.transform("recovered", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return with_loss(format_conversations(turns)).select(
        "conv_id", F.size("recovered").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
