"""Secret scans as an incremental blob ledger, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.registry import query, table
from mnemolake.session import materialize

# Kind, pattern, group whose length counts, least length. The first three are the base rules.
RULES = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    "private": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
}
BASE = ("assign", "access", "hex")
RULE_VERSION = 1
# Text that must occur for a rule to match at all; a plain search that spares most texts the pattern.
HINTS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("AKIA",), "github": ("gh",),
    "private": ("-----BEGIN ",),
}
NO_SPANS = "array<struct<kind:string,start:long,end:long>>"


def blob_id(text: Column) -> Column:
    """SHA-256 of the text in UTF-8; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def rule_spans(text: Column, kind: str) -> Column:
    """The rule's spans in code points, leftmost and without overlap.

    The text is split at the matches; a match starts after the pieces and the matches before it. Matches whose counted
    group is too short are dropped only then, as they use up the text that they cover.
    """
    pattern, group, least = RULES[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.transform(
        F.arrays_zip(
            F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
            F.transform(found, F.length).alias("size"),
            F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length).alias("counted"),
        ),
        lambda x: F.struct(
            x["gap"].cast("long").alias("gap"), x["size"].cast("long").alias("size"), x["counted"].cast("long").alias("counted")
        ),
    )
    none = F.lit(None).cast("array<struct<start:long,end:long,counted:long>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.coalesce(none, F.array().cast("array<struct<start:long,end:long,counted:long>>")).alias("spans"))

    def step(state, x):
        begin = state["at"] + x["gap"]
        span = F.struct(begin.alias("start"), (begin + x["size"]).alias("end"), x["counted"].alias("counted"))
        return F.struct((begin + x["size"]).alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    spans = F.aggregate(F.filter(parts, lambda x: x["size"].isNotNull()), start, step)["spans"]
    spans = F.transform(
        F.filter(spans, lambda x: x["counted"] >= least),
        lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")),
    )
    may = F.regexp_like(text, F.lit(pattern))
    if kind in HINTS:
        within = F.lower(text) if kind == "assign" else text
        hinted = F.lit(False)
        for hint in HINTS[kind]:
            hinted = hinted | F.contains(within, F.lit(hint))
        may = hinted & may
    return F.when(may, spans).otherwise(F.array().cast(NO_SPANS))


def scan(blobs: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(blob, text) to (blob, spans): the spans of all kinds by start, then kind as listed."""
    every = F.concat(*[rule_spans(F.coalesce("text", F.lit("")), k) for k in kinds])
    rank = F.create_map(*[x for i, k in enumerate(RULES) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(every, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    ordered = F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return blobs.select("blob", ordered.alias("spans"))


def update_ledger(
    versions: DataFrame, ledger: DataFrame | None = None, kinds: tuple[str, ...] = tuple(RULES), rule_version: int = RULE_VERSION
) -> DataFrame:
    """New rows (blob, rule_version, spans) for the blobs of `versions` (text) that this rule version has not seen.

    Every text, of whatever path and version, is addressed by its content, so copies are scanned once. Copies meet on
    one row before the shuffle. Null texts are the empty blob; blobs without a finding get a row too, with no spans.
    """
    texts = versions.select(blob_id(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    if ledger is not None:
        seen = ledger.filter(F.col("rule_version") == rule_version).select("blob").distinct()
        texts = texts.join(seen, "blob", "left_anti")
    blobs = texts.groupBy("blob").agg(F.first("text").alias("text"))
    return scan(blobs, kinds).withColumn("rule_version", F.lit(rule_version)).select("blob", "rule_version", "spans")


def findings(versions: DataFrame, ledger: DataFrame, key: str = "doc_id", rule_version: int = RULE_VERSION) -> DataFrame:
    """(key, blob, spans) for every row of `versions`: the ledger's spans on all paths that hold the blob.

    Rows that share a key or a text get a row each; a blob not in the ledger has no spans. Other columns are not read."""
    known = ledger.filter(F.col("rule_version") == rule_version).select("blob", "spans")
    paths = versions.select(key, blob_id(F.col("text")).alias("blob"))
    return paths.join(known, "blob", "left").select(key, "blob", F.coalesce("spans", F.array().cast(NO_SPANS)).alias("spans"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(documents: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """The documents with every secret in the text replaced by `[secret]`; all rows and columns stay, n_chars follows.

    Overlapping spans count as one. Texts without a finding, null ones too, stay as they are."""
    if ledger is None:
        ledger = materialize(update_ledger(documents), "ledger")
    found = ledger.filter(F.size("spans") > 0).select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans"))
    marked = documents.withColumn("__own", blob_id(F.col("text")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(state, s):
        gap = s["start"] - state["at"]
        text = F.col("text")
        kept = F.when(gap >= 0, F.concat(state["out"], text.substr((state["at"] + 1).cast("int"), F.greatest(gap, F.lit(0)).cast("int")), F.lit("[secret]")))
        return F.struct(kept.otherwise(state["out"]).alias("out"), F.greatest(state["at"], s["end"]).alias("at"))

    done = F.aggregate("__spans", start, step, lambda x: F.concat(x["out"], F.col("text").substr((x["at"] + 1).cast("int"), F.length("text"))))
    joined = marked.join(found, F.col("__own") == F.col("__blob"), "left")
    out = joined.withColumn("text", F.when(F.col("__spans").isNotNull(), done).otherwise(F.col("text")))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*documents.columns)


def _sql_spans(kind: str) -> str:
    pattern, group, least = RULES[kind]
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, text, '{kind}' AS kind, {list(RULES).index(kind)} AS rank,
      string_split_regex(text, '{quoted}') AS gaps, regexp_extract_all(text, '{quoted}', 0) AS whole,
      regexp_extract_all(text, '{quoted}', {group}) AS counted, {least} AS least FROM docs"""


SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
matched AS ({' UNION ALL '.join(_sql_spans(k) for k in RULES)}),
each AS (SELECT doc_id, kind, rank, least, gaps, whole, counted, unnest(range(1, len(whole) + 1)) AS i FROM matched),
placed AS (
  SELECT doc_id, kind, rank, least, len(counted[i]) AS counted,
    list_sum([len(x) FOR x IN gaps[1:i]]) + coalesce(list_sum([len(x) FOR x IN whole[1:i - 1]]), 0) AS s,
    len(whole[i]) AS size FROM each
), spans AS (
  SELECT doc_id, kind, rank, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + size AS BIGINT) AS span, s FROM placed WHERE counted >= least
), sums AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
    count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    string_agg(span, ',' ORDER BY s, rank) FILTER (WHERE rank < 3) AS base, string_agg(span, ',' ORDER BY s, rank) AS spans
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN sums USING (doc_id)
"""


@query("op7_secrets", SQL)
def op7_secrets(spark, folder):
    documents = table(spark, folder, "documents")
    ledger = materialize(update_ledger(documents), "ledger")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return findings(documents, ledger).select(
        "doc_id", *[number(k) for k in BASE], F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans")
    )
