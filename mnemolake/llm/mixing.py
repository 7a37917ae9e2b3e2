"""Mixing sources to target weights: rates per source, whole copies plus one seeded Bernoulli copy per document, of several draws the nearest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemolake.llm.registry import query, table
from mnemolake.session import materialize

SEED = "mix-1"
MAX_RATE = 3
DRAWS = 8  # as many as a SHA-256 has parts of 32 bits
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, max_rate: int = MAX_RATE) -> DataFrame:
    """(source, size) per document to one row per source: source_size, weight, target, rate.

    Sources stand in order of their code points (bytes of UTF-8), null last, and weigh 1, 2, 3, 1, ... A target stops at
    `max_rate` times the source's size; what is above is shared again among the others by weight until none is above.
    Each round of sharing is one aggregation over the sources; the driver sees two totals of it. A source without
    words has target and rate 0.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # The rank needs one ordered list of sources; rows here are sources, already summed, never documents.
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    ranked = materialize(totals.withColumn("weight", (place % 3 + 1).cast("long")), "sources")
    limit = F.col("source_size") * max_rate
    whole = ranked.agg(F.sum("source_size")).first()[0] or 0
    capped, share, stopped = F.lit(False), 0.0, -1
    while True:
        row = ranked.agg(
            F.coalesce(F.sum(F.when(capped, limit)), F.lit(0)).alias("full"),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)).alias("open"),
            F.count(F.when(capped, 1)).alias("stopped"),
        ).first()
        if row["stopped"] == stopped or not row["open"]:
            break
        stopped, share = row["stopped"], (whole - row["full"]) / row["open"]
        capped = limit <= F.col("weight") * F.lit(share)
    target = F.least(limit.cast("double"), F.col("weight") * F.lit(share))
    return ranked.withColumn("target", target).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    )


def draws(key: Column, seed: str = SEED, number: int = DRAWS) -> Column:
    """Numbers in [0, 1) from the SHA-256 of seed and key, 32 bits each, the same in every run and engine."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("double") / float(2**32) for i in range(number)])


def copies(rate: Column, drawn: Column) -> Column:
    whole = F.floor(rate)
    return whole + F.when(drawn < rate - whole, 1).otherwise(0)


def source_rates(slim: DataFrame, max_rate: int = MAX_RATE, seed: str = SEED, number: int = 1) -> DataFrame:
    """(doc_id, source, size) per document to the sources of `source_targets` with `pick`, the draw that counts there.

    Every draw makes an independent Bernoulli copy of each document; a source uses the one of its `number` draws whose words
    come nearest to the target (the first of equals), so that few or uneven documents do not carry it far off. With one draw
    each copy is made with the probability of its rate's fraction. `of_source` names the sources.
    """
    if not 1 <= number <= DRAWS:
        raise ValueError(f"draws must be 1 to {DRAWS}")
    rates = materialize(source_targets(slim, max_rate), "rates").withColumnRenamed("source", "of_source")
    if number == 1:
        return rates.withColumn("pick", F.lit(0))
    near = slim.join(rates, F.col("source").eqNullSafe(F.col("of_source"))).withColumn("u", draws(F.col("doc_id"), seed, number))
    taken = [F.sum(F.col("size") * copies(F.col("rate"), F.col("u")[i])).alias(f"t{i}") for i in range(number)]
    sums = near.groupBy("source", "target").agg(*taken)
    off = F.array(*[F.abs(F.col(f"t{i}") - F.col("target")) for i in range(number)])
    picks = sums.select(F.col("source").alias("picked"), (F.array_position(off, F.array_min(off)) - 1).cast("int").alias("pick"))
    return materialize(rates.join(picks, F.col("of_source").eqNullSafe(F.col("picked"))).drop("picked"), "rates")


def plan_mix(documents: DataFrame, max_rate: int = MAX_RATE, seed: str = SEED, number: int = 1) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies, by the nearest of `number` draws.

    A null text has size 0, a null source is a source of its own, rows that share a doc_id draw the same numbers, an empty
    table gives an empty result; other columns of the input are not looked at.
    """
    slim = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    slim = materialize(slim, "sizes")
    rates = source_rates(slim, max_rate, seed, number)
    joined = slim.join(rates, F.col("source").eqNullSafe(F.col("of_source")))
    often = copies(F.col("rate"), F.element_at(draws(F.col("doc_id"), seed, number), F.col("pick") + 1))
    return joined.withColumn("copies", often).drop("of_source", "weight", "pick")


def mix(documents: DataFrame, max_rate: int = MAX_RATE, seed: str = SEED, number: int = 1) -> DataFrame:
    """The mixed documents, each as often as its copies say; the columns of the input stay as they are."""
    slim = materialize(documents.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    rates = source_rates(slim, max_rate, seed, number)
    rates = rates.select(F.col("of_source").alias("__source"), F.col("rate").alias("__rate"), F.col("pick").alias("__pick"))
    joined = documents.join(rates, documents["source"].eqNullSafe(rates["__source"]))
    often = copies(F.col("__rate"), F.element_at(draws(F.col("doc_id"), seed, number), F.col("__pick") + 1))
    return (
        joined.withColumn("__often", often)
        .filter("__often > 0")
        .withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__often"))))
        .select(*documents.columns)
    )


SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS weight FROM totals
), fill AS (
  SELECT 0 AS step, (SELECT CAST(sum(source_size) AS DOUBLE) / CAST(sum(weight) AS DOUBLE) FROM ranked) AS share
  UNION ALL
  SELECT step + 1, (
    SELECT CAST(sum(source_size) - coalesce(sum(3 * source_size) FILTER (WHERE 3 * source_size <= weight * share), 0) AS DOUBLE)
         / CAST(sum(weight) FILTER (WHERE NOT 3 * source_size <= weight * share) AS DOUBLE) FROM ranked)
  FROM fill WHERE step < 60
), settled AS (SELECT max(share) AS share FROM fill
), rates AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), weight * share) AS target,
    CASE WHEN source_size > 0 THEN least(CAST(3 * source_size AS DOUBLE), weight * share) / source_size ELSE 0.0 END AS rate
  FROM ranked, settled
), drawn AS (
  SELECT d.doc_id, d.source, d.size, r.source_size, r.target, i,
    d.size * (floor(rate) + CASE WHEN CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 8 * i + 1, 8) AS BIGINT)
      / 4294967296.0 < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
  FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source, (SELECT unnest(range({DRAWS})) AS i)
), picks AS (
  SELECT source, arg_min(i, {{'off': off, 'i': i}}) AS pick
  FROM (SELECT source, i, abs(sum(taken) - any_value(target)) AS off FROM drawn GROUP BY source, i) GROUP BY source
)
SELECT d.doc_id, d.size, d.source_size, d.target, CAST(d.taken AS BIGINT) AS taken
FROM drawn d JOIN picks p ON d.source IS NOT DISTINCT FROM p.source AND d.i = p.pick
"""


@query("op8_mix", SQL)
def op8_mix(spark, folder):
    plan = plan_mix(table(spark, folder, "documents"), number=DRAWS)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
