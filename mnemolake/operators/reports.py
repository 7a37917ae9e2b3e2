"""Dashboard roll-ups and run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bounds of the latency histogram, in seconds.
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def _quantile(q: float, total: Column) -> Column:
    """Quantile of a cumulative histogram: linear inside the bucket that holds the rank."""
    rank = q * total
    out = F.lit(LATENCY_BUCKETS[-1])
    for i in reversed(range(len(LATENCY_BUCKETS))):
        low, below = (LATENCY_BUCKETS[i - 1], F.col(f"le_{i - 1}")) if i else (0.0, F.lit(0))
        inside = low + (LATENCY_BUCKETS[i] - low) * (rank - below) / (F.col(f"le_{i}") - below)
        out = F.when(F.col(f"le_{i}") >= rank, inside).otherwise(out)
    return out


def serving_rollups(requests: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Requests, latency quantiles and error shares per time bucket and path.

    Latencies go into a fixed histogram, as the dashboards do: counts merge map-side, so a bucket of any size costs
    a dozen numbers, and the quantile is read from the histogram.
    """
    le = [F.count_if(F.col("seconds") <= b).alias(f"le_{i}") for i, b in enumerate(LATENCY_BUCKETS)]
    grouped = requests.groupBy(F.window("ts", width).alias("_w"), "path").agg(
        F.count(F.lit(1)).alias("requests"), *le,
        F.count_if(F.startswith("status", F.lit("5"))).alias("errors"),
        F.count_if(F.col("status") == "429").alias("throttled"),
    )
    total = F.col("requests")
    return grouped.select(
        F.col("_w.start").alias("bucket"), "path", "requests", _quantile(0.5, total).alias("p50"),
        _quantile(0.95, total).alias("p95"), (F.col("errors") / total).alias("share_5xx"), "throttled",
    )


def consolidation_report(decisions: DataFrame, archived: DataFrame, phase: str) -> DataFrame:
    """Scanned, consolidated, archived and error counts per scope of one run."""
    zero = F.lit(0).cast("bigint")
    failed = F.count_if(F.col("decision") == "ERROR")
    kept = F.count_if(F.col("decision").isin("ADD", "UPDATE", "SUPERSEDE"))
    scope = ["tenant_id", "user_id"]
    a = decisions.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("scanned"), kept.alias("consolidated"), zero.alias("archived"), failed.alias("errors")
    )
    b = archived.groupBy(*scope).agg(
        zero.alias("scanned"), zero.alias("consolidated"), F.count(F.lit(1)).alias("archived"), zero.alias("errors")
    )
    names = ["scanned", "consolidated", "archived", "errors"]
    return (
        a.unionByName(b).groupBy(*scope).agg(*[F.sum(n).alias(n) for n in names])
        .withColumn("phase", F.lit(phase))
    )
