"""Aggregations that Spark has no single function for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.operators.ordered import running_sum


def nearest_rank(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles at index round-half-even((n - 1) * p) of the sorted values, exactly.

    Values are first counted per (keys, value); two-level running counts
    locate the index, so no task holds all values of a key.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    total = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))  # the counts' exchange is reused
    ranked = running_sum(counts, keys, value, "_n", "_upto", width=256).join(total, keys)
    at = lambda p: F.bround((F.col("_total") - 1) * F.lit(p), 0) + 1
    return ranked.groupBy(*keys).agg(*[F.min(F.when(F.col("_upto") >= at(p), F.col(value))).alias(name) for name, p in shares.items()])


def bottleneck(wall: Column, attributed: Column, model: Column, calls: Column, chunks: Column, retries: Column, failed: Column) -> Column:
    """What slowed a job, by the first rule that holds."""
    total = F.greatest(wall, F.lit(1))
    lost = wall - attributed
    return (
        F.when((lost >= F.greatest(F.lit(60000), 2 * attributed)) & (lost / total >= 0.5), "unattributed_wait")
        .when((retries > F.greatest(F.lit(3.0), chunks * 0.1)) | (failed > 0), "model_stability")
        .when(model / total >= 0.6, "model_latency")
        .when((attributed - model) / total >= 0.45, "server_pipeline")
        .when((calls > 0) & (chunks / calls < 3), "orchestration")
        .otherwise("unknown")
    )


def batch_status(status: Column) -> Column:
    """Status of a batch from those of its jobs, as an aggregate."""
    all_are = lambda *s: F.bool_and(status.isin(*s))
    any_is = lambda *s: F.bool_or(status.isin(*s))
    return (
        F.when(all_are("pending_payment"), "pending_payment")
        .when(any_is("running"), "running")
        .when(any_is("pending"), "queued")
        .when(all_are("success"), "completed")
        .when(any_is("success") & any_is("failed", "cancelled"), "partial_completed")
        .when(all_are("failed"), "failed")
        .otherwise("running")
    )


def polish_price(chars: Column) -> Column:
    """Price by volume: steps up to a million characters, then 4.00 for each half million begun."""
    return (
        F.when(chars <= 150000, 3.99)
        .when(chars <= 300000, 5.99)
        .when(chars <= 600000, 8.99)
        .when(chars <= 1000000, 12.99)
        .otherwise(12.99 + 4.0 * F.ceil((chars - 1000000) / 500000))
    )


def translation_price(chars: Column) -> Column:
    return F.least(F.lit(99999.0), F.greatest(F.lit(5.99), F.bround(chars / 1000 * 0.1, 2)))
