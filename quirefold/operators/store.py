"""Conditional changes of a table, as projections of one snapshot to the next.

Spark tables have no row locks: one writer at a time is assumed, and each
function returns the new snapshot (and, where asked, which rows changed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.operators.ordered import latest_wins

TERMINAL = ("success", "failed", "cancelled")


def compare_and_set(df: DataFrame, column: str, expected: str, new: str, where: Column) -> DataFrame:
    """Rows that meet ``where`` and hold ``expected`` get ``new``; ``won`` says which."""
    won = where & (F.col(column) == expected)
    return df.withColumn("won", F.coalesce(won, F.lit(False))).withColumn(column, F.when(F.col("won"), F.lit(new)).otherwise(F.col(column)))


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key, changes winning ties."""
    rows = base.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest_wins(rows, keys, [order, "_new"]).drop("_new")


def fenced(changes: DataFrame, attempts: DataFrame, key: str, attempt: str) -> DataFrame:
    """Only changes of the current attempt: stale writers lose."""
    return changes.join(attempts.select(key, attempt), [key, attempt], "left_semi")


def merged_stats(old: Column, new: Column) -> Column:
    """Shallow merge of two maps, the new one winning."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def expire(df: DataFrame, status: str, created: str, now: Column, minutes: int) -> DataFrame:
    """Payments pending for longer than the limit are cancelled."""
    late = (F.col(status) == "pending_payment") & (F.col(created) < now - F.expr(f"INTERVAL {minutes} MINUTES"))
    return df.withColumn(status, F.when(late, "cancelled").otherwise(F.col(status)))


def transition(status: Column, action: Column, error: Column) -> Column:
    """Next status of a job: retry after a partial result, restart from a terminal state, cancel while open."""
    return (
        F.when((action == "retry") & (error == "PARTIAL_TRANSLATION") & status.isin("success", "failed"), "pending")
        .when((action == "restart") & status.isin(*TERMINAL), "pending")
        .when((action == "cancel") & status.isin("pending", "running"), "cancelled")
        .otherwise(status)
    )


def cache_lookup(requests: DataFrame, cache: DataFrame, source: str, family: str, context: str, order: str, value: str) -> DataFrame:
    """``requests`` (with ``policy`` and ``attempt``) and what a cache holds for them: ``value`` and ``hit``.

    fresh: nothing is looked up.  verified, and reuse from the second attempt
    on: the newest entry of equal source, family and context ('exact').  reuse
    at the first attempt: else the newest entry of equal source and family
    ('compatible').  Entries with an empty value don't count.  Both look-ups
    are joins of requests with one row a key.
    """
    kept = cache.where(F.col(value) != "")
    newest = lambda keys, name: kept.groupBy(*keys).agg(F.max_by(value, order).alias(name))
    exact, compatible = newest([source, family, context], "_exact"), newest([source, family], "_compatible")
    out = requests.join(exact, [source, family, context], "left").join(compatible, [source, family], "left")
    policy = F.when(F.col("policy").isin("fresh", "verified"), F.col("policy")).otherwise("reuse")
    hit = (
        F.when(policy == "fresh", "miss")
        .when(F.col("_exact").isNotNull(), "exact")
        .when((policy == "reuse") & (F.col("attempt") <= 1) & F.col("_compatible").isNotNull(), "compatible")
        .otherwise("miss")
    )
    out = out.withColumn("hit", hit).withColumn(value, F.when(F.col("hit") == "exact", F.col("_exact")).when(F.col("hit") == "compatible", F.col("_compatible")))
    return out.select(*requests.columns, value, "hit")
