"""Order-dependent operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_wins(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row a key: the last in the given order.  A max of structs, so Spark aggregates before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def neighbours(df: DataFrame, keys: list[str], order: str, text: str, limit: int = 500) -> DataFrame:
    """Adds the end of the text before and the start of the text after."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumns({"previous": F.right(F.lag(text).over(w), F.lit(limit)), "next": F.left(F.lead(text).over(w), F.lit(limit))})


def carried(df: DataFrame, keys: list[str], order: str, value: Column, name: str) -> DataFrame:
    """As-of backward: the last non-null value up to and with the row."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def running_sum(df: DataFrame, keys: list[str], order: str, value: str, name: str, width: int = 4096) -> DataFrame:
    """Adds the sum of ``value`` up to and with each row, in two levels.

    Rows are summed per range of ``width`` order values first; the running sum
    over ranges has few rows, and rows are only sorted within their range, so
    no task holds a whole key.
    """
    part = df.withColumn("_part", F.floor(F.col(order) / width))
    sums = part.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    base = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_base_part"), F.coalesce(before, F.lit(0)).alias("_base"))
    on = F.col("_part") == F.col("_base_part")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    own = F.sum(value).over(Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return part.withColumn("_own", own).join(base, on).select(*df.columns, (F.col("_base") + F.col("_own")).alias(name))


def greedy_batches(items: Column, limit: int) -> Column:
    """Batch number of each item of an array of struct(cost, single), in order.

    A batch closes before an item that would exceed the limit; a single item
    closes the batch before it and stands alone.
    """
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).cast("long").alias("used"), F.lit(True).alias("fresh"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = ~acc["fresh"] & (x["single"] | (acc["used"] + x["cost"] > limit))
        batch = acc["batch"] + new.cast("int")
        return F.struct(
            F.when(x["single"], batch + 1).otherwise(batch).alias("batch"),
            F.when(x["single"], F.lit(0).cast("long")).when(new, x["cost"]).otherwise(acc["used"] + x["cost"]).alias("used"),
            x["single"].alias("fresh"),
            F.concat(acc["out"], F.array(batch)).alias("out"),
        )

    return F.aggregate(items, start, step)["out"]


def smoothed(values: Column, keep: float = 0.7) -> Column:
    """Exponentially smoothed end value of an array in order."""
    return F.aggregate(
        values, F.lit(None).cast("double"), lambda acc, v: F.when(acc.isNull(), v.cast("double")).otherwise(acc * keep + v * (1 - keep))
    )


def adaptive_limit(outcomes: Column, most: int, least: int = 2, slow_ms: int = 20000, streak: int = 6) -> Column:
    """Concurrency after outcomes struct(ok, latency): down on failure, up after a streak of fast successes."""

    def step(acc: Column, x: Column) -> Column:
        fast = x["ok"] & (x["latency"] <= slow_ms)
        up = fast & (acc["run"] + 1 >= streak)
        limit = F.when(~x["ok"], F.greatest(F.lit(least), acc["limit"] - 1)).when(up, F.least(F.lit(most), acc["limit"] + 1)).otherwise(acc["limit"])
        return F.struct(limit.alias("limit"), F.when(fast & ~up, acc["run"] + 1).otherwise(0).alias("run"))

    return F.aggregate(outcomes, F.struct(F.lit(most).alias("limit"), F.lit(0).alias("run")), step)["limit"]


def spans_without_overlap(spans: Column, cap: int = 32) -> Column:
    """Longest first, then leftmost, skipping overlaps, at most ``cap``; in text order.  spans: (start, end, term)."""
    ordered = F.transform(spans, lambda s: F.struct((s["start"] - s["end"]).alias("size"), s["start"].alias("start"), s["term"].alias("term"), s["end"].alias("end")))
    kind = "array<struct<start:int,end:int,term:string>>"

    def step(acc: Column, s: Column) -> Column:
        clash = F.exists(acc, lambda k: (s["start"] < k["end"]) & (s["end"] > k["start"]))
        new = F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["term"].alias("term"))
        return F.when(clash | (F.size(acc) >= cap), acc).otherwise(F.concat(acc, F.array(new)))

    return F.array_sort(F.aggregate(F.array_sort(ordered), F.array().cast(kind), step))


def running_max(df: DataFrame, keys: list[str], order: str, values: dict[str, Column], width: int = 4096, itself: bool = False) -> DataFrame:
    """Adds the greatest of each value over the rows before (``itself``: up to and with the row), in two levels.

    Rows are sorted only within a range of ``width`` order values; each range's
    greatest values are carried over the ranges, which are few.  Null values
    don't count, null keys are one key; of rows with equal order each comes
    before the others once, in no fixed order (give them a tie-break).
    """
    names = list(values)
    part = df.withColumns({"_part": F.floor(F.col(order) / width).cast("long")} | {f"_v_{n}": c for n, c in values.items()})
    tops = part.groupBy(*keys, "_part").agg(*[F.max(f"_v_{n}").alias(f"_t_{n}") for n in names])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = tops.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_base_part"), *[F.max(f"_t_{n}").over(before).alias(f"_b_{n}") for n in names])
    within = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    own = part.withColumns({f"_o_{n}": F.max(f"_v_{n}").over(within) for n in names})
    on = F.col("_part") == F.col("_base_part")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = own.join(bases, on)
    return out.select(*[F.col(c) for c in df.columns if c not in names], *[F.greatest(f"_o_{n}", f"_b_{n}").alias(n) for n in names])


def as_of(left: DataFrame, right: DataFrame, keys: list[str], order: str, value: Column, name: str, width: int = 4096, inclusive: bool = True) -> DataFrame:
    """As-of backward join: each left row with ``value`` of the last right row at or before it (``inclusive=False``: before it).

    A union of both sides carried forward in two levels, so no task holds a
    key; of right rows at one place the greatest value counts, and a left row
    without one before it gets null.
    """
    kept = F.struct(*left.columns)
    place = F.col(order).cast("long")
    # at one place the right rows come first if they count, else last
    a = left.select(*keys, (place * 2 + int(inclusive)).alias("_place"), F.lit(None).cast(right.select(F.struct(place.alias("at"), value.alias("v")).alias("x")).schema["x"].dataType).alias("_right"), kept.alias("_left"))
    b = right.select(*keys, (place * 2 + int(not inclusive)).alias("_place"), F.struct(place.alias("at"), value.alias("v")).alias("_right"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"))
    got = running_max(a.unionByName(b), keys, "_place", {"_last": F.col("_right")}, 2 * width, itself=True)
    return got.where("_left is not null").select("_left.*", F.col("_last.v").alias(name))
