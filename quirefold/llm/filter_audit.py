"""Filter interaction audit: what each filter removes, in every order, from one CUBE.

``failures`` gives each document five failure flags.  ``audit`` adds equal
flag rows up, takes an SQL CUBE over the flags and the part, reads the
survivors of each of the 32 filter subsets off the grouping-set rows whose
selected flags are all false, and joins the subsets before and after each
step.  No order is run over the documents.

Defined results:

* a null text is empty (fails A); a null source is the empty part;
* E compares whole texts by their SHA-256 over the table; a row without an id
  is never after another one, and its text counts as nobody's predecessor;
  rows that repeat an id and a text don't fail E by one another;
* a document with several label rows counts as good (toxic) if any says so;
* an empty table gives no rows; other columns are ignored.

Texts are read once and never shuffled: what moves is one narrow row a
document.  The least id of a text comes from a partial aggregation and joins
back on (id, hash), so a group of equal texts never meets in one task.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.session import materialize

FILTERS = "ABCDE"
_ALL = (1 << len(FILTERS)) - 1


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, A..E, good, toxic): one row a document; true means that it fails that filter."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", "text", _words(F.col("text")).alias("words"))
    upper = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    rows = rows.select(
        "doc_id",
        "part",
        (F.size("words") < 200).alias("A"),
        (100 * F.size(F.array_distinct("words")).cast("long") < 50 * F.size("words").cast("long")).alias("B"),
        (100 * upper.cast("long") > 2 * F.length("text").cast("long")).alias("C"),
        F.col("text").rlike("[#$%&*|]").alias("D"),
        F.unhex(F.sha2("text", 256)).alias("hash"),
    )
    first = rows.where("doc_id is not null").groupBy("hash").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    named = rows.where("doc_id is not null").join(first, ["doc_id", "hash"], "left").withColumn("E", F.col("first").isNull())
    rows = named.drop("first").unionByName(rows.where("doc_id is null").withColumn("E", F.lit(False))).drop("hash")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(marks, F.col("doc_id") == F.col("label_id"), "left").drop("label_id")
    return rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def survivors(flags: DataFrame) -> DataFrame:
    """(part, subset, n, good, toxic): documents that pass all filters of the subset (a bit mask), zeros included."""
    one = lambda c: F.count_if(c).alias(c)
    counts = flags.groupBy("part", *FILTERS).agg(F.count("*").alias("n"), one("good"), one("toxic"))
    cube = counts.cube("part", *FILTERS).agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")], F.grouping("part").alias("whole"), *[F.grouping(f).alias(f"_{f}") for f in FILTERS])
    passed = F.lit(True)
    subset = F.lit(0)
    for i, f in enumerate(FILTERS):
        passed = passed & ((F.col(f"_{f}") == 1) | ~F.col(f))
        subset = subset + (1 - F.col(f"_{f}")) * (1 << i)
    found = cube.where((F.col("whole") == 0) & passed).select("part", subset.cast("int").alias("subset"), "n", "good", "toxic")
    grid = found.where("subset = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit(_ALL))).alias("subset"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return grid.join(found, ["part", "subset"], "left").select("part", "subset", zero("n"), zero("good"), zero("toxic"))


def _orders() -> list[tuple[str, int, int, int]]:
    """(order, step, subset applied before, the step's filter): 120 x 5 rows."""
    out = []
    for p in permutations(range(len(FILTERS))):
        for k, f in enumerate(p):
            out.append(("".join(FILTERS[i] for i in p), k + 1, sum(1 << i for i in p[:k]), f))
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark = docs.sparkSession
    orders = spark.createDataFrame(_orders(), "filter_order string, step int, before int, filter int")  # 600 rows, whatever the data
    pairs = orders.groupBy("before", "filter").agg(F.count("*").alias("weight"))  # 80 rows: a pair occurs in that many orders
    grid = materialize(survivors(failures(docs, labels)), "survivors")  # 32 rows a part
    after = grid.select("part", F.col("subset").alias("after"), F.col("n").alias("kept"), F.col("good").alias("good_after"), F.col("toxic").alias("toxic_after"))
    step = grid.withColumnRenamed("subset", "before").join(F.broadcast(pairs), "before")
    step = step.withColumn("after", F.expr("before | shiftleft(1, filter)")).join(after, ["part", "after"])
    step = step.select("part", "before", "filter", "weight", "kept", (F.col("n") - F.col("kept")).alias("removed"), (F.col("good") - F.col("good_after")).alias("good_lost"), (F.col("toxic") - F.col("toxic_after")).alias("toxic_lost"))
    rest = F.expr(f"{_ALL} ^ shiftleft(1, filter)")
    sums = step.groupBy("part", "filter").agg(
        F.max(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"),
        F.max(F.when(F.col("before") == rest, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * F.col("weight")).alias("shapley"),
    )
    step = step.join(sums, ["part", "filter"]).join(F.broadcast(orders), ["before", "filter"])
    return step.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")

