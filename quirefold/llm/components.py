"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations and joins on the edge table; nothing but two
numbers a round reaches the driver.  Rounds grow with the logarithm of the
node count.  Every round is written to the shared folder, so lineage stays
short and lost executors cost one round at most.

Edges with a null end are left out, loops and repeated edges change nothing,
a component's name is its least node (so there are no ties), and an empty
edge table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.session import materialize, release


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of an edge; component is its least node."""
    e = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges"
    )
    seen = _signature(e)
    while seen[0]:
        both = e.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(
            e.select(F.col("v").alias("node"), F.col("u").alias("other"))
        )
        least = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = both.join(least, "node").where("other > node").select(F.col("other").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        old, e = e, materialize(small, "edges")
        release(old)
        now = _signature(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
