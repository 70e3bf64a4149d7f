"""Sources and sinks over files that Spark writes from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quirefold.plans.base import Registry
from quirefold.session import shared_dir, table
from quirefold.sources import formats

R = Registry()


@R.add(
    "packaged_pages",
    """WITH p AS (SELECT page_id // 10 AS book, page_id, html, CAST(row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id) AS INTEGER) AS position FROM pages WHERE html IS NOT NULL)
SELECT book, position, page_id, CAST(octet_length(encode(html)) AS BIGINT) AS size, sha256(html) AS sha256 FROM p""",
)
def packaged_pages(spark, sf):
    """All pages packed ten to a book, written as packages and read again through the data source."""
    formats.register(spark)
    path = f"{shared_dir(spark).removeprefix('file://')}/quirefold-{spark.sparkContext.applicationId}/books-{uuid.uuid4().hex}"
    rows = table(spark, sf, "pages").where("html is not null").select(
        F.expr("page_id div 10").cast("string").alias("book"), "page_id", F.concat(F.lit("text/"), F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.encode("html", "UTF-8").alias("content")
    )
    rows.repartition("book").sortWithinPartitions("book", "page_id").select("book", "name", "content").write.format("books").mode("append").save(path)
    read = spark.read.format("books").load(path).where(F.col("name").endswith(".html"))
    number = lambda c: F.regexp_extract(c, r"(\d+)\.\w+$", 1).cast("long")
    return read.select(number("book").alias("book"), "position", number("name").alias("page_id"), "size", F.sha2("content", 256).alias("sha256"))
