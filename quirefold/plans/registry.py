"""All queries of the library outside the training-data subpackage, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.plans import chain_queries, document_queries, job_queries, markup_queries, page_queries, record_queries, review_queries, source_queries, stream_queries, text_queries
from quirefold.plans.base import Query
from quirefold.session import table

MODULES = (text_queries, job_queries, document_queries, markup_queries, record_queries, stream_queries, source_queries, chain_queries, page_queries, review_queries)

QUERIES: dict[str, Query] = {k: f for m in MODULES for k, f in m.R.queries.items()}
ORACLE: dict[str, str] = {k: q for m in MODULES for k, q in m.R.oracle.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text volume and line counts by language."""
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))
