"""A corpus pipeline: language ID, near-dedup, passage dedup, secret redaction, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of documents.

1. language_id: documents without letters, or too far from every language's
   character model, go.
2. near_dedup: documents whose five-word shingle sets have a Jaccard
   similarity of 0.8 or more are linked; of each component the least id stays.
3. passage_dedup: of a passage of 50 words or more that repeats, the first
   place stays and all later ones are cut out of their texts.
4. secret_redaction: secrets are replaced by a mark.
5. packing: the texts become sequences of at most 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import langid, packing, secrets, setsketch, suffix_dedup
from quirefold.session import materialize, table


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is not rejected; null, empty and letterless texts go, repeated rows are judged one by one."""
    model = langid.learn(docs)
    return langid.identify(docs, model).where(~F.col("rejected")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the least id (of equal ids, of the least text hash).

    Rows with one id but texts that are no near copies stay both; rows that
    repeat id and text are one; rows without an id and texts without words
    link with nothing and stay.
    """
    found = setsketch.near_duplicates(docs, shingle=5, percent=80, rows=True)
    kept = found.where("first and doc_id is not null").select("doc_id", "text_hash").distinct()
    named = docs.withColumn("text_hash", F.xxhash64("text")).join(kept, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the later places of repeated passages; null texts stay null, the least (id, position) is the first place."""
    return _sized(suffix_dedup.suffix_dedup(docs, min_words=50), docs.columns)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their texts replaced by a mark; null texts stay null."""
    return _sized(secrets.redact(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a document; null texts are the end id alone, repeated rows are packed one by one."""
    return packing.pack(docs, size=2048, end_id=0)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("secret_redaction", secret_redaction),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Models and hashes on the way cannot be written as SQL; tests hold the stages against brute force.
ORACLE_SQL = None
