"""The corpus pipeline: quality rules, near duplicates, decontamination, masking of
personal data, encoding.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as
Parquet and read again as the next one's ``docs``.  All but the last return the
columns of ``documents``.

Defined results: a null, empty or very short text fails the quality rules.  Taken alone,
the later stages keep it: it has no near duplicate, isn't contaminated, holds no personal
data and has no tokens.  Of repeated rows and of copies one stays, that of the smallest
id; copies without an id go where a copy has one, and stay where none has.  An empty
table stays empty; other columns are handed through until the last stage, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenforge.llm import byte_bpe, decontam, jaccard_join, pii, quality_rules
from tokenforge.llm.common import bound_batches, stored
from tokenforge.sources.tables import read_table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    bound_batches(spark)
    return quality_rules.keep_good(docs)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    bound_batches(spark)
    return jaccard_join.keep_one(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate."""
    return decontam.keep_clean(docs, read_table(spark, sf_dir, "benchmark", ["item_id", "text"]))


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars is that of the new
    text."""
    bound_batches(spark)
    return pii.masked(docs).withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    bound_batches(spark)
    out = docs.select("doc_id", "lang", "source", byte_bpe.checked_udf()("text").alias("e"))
    return out.select("doc_id", "lang", "source", "e.token_ids", F.size("e.token_ids").cast("long").alias("n_tokens"),
                      "e.round_trip")


STAGES = [("quality_rules", keep_good), ("near_duplicates", keep_one), ("decontamination", keep_clean),
          ("personal_data", mask), ("byte_bpe", encode)]

#: The model of the fourth stage and the vocabulary of the fifth aren't SQL; the
#: tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
