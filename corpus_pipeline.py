"""The corpus pipeline: toxicity, exact dedup, near-dedup, decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; between the
stages the documents are written as Parquet and read again. Rows are judged one by one, never by
doc_id: rows that repeat a doc_id or have none are kept or go each on its own account. A null text is
an empty one. An empty table passes through every stage; further columns are passed on, whatever their
names, up to the last stage, which returns the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablescope.llm import decontaminate, exact_dedup, mixing, simhash_dedup, toxicity
from tablescope.llm.common import written
from tablescope.llm.queries import table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the random field scores below its threshold; it learns from the labels."""
    field = toxicity.fitted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, field)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact_dedup.deduplicated(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group at a similarity of 0.8 or more on five-word shingles, the row with the smallest doc_id."""
    return simhash_dedup.without_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.without_matches(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mixed(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [("toxicity", without_toxic), ("exact_dedup", without_copies), ("simhash_near_dedup", without_near_copies), ("benchmark_decontamination", without_benchmark), ("source_mixing", mixed)]

#: The random field of the first stage can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs, _ = written(docs, f"pipeline-{name}")
    return docs
