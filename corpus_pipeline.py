"""A training-data pipeline over `documents`: toxic documents go, one document of each near-duplicate group stays, documents
that hold benchmark passages go, personal data is replaced, and what is left is packed into sequences.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and
reads again for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm import decontaminate, packing, personal_data, simhash, toxicity
from rasterloom.llm.runtime import load, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that the network, trained on the labels of docs, scores under 0.5."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, load(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each component of near-duplicates."""
    return simhash.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without any window of a benchmark item."""
    return decontaminate.decontaminate(docs, load(spark, sf_dir, "benchmark"))


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with personal data replaced by the name of its kind."""
    return personal_data.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of docs and their places in sequences."""
    return packing.pack(docs)


STAGES = [("toxicity", toxic), ("simhash_near_dup", near_duplicates), ("benchmark_decontamination", benchmark), ("personal_data", personal), ("best_fit_packing", packed)]

#: SQL can't express the network, XXH64 or the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name)
    return docs
