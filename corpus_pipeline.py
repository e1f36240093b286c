"""A corpus pipeline over documents: each stage is one corpus operator, written and read again by the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from penumbra.llm import bpe, decontam, linededup, neardup, quality
from penumbra.llm.common import materialize
from penumbra.llm.queries import VOCABULARY

#: SQL can't express near duplicates or byte-pair encoding; the stages are tested against brute force.
ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.keep_good(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without multi-line chunks that an earlier one has; those of which no word is left go."""
    return linededup.without_repeated_lines(docs, drop_emptied=True)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least id of each component of near duplicates: five-word shingles, similarity 0.8."""
    return neardup.keep_one_of_each(docs)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count, token ids and digests of what is left."""
    return bpe.encode_documents(docs, VOCABULARY, with_ids=True)


STAGES = [
    ("quality_rules", good_documents),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", one_of_each),
    ("decontamination", not_in_benchmark),
    ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
