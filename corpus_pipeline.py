"""Training-data pipeline over ``documents``: judge, dedupe, decontaminate, mix, tokenise.

Null and empty texts fall to the first stage, which rejects texts of few words. Rows that
repeat are judged each; of rows equal in id and text the second stage keeps one. Rows without
an id are kept like others where their component has none with an id. Rows without a source
are a source of their own. An empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vigilog.llm import decontaminate, mixing, quality, simhash, tokenfile
from vigilog.llm.scratch import keep

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep_good(docs)


def different_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the written token files hold of each document."""
    return tokenfile.written_documents(docs, VOCABULARY)


STAGES = [
    ("quality_rules", good_documents),
    ("simhash_near_dedup", different_documents),
    ("benchmark_decontamination", clean_documents),
    ("source_mixing", mixed_documents),
    ("token_output", token_files),
]

#: Fingerprints by XXH64 and token ids are beyond SQL; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
