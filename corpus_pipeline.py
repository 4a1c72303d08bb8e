"""From raw documents to token files: five stages, each one operator of pathquarry.llm over all that the stage before kept.

Null and empty texts are rejected by the first stage, since they hold no words. Repeated rows that survive near-duplicate removal
(equal id and text) stay one group and are kept together; ties are broken by id. Texts of any length are used whole. Extra columns,
whatever their names, pass through until the last stage, except score and leaks, which stages replace. Empty tables give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathquarry.llm import decontamination, mixing, quality_knn, simhash, token_output
from pathquarry.llm.common import load, shared_path

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose neighbours' vote is under 0.7 go."""
    model = quality_knn.train(docs.select("doc_id", "text"), load(spark, sf_dir, "labels"))
    return quality_knn.score(docs, model, keep_text=True).where(F.col("score") >= 0.7).drop("score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles of similarity 0.8 or more the one with the smallest id stays."""
    return simhash.keep_one(docs, by="shingles")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other names and numbers, go."""
    return decontamination.clean(docs, load(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their target weights."""
    return mixing.repeat(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """ORC token files in doc_id order, and what reading them back gives for each document."""
    return token_output.encode_and_read(docs, VOCABULARY)


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("mixing", mix),
    ("token_output", write_tokens),
]
#: Vector scoring and tokenizing can't be written in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
