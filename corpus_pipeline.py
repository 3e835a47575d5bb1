"""The corpus pipeline: filters, deduplicates, decontaminates and mixes ``documents``.

Every stage takes what its predecessor kept, written as Parquet and reread, and returns the columns
of documents; the last returns the selection of documents by epoch. The two classifiers are fitted
inside their stages on bounded samples of the rows they are given.

The quality stage drops what the classifier rejects, null and empty texts by the score it gives them.
The language stage drops texts without letters, texts of no clear language and those whose language
is not the stated one; null statements don't matter. Of near copies, repeated rows included, the row
of the smallest id stays; rows with a null id stay only where their class has no other. Empty tables
give empty results, very long texts are judged whole, and extra columns of any name pass through all
stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm import decontamination, language_id, near_dedup, quality_cnn
from linkloom.llm.queries import fold, mixed
from linkloom.operators.materialize import saved

#: The classifier's own verdict: texts that score less are rejected.
MIN_QUALITY = 0.7
#: A language must reach this part of the evidence.
MIN_LANGUAGE = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    network = quality_cnn.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~fold(4, 2))
    return quality_cnn.keep_quality(docs, network, MIN_QUALITY)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    filters = language_id.train(docs, ~fold(4, 2))
    return language_id.filter_languages(docs, filters, tuple(filters.languages), MIN_LANGUAGE, declared="lang")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


STAGES = [
    ("quality classifier", quality),
    ("language id", language),
    ("near dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("source mixing", mix),
]

#: The convolutional network cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
