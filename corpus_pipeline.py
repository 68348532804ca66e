"""A training-data pipeline over ``documents``: each stage is written as Parquet and read again by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starloom.llm import dart_minhash, decontaminate, language, line_edits, packing
from starloom.session import stage


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model learns from the labelled ones among them."""
    return language.accepted(docs, language.fit(docs))


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occur, or nearly occur, before, whatever their length; documents of which nothing is
    left go.  The rule is that of op1_line_edits.  Blank lines stay, null and empty texts too; of rows with equal id and
    text all get the same."""
    return line_edits.without_repeats(docs, line_edits.WHOLE)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return dart_minhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of each document that is left."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", known_language),
    ("lines", unrepeated_lines),
    ("near_duplicates", one_of_each),
    ("benchmark", without_benchmark),
    ("packing", batches),
]

# Edit distances, signatures and subword counts are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; a stage's table is in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
