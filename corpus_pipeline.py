"""A pipeline over documents: each stage's result is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadweft.llm.common import stage
from roadweft.llm.jaccard import drop_near_copies
from roadweft.llm.language import keep_known
from roadweft.llm.mixing import mixed_documents
from roadweft.llm.packing import pack_documents
from roadweft.llm.substring import cut_repeats


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language id: documents that are rejected go."""
    return keep_known(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each group stays."""
    return drop_near_copies(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: words of repeated windows are cut out."""
    return cut_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: a row for each pass over a document, with the words it takes."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: pieces of sequences."""
    return pack_documents(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("substrings", substrings), ("mixing", mixing), ("packing", packing)]
#: Token ids are not expressible in SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs
