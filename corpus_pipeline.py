"""A corpus pipeline of five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.llm import language_id, line_dedup, mixing, ngram_join, packing
from loreweave.llm.queries import vocabulary
from loreweave.llm.scratch import stage


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID does not reject."""
    return language_id.accepted(docs)


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier one taken out; documents with no line left go."""
    return line_dedup.without_repeats(docs, short=True)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicate groups (five-word shingles, Jaccard of 0.8 or more): the smallest id of each stays."""
    groups = ngram_join.ngram_components(docs, words=5, num=80, den=100, by_rarity=True)
    others = groups.where("component_id <> doc_id").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(others.hint("shuffle_hash"), F.col("doc_id") == F.col("__id"), "left_anti")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document as many times as the mix takes it."""
    return mixing.mixed_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, a row a piece."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("language_id", known_languages),
    ("line_dedup", unrepeated_lines),
    ("ngram_jaccard_join", one_of_each_group),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]

#: The stages compress, tokenize and draw by hashes, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
