"""A corpus pipeline of five stages: quality rules, exact and near duplicates, source mixture, packed sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the shared
folder and hands what it reads back to the next stage, so a lost executor costs no more than part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import exact_dedup, line_quality, mixing, ngram_join, packing
from tessella.llm.shared import discard, documents, shared_folder, spool


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are content by the line field."""
    field = line_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return line_quality.kept_documents(docs, field)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the largest id, of each text."""
    return exact_dedup.deduplicated(docs, stored=bool(docs.inputFiles()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by 80 % of five-word shingles."""
    return ngram_join.near_duplicates_removed(docs, n=5, pct=80, stored=bool(docs.inputFiles()))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture draws it."""
    return mixing.mixed_documents(docs, stored=bool(docs.inputFiles()))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    return packing.packed(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("ngram_join", near_duplicates),
    ("mixing", source_mixture),
    ("packing", packed_sequences),
]

#: A trained field decides the first stage and a tokenizer the last: not expressible in SQL, so tests compare each
#: stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        docs = spool(stage(spark, docs, sf_dir), f"pipeline-{name}", path)
        if before:
            discard(spark, before)  # the next stage has all it needs of it
        before = path
    return docs
