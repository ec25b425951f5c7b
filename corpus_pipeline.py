"""Corpus pipeline: quality rules, toxicity, near-duplicate removal, packing.

Every stage works on all rows that the one before kept. Null and empty texts fail the quality rules; of near copies the smallest ``doc_id``
stays; rows without ``doc_id`` and rows that share one are judged by their texts; rows of equal text have one fate but in the third
stage; other columns are carried along to the last; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from noteframe.llm import catalog, near_dups, packing, quality, toxicity
from noteframe.session import cut


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, judged against their own language and source."""
    return quality.keep_good(docs)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by models trained on the labelled ones among them."""
    return toxicity.keep_ordinary(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8)."""
    return near_dups.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document, by its tokens, in its place of a training sequence."""
    return packing.pack_tokens(docs, catalog.piece_model())


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near_duplicates", without_near_copies),
    ("packing", packed),
]

# Sketches, language models, MinHash and packing have no SQL form; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage keeps is written once for the next, which reads it several times."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
