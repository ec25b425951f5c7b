"""Registered queries of the training-data operators and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteframe.llm import (
    html_text,
    language_id,
    licences,
    near_dups,
    packing,
    prefix_trie,
    quality,
    quotes,
    sentence_pieces,
    token_counts,
    toxicity,
    vectors,
    whitening,
)
from noteframe.llm.oracle import SQL  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    """The vocabulary file of the queries; the operators take any path."""
    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op1_sentencepiece(spark, sf_dir):
    return sentence_pieces.digests(sentence_pieces.encoded(table(spark, sf_dir, "documents"), piece_model()))


@query
def op3_html_extraction(spark, sf_dir):
    texts = html_text.extract(table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


@query
def op4_quotation_linking(spark, sf_dir):
    return quotes.linked(table(spark, sf_dir, "conversations"))


@query
def op5_quality_rules(spark, sf_dir):
    return quality.quality_counts(table(spark, sf_dir, "documents"))


@query
def op2_minhash_near_dedup(spark, sf_dir):
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op6_inverted_multi_index(spark, sf_dir):
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op7_toxicity(spark, sf_dir):
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_best_fit_packing(spark, sf_dir):
    return packing.pack_tokens(table(spark, sf_dir, "documents"), piece_model())


@query
def op8_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), piece_model())


@query
def op10_license_scans(spark, sf_dir):
    return licences.scan(table(spark, sf_dir, "documents"))


@query
def op12_embedding_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


@query
def op11_language_id(spark, sf_dir):
    return language_id.languages(table(spark, sf_dir, "documents"))


@query
def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))
