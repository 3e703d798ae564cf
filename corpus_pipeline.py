"""From documents to packed training sequences: each stage works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdscope.llm import language_id, line_dedup, packing, shingle_join, suffix_dedup
from holdscope.llm.common import crc_remainder, materialise

#: Documents whose best language has a smaller share of their letters are in none of the learned languages.
LEAST_SHARE = 0.35


def _with_text(done: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """The columns of ``docs``, with a new text and its length; documents that lost all of their text go."""
    new = {"text": text, "n_chars": F.length(text).cast("bigint")}
    columns = [new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    return done.filter(F.length(text) > 0).select(columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; those without letters, or in no learned language, go."""
    found = language_id.identify(docs, crc_remainder(F.col("doc_id"), 3) != 1)
    told = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SHARE)
    return found.filter(told).select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one has, but for one edit at most."""
    done = line_dedup.dedup_lines(docs)
    return _with_text(done, docs, F.col("text"))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    The trie of the SimHash fingerprints is walked, and bands of their bits are compared; the pairs found are held to a
    Jaccard similarity of 0.8 of their 5-word runs. An exact join links the near copies that the fingerprints leave apart.
    """
    return shingle_join.keep_one(docs)


def dedup_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that start earlier; a character that is cut in two goes whole."""
    done = suffix_dedup.dedup_passages(docs, as_text=True)
    return _with_text(done, docs, F.col("kept"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_documents),
    ("suffix_array_dedup", dedup_passages),
    ("packing", pack),
]

#: Neither the network nor the fingerprints can be stated in SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
