"""One query per operator, over the whole of its table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdscope.llm import (
    byte_encoding,
    fingerprints,
    hard_negatives,
    language_id,
    line_dedup,
    lm_scoring,
    merkle_manifest,
    packing,
    piece_encoding,
    rp_forest,
    simhash_trie,
    suffix_dedup,
    token_shards,
)
from holdscope.llm.common import crc_remainder
from holdscope.llm.oracles import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str) -> Callable:
    def add(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = build
        return build

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op3_simhash_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.near_groups(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def word_bpe() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


@query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), word_bpe())


@query("op6_sentencepiece")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = piece_encoding.encode_decode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op7_suffix_array_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.dedup_passages(documents(spark, sf_dir))
    n_removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, x: x - a)
    return done.select(
        "row.doc_id",
        (F.octet_length("kept") + n_removed).alias("n_bytes"),
        n_removed.alias("n_removed"),
        (F.size("removed") / 2).cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_remainder(F.col("doc_id"), 3) == 1
    found = language_id.identify(documents(spark, sf_dir), ~held_out)
    return found.select(
        "row.doc_id", (crc_remainder(F.col("row.doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score"
    )


@query("op1_lm_scoring")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_remainder(F.col("doc_id"), 7) == 2
    scored, totals = lm_scoring.score(documents(spark, sf_dir), ~held_out)
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(totals.tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )


@query("op5_fingerprints")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.fingerprints(documents(spark, sf_dir))
    own, edit, after = [(F.col(f"{c}0"), F.col(f"{c}1")) for c in "fen"]
    return found.select(
        "row.doc_id",
        "n_chars",
        "edited_sha256",
        fingerprints.in_hex(*own).alias("fingerprint"),
        fingerprints.in_hex(*edit).alias("edited_fingerprint"),
        fingerprints.likeness(fingerprints.differing(own, edit)).alias("near_edited"),
        fingerprints.likeness(fingerprints.differing(own, after)).alias("near_next"),
    )


@query("op10_nearest_neighbours")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)


@query("op4_line_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(documents(spark, sf_dir))
    return done.select(
        "row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


@query("op8_token_shards")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.write_shards(documents(spark, sf_dir), word_bpe())[0]


@query("op11_hard_negatives")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("bigint")
    noisy = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0, noisy)


@query("op12_byte_bpe")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_encoding.encode_decode(documents(spark, sf_dir), vocabulary, public_tokenizers.PATTERN)
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op13_merkle_manifest")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = merkle_manifest.manifest(documents(spark, sf_dir), tampered, F.translate("text", "\n", ""))
    proof = F.sha2(F.array_join("path", ""), 256).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")
