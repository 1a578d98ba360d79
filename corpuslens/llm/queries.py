"""One query an operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontam, licenses, linededup, ngramjoin, pii, quality, sharding, tokencount
from .common import table


def op1_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard(table(spark, sf_dir, "documents"), shards=16)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_license_sentence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("open_ids")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op4_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontam.judged(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_adaptive_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op6_transducer_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")), limit=1024)


def op7_attention_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_word_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


def op9_trie_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.linked(table(spark, sf_dir, "documents"), n=4, percent=85)


def op10_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.spans(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_hypergeometric_shards, op2_license_sentence_rules, op3_line_dedup, op4_fm_index_decontamination, op5_adaptive_dimension_scan,
        op6_transducer_token_counts, op7_attention_mil_quality, op8_word_bpe_round_trip, op9_trie_ngram_join, op10_pii_sanitisation,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op2_license_sentence_rules": licenses.oracle()}
