"""The corpus pipeline: quality classifier, line dedup, n-gram Jaccard join, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next one's docs. A stage begins by deleting the scratch tables of the one before it, whose result is
written by then. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpuslens.llm import bpe, common, decontam, linededup, ngramjoin, quality
from corpuslens.llm.common import table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later matches among lines go; a document that loses all its words goes with them. n_chars stays the source's figure."""
    left = linededup.dedup(docs)
    return left.where("n_removed = 0 or text rlike '[\\\\p{L}\\\\p{N}]'").select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: texts are near copies from a Jaccard similarity of 0.8 of their five-word shingles on."""
    return ngramjoin.one_of_each(docs, n=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from others the words of benchmark windows are cut."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    return bpe.encode(docs, str(public_tokenizers.path("word_bpe_49k.json")))


#: Folders of the stage before, deleted when the next one begins: by then its result is written.
_done: list[str] = []


def _stage(make: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.release(spark, _done)
        with common.scratch() as own:
            made = make(spark, docs, sf_dir)
        _done.extend(own)
        return made

    return run


STAGES = [
    ("quality", _stage(good_quality)),
    ("line_dedup", _stage(without_repeated_lines)),
    ("ngram_join", _stage(one_of_near_copies)),
    ("decontamination", _stage(without_benchmark)),
    ("bpe", _stage(encoded)),
]

#: SQL can express neither a trained classifier nor byte-pair merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{common.shared_dir(spark)}/corpuslens/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            common.delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
