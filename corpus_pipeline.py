"""Corpus pipeline: quality rules, line dedup, near duplicates, decontamination, encoding.

Every stage takes (spark, docs, folder of the tables) and returns a DataFrame. ``run`` writes each
stage's rows as Parquet in the shared folder and reads them for the next, so a lost executor costs
at most the stage at work. A stage begins by deleting what the stage before it has stored on its
way, which is why its documents must come from a written table. All stages but the last return the
columns of the documents; a stage that changes texts brings ``n_chars`` up to date.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bpe, decontaminate, line_dedup, ngram_join, quality_hosts
from strandline.llm.common import read, release, release_paths, stored, stored_paths
from strandline.llm.queries import WORD_BPE, vocabulary


def _recounted(docs: DataFrame, text: str = "text", size: str = "n_chars") -> DataFrame:
    return docs.withColumn(size, F.length(text).cast(docs.schema[size].dataType)) if size in docs.columns else docs


_left: set[str] = set()


def staged(stage):
    """A stage that first deletes what the stage before it has stored on its way."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
        release_paths(spark, _left)
        before = stored_paths()
        out = stage(spark, docs, folder)
        _left.clear()
        _left.update(stored_paths() - before)
        return out

    return run_stage


@staged
def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that fail the rules, or whose host is rejected, go."""
    return quality_hosts.good_documents(docs)


@staged
def line_repeats(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Lines that match an earlier line go, and documents of which no line is left."""
    return _recounted(line_dedup.without_repeats(docs))


@staged
def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id."""
    return ngram_join.one_of_each(docs, size=5, percent=80)


@staged
def benchmark_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Benchmark passages are cut out; documents that mostly consist of them go."""
    return _recounted(decontaminate.decontaminate(docs, read(spark, folder, "benchmark")))


@staged
def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents with their number of tokens, their codes and the digest of what these decode to."""

    def made(codes: bytes, decoded: str) -> tuple:
        n, _, digest = bpe.digest(codes, decoded)
        return n, np.frombuffer(codes, "<u4").astype(np.int32), digest

    return bpe.encoded(docs, vocabulary(WORD_BPE), make=made, schema="n_tokens bigint, token_ids array<int>, decoded_sha256 string")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_repeats),
    ("ngram_join", near_duplicates),
    ("decontamination", benchmark_passages),
    ("bpe", encode),
]

#: BPE and the suffix automaton have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            release(last)
        last = docs
    return docs
