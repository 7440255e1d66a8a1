"""The registered queries of the pipeline operators, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bpe, decontaminate, hard_negatives, lattice_lm, lexical_search, licences, line_dedup, ngram_join, pii, quality_hosts, token_counts, token_planes, url_graph
from strandline.llm.common import read
from strandline.llm.twins import SQL as TWINS
from strandline.session import scratch_path


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


WORD_BPE = "word_bpe_49k.json"


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_hosts.judged(read(spark, folder, "documents"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op3_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_graph.judged(read(spark, folder, "pages"), url_graph.RULES)


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_report(read(spark, folder, "documents"))


def op5_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, folder, "documents"), size=4, percent=85)


#: Key of the registered query's pseudonyms; users bring their own secret.
QUERY_KEY = "strandline"


def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return pii.pseudonymised(docs, QUERY_KEY)


def op7_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scanned(read(spark, folder, "documents"))


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return token_counts.context_limits(token_counts.length_histogram(docs, vocabulary(WORD_BPE)))


def op9_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lattice_lm.scores(read(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_digests(read(spark, folder, "documents"), vocabulary(WORD_BPE))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    seventh = F.pmod(F.col("vec_id"), F.lit(7)) == 0
    label = F.when(seventh, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    rows = hard_negatives.prepared(read(spark, folder, "embeddings"), label)
    return hard_negatives.mined(rows, F.pmod(F.col("vec_id"), F.lit(100)) == 0)


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.ranked(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op13_token_planes(spark: SparkSession, folder: str) -> DataFrame:
    return token_planes.round_trip(read(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), scratch_path(spark, "token-planes"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_decontamination": op2_decontamination,
    "op3_url_filters": op3_url_filters,
    "op4_line_dedup": op4_line_dedup,
    "op5_ngram_join": op5_ngram_join,
    "op6_pii": op6_pii,
    "op7_license_scans": op7_license_scans,
    "op8_token_counts": op8_token_counts,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_bpe": op10_bpe,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_lexical_search": op12_lexical_search,
    "op13_token_planes": op13_token_planes,
}
SQL: dict[str, str] = TWINS
