"""Every operator and pipeline stage over documents whose extra columns have names it uses itself."""

import pytest
from pyspark.sql import functions as F

from strandline.llm import bpe, decontaminate, hard_negatives, lattice_lm, lexical_search, licences, line_dedup, ngram_join, pii, quality_hosts, token_counts, token_planes, url_graph

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD_BPE, BYTE_BPE, PIECES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
NAMES = """n_words word_chars n_symbols n_lines n_dup_lines n_repeat_words base_failed kept host_rejected host host_key q_n_words n_tokens ids decoded token_ids decoded_sha256 ids_sha256
kept_id kept_th kept_lines _kept _kept_id _lines _text_hash _blank_lines th pos line words first prefix parity rep n key a b h bits word component component_id n_shingles n_links node label tokens bands
n_hit n_items items contaminated _stays _clean_text _whole_text n_pseudonyms _n_pseudonyms _found _gaps _new sentence_ids licences kinds item item_id rank score terms tfs norm impacts start ids_crc32 n_docs block
chunk steps held held_out piece query cell part crowd vec tree rule verdict trust distrust src dst""".split()
TEXT = "some words of a plain document that says nothing twice and nothing much\nanother line of it with a mail to ann@example.org on 2024-02-03"


def documents(spark):
    rows = [(k, f"{TEXT} number {k} " + " ".join(f"w{k * 7 + j}" for j in range(20)), "src") for k in range(6)] + [(6, None, None), (7, "", "src")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return docs.select("*", *[F.concat(F.lit(f"{n} of "), "doc_id").alias(n) for n in dict.fromkeys(NAMES)])


def bench(spark):
    return spark.createDataFrame([(1, "some words of a plain document that says nothing twice and")], "item_id long, text string")


KEEPING = {
    "quality": quality_hosts.good_documents, "lines": line_dedup.without_repeats, "near": ngram_join.one_of_each, "pii": lambda d: pii.pseudonymised(d, "k"), "bpe": lambda d: bpe.encoded(d, WORD_BPE),
    "decontaminate": lambda d: decontaminate.decontaminate(d, bench(d.sparkSession)),
}
REPORTING = {
    "judged": quality_hosts.judged, "report": line_dedup.line_report, "duplicates": ngram_join.near_duplicates, "contamination": lambda d: decontaminate.contamination(d, bench(d.sparkSession)),
    "licences": licences.scanned, "digests": lambda d: bpe.encode_digests(d, WORD_BPE), "scores": lambda d: lattice_lm.scores(d, PIECES), "planes": lambda d: token_planes.token_ids(d, BYTE_BPE, files=2),
}


@pytest.mark.parametrize("name", KEEPING)
def test_columns_stay_what_they_are(spark, name):
    docs = documents(spark)
    out = KEEPING[name](docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = out.collect()
    assert rows and all(r[n] == f"{n} of {r['doc_id']}" for r in rows for n in NAMES)


@pytest.mark.parametrize("name", REPORTING)
def test_reports_have_every_document(spark, name):
    assert sorted(r["doc_id"] for r in REPORTING[name](documents(spark)).collect()) == list(range(8))


def test_other_operators(spark):
    docs = documents(spark)
    assert token_counts.length_histogram(docs, WORD_BPE).agg(F.sum("n_docs")).first()[0] == 8
    assert lexical_search.ranked(docs, bench(spark).withColumn("score", F.lit("x")).withColumn("doc_id", F.lit("y"))).count() == 6
    pages = docs.select("*", F.col("doc_id").alias("page_id"), F.lit("http://a.b.c/x").alias("url"), F.lit(None).cast("string").alias("html"))
    assert url_graph.judged(pages, url_graph.RULES).count() == 8
    vectors = docs.drop("label").select("*", F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"), F.lit(1).alias("label"))
    assert hard_negatives.mined(hard_negatives.prepared(vectors), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, tmp_path, stage):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = documents(spark).withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.STAGES[stage][1](spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
    assert out.columns[: len(docs.columns)] == docs.columns and (stage == 4 or out.columns == docs.columns)
    assert all(r[n] == f"{n} of {r['doc_id']}" for r in out.collect() for n in NAMES)
