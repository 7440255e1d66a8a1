import pytest
from conftest import rows
from pyspark.sql import functions as F

from strandline.sources import readers, writers

SRT = "1\n00:00:01,000 --> 00:00:02,500\n<i>Hello</i>\nworld\n\n2\n00:00:03,000 -> 00:00:04,000\nlost\n\n3\n00:02:10,000 --> 00:02:12,000\ncafé\n"


def test_subtitles_of_every_encoding(spark, tmp_path):
    (tmp_path / "story_en.srt").write_bytes(SRT.encode("utf-8"))
    (tmp_path / "story_fr.srt").write_bytes(SRT.replace("\n", "\r\n").encode("latin-1"))
    (tmp_path / "story_ja.srt").write_bytes("﻿1\n00:00:00,500 --> 00:00:01,000\nこんにちは\n".encode("utf-8"))
    lines = readers.read_subtitles(spark, str(tmp_path))
    good = lines.filter("ok").select("film_slug", "subtitle_index", "start_time", "end_time", "duration", "dialogue_text")
    assert rows(good) == [
        ("story_en", 1, 1.0, 2.5, 1.5, "Hello world"), ("story_en", 3, 130.0, 132.0, 2.0, "café"),
        ("story_fr", 1, 1.0, 2.5, 1.5, "Hello world"), ("story_fr", 3, 130.0, 132.0, 2.0, "café"),
        ("story_ja", 1, 0.5, 1.0, 0.5, "こんにちは"),
    ]
    meta = {r["film_slug"]: r for r in readers.document_metadata(lines).collect()}
    assert (meta["story_fr"]["total_subtitles"], meta["story_fr"]["skipped"], meta["story_fr"]["total_duration"]) == (2, 1, 131.0)
    assert (meta["story_ja"]["film_name"], meta["story_ja"]["language_code"], meta["story_en"]["language_code"]) == ("Story", "ja", "en")


def test_metadata_without_readable_entries(spark):
    files = spark.createDataFrame([("x_en", "1\nno timing\ntext\n")], "film_slug string, content string")
    got = readers.document_metadata(readers.parse_timed_text(files, "content")).first()
    assert (got["total_subtitles"], got["skipped"], got["total_duration"]) == (0, 1, 0.0)


def test_csv_with_line_ends_and_quotes_in_fields(spark, tmp_path):
    (tmp_path / "a b.csv").write_bytes('Name,Year\n"Castle\n  (1986)",1986\n"say ""hi"", now",2000\n'.encode())
    (tmp_path / "c.csv").write_bytes('Name,Year\n"Été\nlong",1999\n'.encode("latin-1"))
    got = readers.read_csv_with_encodings(spark, str(tmp_path), "Name STRING, Year INT")
    assert rows(got) == sorted([("Castle\n  (1986)", 1986), ('say "hi", now', 2000), ("Été\nlong", 1999)], key=repr)


def test_csv_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Name,Year\nÉlan,2001\n\n".encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("Name,Year\r\nÉté,1999\r\n".encode("latin-1"))
    got = readers.read_csv_with_encodings(spark, str(tmp_path), "Name STRING, Year INT")
    assert rows(got) == [("Élan", 2001), ("Été", 1999)]
    with pytest.raises(ValueError, match="Director"):
        readers.require_columns(got, ["Name", "Director"])


def test_json_entities(spark, tmp_path):
    (tmp_path / "people.json").write_text('[{"id":"1","name":"A","films":["u1","u2"],"extra":1},\n{"id":"2","name":"B"}]')
    got = readers.read_json_entities(spark, str(tmp_path), readers.ENTITY_SCHEMAS["people"], "api").orderBy("id").collect()
    assert got[0]["films"] == ["u1", "u2"] and got[1]["films"] is None and got[0]["source"] == "api" and got[0]["loaded_at"] is not None


def test_detect_language(spark):
    names = ["a_b_en_parsed.json", "a_en_v2_parsed.json", "a_EN_parsed", "a_xx_parsed.json", "en_parsed.json", "a_en.json"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r["n"]: r["c"] for r in df.select("n", readers.detect_language("n").alias("c")).collect()}
    assert [got[n] for n in names] == ["en", "en", "en", None, None, None]


def test_versions_and_lookup(spark):
    v1 = spark.createDataFrame([("a", 1), ("b", 1)], "k string, x int")
    v2 = spark.createDataFrame([("b", 2)], "k string, x int")
    assert rows(readers.versioned_source_pick([v1, v2], ["k"])) == [("a", 1, 1), ("b", 2, 2)]
    raw = spark.createDataFrame([('{"_documentation":{"title":"d"},"s1":{"title":"T","runtime_seconds":60}}',)], "j string")
    assert rows(readers.lookup_rows(raw, "j", "title:string,runtime_seconds:int")) == [("s1", "T", 60)]
    updated = writers.update_from_lookup(v1, v2.withColumnRenamed("x", "x").withColumn("y", F.lit(9)), ["k"], ["x", "y"])
    assert rows(updated.select("k", "x", "y")) == [("a", 1, None), ("b", 2, 9)]


def test_markdown_table(spark):
    lines = ["| Film | Language | Status | Drift | Score | Why |", "|---|---|---|---|---|---|", "| Harbor's Gate | FR | FAIL | 1 | 80 | x |", "| A | nl | WARN | 1 | n/a | x |", "text", "| | x | y | z | 1 | q |"]
    got = readers.parse_markdown_table(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert rows(got) == [("a", "A", "nl", 0), ("harbors_gate", "Harbor's Gate", "fr", 80)]


def test_loads_are_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, lang string")
    for _ in range(2):
        writers.load_idempotent(df, path, ["id"])
    assert rows(spark.read.parquet(path).select("id", "lang")) == [(1, "a"), (2, "b")]
    part = str(tmp_path / "p")
    writers.load_replacing(df.distinct(), part, ["lang"])
    writers.load_replacing(spark.createDataFrame([(9, "a")], "id int, lang string"), part, ["lang"])
    assert rows(spark.read.parquet(part).select("id", "lang")) == [(2, "b"), (9, "a")]


def test_materialise_and_freshness(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "id int")
    assert writers.materialise(df, "v1", "view") is df and spark.table("v1").count() == 1
    assert writers.materialise(df, "t1", "table", str(tmp_path / "m")).count() == 1
    with pytest.raises(ValueError):
        writers.materialise(df, "x", "other")
    stamped = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' as t")
    assert tuple(writers.freshness(stamped, "t", 48, "2024-01-02 12:00:00").first()) == (36.0, "PASS")
    assert tuple(writers.freshness(stamped.limit(0), "t", 48).first()) == (None, "WARN")


class _Remote:
    """Stands for a session on a cluster."""

    class conf:
        get = staticmethod(lambda key, default=None: None)

    class sparkContext:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)


def test_a_cluster_without_a_shared_folder_is_an_error():
    from strandline.session import shared_dir

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(_Remote)
