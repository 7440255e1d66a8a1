import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from strandline.operators import corpus
from strandline.plans import reports


def test_chunks_keep_the_overlap_tail(spark):
    def cut(n, size, overlap):
        df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)))], "id int, t string")
        return [r["chunk"].split() for r in corpus.chunk_text(df, "t", size, overlap).orderBy("chunk_num").collect()]

    assert [len(c) for c in cut(10, 10, 3)] == [10]
    assert [len(c) for c in cut(11, 10, 3)] == [10, 4]
    # The last chunk of 17 tokens holds nothing but the overlap of the one before.
    assert [len(c) for c in cut(17, 10, 3)] == [10, 10, 3]
    assert cut(17, 10, 3)[2] == ["w14", "w15", "w16"]
    empty = corpus.chunk_text(spark.createDataFrame([(1, "")], "id int, t string"), "t")
    assert [(r["chunk"], r["total_chunks"]) for r in empty.collect()] == [("", 1)]


def test_tokenizer_chunks_agree(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i * 7))) for i in range(1, 8)], "id int, t string")
    words = {}
    native = corpus.chunk_text(df, "t", 10, 3)
    table = {f"w{j}": j for j in range(100)}
    plugged = corpus.chunk_with_tokenizer(df, "t", lambda t: [table[w] for w in t.split()], lambda ids: " ".join(f"w{i}" for i in ids), 10, 3)
    assert rows(native.select("id", "chunk_num", "total_chunks", "chunk")) == rows(plugged.select("id", "chunk_num", "total_chunks", "chunk"))
    assert not words


def test_joined_lines_need_only_their_head(spark):
    df = spark.range(2000).select(F.lit("k").alias("k"), F.col("id").alias("o"), F.when(F.col("id") % 2 == 0, "").otherwise("x").alias("line"))
    want = " ".join("" if i % 2 == 0 else "x" for i in range(2000))
    assert corpus.joined_lines(df, ["k"], "line", ["o"]).first()["text"] == want[:497] + "..."
    assert corpus.joined_lines(df.limit(3), ["k"], "line", ["o"]).first()["text"] == " x "


def test_entity_documents(spark):
    df = spark.createDataFrame([("1", "A", None, "0", ""), ("2", "B", "Given.", "5", "red"), ("3", None, "x", "1", "y")], "id string, name string, d string, n string, c string")
    got = corpus.entity_documents(df, "thing", "id", "name", F.concat("name", F.lit(" is a thing.")), [("n", "Age: ", "."), ("c", "Colour: ", ".")], "d", ["c"])
    assert [(r["doc_id"], r["text"], r["metadata"]) for r in got.orderBy("doc_id").collect()] == [("thing_1", "A is a thing.", '{"c":""}'), ("thing_2", "Given.", '{"c":"red"}')]


def test_ledger(spark):
    prices = spark.createDataFrame([("big", 1.0, 2.0), ("small", 0.1, 0.2)], "model string, input double, output double")
    usage = spark.createDataFrame([("s", i, m, 2000, 1000) for i, m in enumerate(["big", "big", "small", "other", "big", "big", "big"])], "s string, i int, model string, input_tokens int, output_tokens int")
    plain = corpus.running_cost_ledger(usage, prices, "s", "i", "model", "small", limit=20.0).orderBy("i").collect()
    assert [round(r["cost"], 6) for r in plain] == [4.0, 4.0, 0.4, 0.4, 4.0, 4.0, 4.0]
    assert [r["thresholds_crossed"] for r in plain] == [[], [5.0], [], [], [10.0], [15.0], []]
    assert [r["rejected"] for r in plain] == [False] * 6 + [True]
    assert [round(r["session_total"], 6) for r in plain] == [4.0, 8.0, 8.4, 8.8, 12.8, 16.8, 16.8]


def test_ledger_admits_cheaper_calls_after_a_rejection(spark):
    prices = spark.createDataFrame([("big", 1.0, 2.0), ("small", 0.1, 0.2)], "model string, input double, output double")
    calls = [(s, i, m, 2000, 1000) for s in ("s", None) for i, m in enumerate(["big", "big", "big", "small", "small", "big"])]
    usage = spark.createDataFrame(calls, "s string, i int, model string, input_tokens int, output_tokens int")
    got = corpus.running_cost_ledger(usage, prices, "s", "i", "model", "small", limit=9.0).orderBy("s", "i").collect()
    assert [r["rejected"] for r in got] == [False, False, True, False, False, True] * 2
    assert [round(r["session_total"], 6) for r in got] == [4.0, 8.0, 8.0, 8.4, 8.8, 8.8] * 2


def plain_rejected(costs, limit):
    total, out = 0.0, []
    for i, c in enumerate(costs):
        if total + c >= limit:
            out.append(i)
        else:
            total += c
    return out


def test_rejected_calls_of_many_sessions_against_a_loop(spark):
    rng = random.Random(4)
    sessions = {f"s{k}": [rng.choice([0.0, 0.25, 1.0, 3.0, 7.5, 40.0]) for _ in range(rng.randint(0, 60))] for k in range(30)}
    sessions |= {"hot": [rng.choice([0.125, 0.5, 2.0]) for _ in range(3000)], "slow": [x for k in range(12) for x in (1.0, 19.5 - k)], "low": [0.25] * 50}
    data, row = [], 0
    for name, costs in sessions.items():
        for c in costs:
            data.append((name, row, c))
            row += 1
    first = {name: min((r for s, r, _ in data if s == name), default=0) for name in sessions}
    calls = spark.createDataFrame(data, "_of string, _row bigint, cost double").repartition(5)
    for chunk in (7, 100_000):
        got = corpus.rejected_calls(calls, 20.0, chunk)
        want = {(name, first[name] + i) for name, costs in sessions.items() for i in plain_rejected(costs, 20.0)}
        assert {(r["_of"], r["_row"]) for r in got.collect()} == want
    assert corpus.rejected_calls(calls.limit(0), 20.0).count() == 0


def test_joined_lines_count_blanks_and_skip_nulls(spark):
    blank = [("blank", i, "") for i in range(600)]
    holes = [("holes", i, None) for i in range(550)] + [("holes", 550, "real"), ("holes", 551, "text")]
    edge = [("edge", i, "") for i in range(501)] + [("none", 0, None)]
    df = spark.createDataFrame(blank + holes + edge, "k string, i int, line string")
    got = {r["k"]: r["text"] for r in corpus.joined_lines(df, ["k"], "line", ["i"]).collect()}
    assert got == {"blank": " " * 497 + "...", "holes": "real text", "edge": " " * 500, "none": ""}


def test_lexicon_scores_every_document_and_label(spark):
    docs = spark.createDataFrame([(1, "good day"), (2, "nothing"), (3, None)], "id int, t string")
    lexicon = spark.createDataFrame([("good", "joy", 1.0), ("grim", "fear", 1.0)], "word string, label string, weight double")
    got = {(r["id"], r["label"]): r["score"] for r in corpus.lexicon_scores(docs, "id", "t", lexicon).collect()}
    assert got == {(i, x): 0.5 if (i, x) == (1, "joy") else 0.0 for i in (1, 2, 3) for x in ("joy", "fear")}


def test_scorer_contract(spark):
    def scorer(texts):
        assert all(t.strip() and len(t.split()) <= 450 for t in texts)
        return [{"joy": len(t.split()) / 1000} for t in texts]

    df = spark.createDataFrame([(1, "a b"), (2, "  "), (3, None), (4, "w " * 500)], "id int, t string")
    got = {r["id"]: (r["emotion_joy"], r["emotion_fear"]) for r in corpus.score_text(df, "t", scorer, ["joy", "fear"]).collect()}
    assert got == {1: (0.002, 0.0), 2: (0.0, 0.0), 3: (0.0, 0.0), 4: (0.45, 0.0)}


def test_rubric(spark):
    text = "Correlation r = 0.61, p < 0.05. compound_sentiment and emotional range. I imagine this 'a long quotation' in the Archive at minute 5"
    df = spark.createDataFrame([("q", text, ["range", "none"])], "c string, t string, e array<string>")
    got = corpus.rubric_score(df, "t", ["Archive"], "e").first()
    assert (got["citation_count"], got["stat_count"], got["metric_count"]) == (2, 3, 2)
    assert got["validation_score"] == pytest.approx(0.15 + 0.25 + 0.25 + 0.25 + 0.05) and got["passed"] is True
    assert got["missing_terms"] == ["none"]


def test_safe_select(spark):
    spark.range(500).createOrReplaceTempView("allowed_view")
    for by_text in (True, False):
        assert reports.safe_select(spark, "select id from allowed_view", ["allowed_view"], by_text=by_text).count() == 100
        assert reports.safe_select(spark, "select id from allowed_view limit 300;", ["allowed_view"], by_text=by_text).count() == 300
        for bad in ["", "delete from allowed_view", "select 1", "with x as (select 1) select 1"]:
            with pytest.raises(ValueError):
                reports.safe_select(spark, bad, ["allowed_view"], by_text=by_text)
    with pytest.raises(ValueError):
        reports.safe_select(spark, "select created_at from allowed_view", ["allowed_view"], by_text=True)


def test_safe_select_reads_the_plan(spark):
    spark.range(5).selectExpr("id", "id AS created_at").createOrReplaceTempView("allowed_view")
    spark.range(3).createOrReplaceTempView("secret")
    good = [
        "SELECT created_at, 'drop table secret' AS t FROM allowed_view -- delete",
        "WITH secret AS (SELECT id FROM allowed_view) SELECT * FROM secret",
        "WITH a AS (SELECT id FROM allowed_view), b AS (SELECT * FROM a) SELECT (SELECT max(id) FROM b) AS m, id FROM Allowed_View",
        "SELECT id FROM allowed_view UNION ALL SELECT x.id FROM (SELECT id FROM allowed_view) x WHERE id IN (SELECT id FROM allowed_view)",
    ]
    assert [reports.safe_select(spark, q, ["allowed_view"]).count() for q in good] == [5, 5, 5, 10]
    bad = [
        "SELECT * FROM secret -- allowed_view", "SELECT * FROM parquet.`/tmp/x`", "SELECT id FROM allowed_view WHERE id IN (SELECT id FROM secret)",
        "WITH a AS (SELECT * FROM secret) SELECT * FROM allowed_view, a", "WITH a AS (SELECT * FROM b), b AS (SELECT id FROM allowed_view) SELECT * FROM a",
        "SELECT id, (WITH secret AS (SELECT 1 AS x) SELECT x FROM secret) FROM allowed_view UNION ALL SELECT id, 1 FROM secret",
        "SELECT reflect('java.lang.System', 'exit', 1), id FROM allowed_view", "CREATE VIEW v AS SELECT * FROM allowed_view", "INSERT INTO secret SELECT id FROM allowed_view",
        "CACHE TABLE allowed_view", "SELECT 1 AS allowed_view",
    ]
    for query in bad:
        with pytest.raises(ValueError):
            reports.safe_select(spark, query, ["allowed_view"])


def test_criteria_and_lookup(spark):
    df = spark.createDataFrame([("a", "X", 2001, 90), ("b", "x", 1999, 95), ("c", "Y", 2005, None)], "id string, director string, release_year int, rt_score int")
    assert [r["id"] for r in reports.find_by_criteria(df, ("director", "X")).collect()] == ["a", "b"]
    assert [r["id"] for r in reports.find_by_criteria(df, min_year=("release_year", 2000), min_rating=("rt_score", 50)).collect()] == ["a"]
    with pytest.raises(ValueError):
        reports.find_by_criteria(df)
    with pytest.raises(ValueError):
        reports.find_by_criteria(df, min_rating=("rt_score", 101))
    assert reports.entity_lookup(df, {"id": "C"}, ["rt_score"], {"rt_score": -1}).first()["rt_score"] == -1


def test_token_lengths_turn_one_text_at_a_time_into_a_string():
    import tracemalloc

    import pyarrow as pa

    texts = pa.array([None, "", "a b", "x" * 100_000] * 100)
    tracemalloc.start()
    got = corpus.token_lengths(texts, lambda t: t.split(" ")).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [0, 0, 2, 1] * 100 and peak < 2_000_000
