import pytest
from conftest import rows
from pyspark.sql import functions as F

from strandline.operators import quality

GOOD = "1\n00:00:01,000 --> 00:00:02,500\n<i>Hello</i>\nworld\n\n2\n00:01:00,000 --> 00:01:02,000\nBye\n"


def check(spark, content):
    r = quality.format_check(spark.createDataFrame([("f", content)], "name string, content string"), "content").first()
    return r["valid"], r["errors"], r["entry_count"]


def test_format_check(spark):
    assert check(spark, GOOD) == (True, [], 2)
    assert check(spark, GOOD.replace("\n", "\r\n")) == (True, [], 2)
    bad = GOOD.replace("\n2\n", "\n3\n").replace("00:00:01,000 --> ", "00:00:01,000 -> ")
    assert check(spark, bad) == (
        False,
        ["Line 2: Invalid timestamp format: '00:00:01,000 -> 00:00:02,500'", "Line 6: Non-sequential subtitle number. Expected 2, got 3"],
        2,
    )
    assert check(spark, "1\n00:00:01,000 --> 00:00:02,500\n\n")[1] == ["Line 1: Subtitle 1 has no text content"]
    assert check(spark, "1")[1] == ["Line 1: Subtitle 1 missing timestamp"]
    assert check(spark, "intro\n\n1\n00:00:01,000 --> 00:00:02,500\nx")[1] == []
    assert check(spark, "") == (True, [], 0)


def test_timing_bands(spark):
    docs = spark.createDataFrame(
        [("a", 981.0, 990.0, 10), ("b", 979.0, 990.0, 10), ("c", 949.0, 990.0, 10), ("d", 990.0, 990.0, 10), ("e", None, None, 0), ("g", 1000.0, 800.0, 10)],
        "k string, duration double, last_end double, line_count int",
    ).withColumns({"negative_starts": F.lit(0), "gap_count": F.lit(1), "largest_gap": F.lit(130.0)})
    ref = spark.createDataFrame([(k, 1000.0) for k in "abceg"], "k string, runtime double")
    got = {r["k"]: r for r in quality.timing_drift(docs, ref, ["k"], "runtime").collect()}
    assert [got[k]["status"] for k in "abcdeg"] == ["PASS", "WARN", "FAIL", "FAIL", "FAIL", "WARN"]
    assert got["a"]["timing_drift_percent"] == 1.9 and got["d"]["issues"] == ["No documented length"]
    assert got["e"]["issues"] == ["No subtitles found in file"] and got["d"]["timing_drift_percent"] is None
    assert got["c"]["issues"] == ["Critical timing drift: 5.10% (subtitle: 949.0s, film: 1000s)"]
    assert got["g"]["warnings"][0].startswith("Last subtitle ends 200.0s (3.3 min) before film end")
    assert got["a"]["warnings"] == ["Found 1 gaps >2 minutes between subtitles (largest: 130.0s)"]


def test_group_drift(spark):
    df = spark.createDataFrame([("f", "en", 100.0), ("f", "fr", 110.0), ("g", "en", 50.0), ("h", "en", 100.0), ("h", "nl", 101.0)], "f string, m string, d double")
    got = {r["f"]: r for r in quality.cross_group_drift(df, ["f"], "m", "d").collect()}
    assert (got["f"]["status"], got["f"]["max_drift_percent"]) == ("FAIL", 4.76)
    assert (got["g"]["status"], got["g"]["max_drift_percent"], got["g"]["warning"]) == ("PASS", 0.0, "Only one member available")
    assert got["h"]["status"] == "PASS" and got["h"]["worst_member"] is None


def test_overrun(spark):
    df = spark.createDataFrame([("a", 110, 100), ("b", 111, 100), ("c", 5, None), ("d", 50, 100)], "k string, last int, want int")
    got = {r["k"]: r for r in quality.runtime_overrun(df, "last", "want").collect()}
    assert [got[k]["validation_status"] for k in "abcd"] == ["PASS", "FAIL", "UNKNOWN", "PASS"]
    assert got["a"]["requires_investigation"] is True and got["d"]["data_quality_score"] == 100.0
    assert got["b"]["data_quality_score"] == pytest.approx(89.0) and got["c"]["data_quality_score"] == 100.0
    summary = quality.with_summary_row(quality.runtime_overrun(df, "last", "want"), "k").filter("k = '_SUMMARY_'").first()
    assert (summary["total_combinations"], summary["pass_count"], summary["fail_count"], summary["pass_rate_pct"]) == (4, 2, 1, 50.0)


def test_rules_report_and_enforce(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "z")], "id int, kind string")
    rules = [
        {"name": "id", "kind": "not_null", "column": "id"}, {"name": "kind", "kind": "accepted_values", "column": "kind", "values": ["a", "b"]},
        {"name": "one", "kind": "unique", "columns": ["id"]}, {"name": "fine", "kind": "expression", "condition": F.col("kind") != ""},
        {"name": "ref", "kind": "relationship", "column": "id", "to": spark.range(5), "to_column": "id"},
    ]
    got = {r["rule"]: r["failures"] for r in quality.rule_failures(df, rules).collect()}
    assert got == {"id": 1, "kind": 1, "one": 1, "fine": 0, "ref": 0}
    with pytest.raises(Exception, match="quality rule failed"):
        quality.enforce(quality.rule_failures(df, rules)).collect()
    assert quality.enforce(quality.rule_failures(df, rules[3:])).count() == 2
    with pytest.raises(ValueError):
        quality.rule_failures(df, [{"name": "x", "kind": "y"}])


def test_duration_gate(spark):
    df = spark.createDataFrame([("a", 5, 10)], "k string, last int, want int")
    assert quality.duration_gate(df, "last", "want", "k").count() == 1
    with pytest.raises(Exception, match="series runs past its source: a"):
        quality.duration_gate(df.withColumn("last", F.lit(21)), "last", "want", "k").collect()


def test_counts_and_completeness(spark):
    t = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    got = quality.record_counts({"t": t, "u": t}, {"t": (2, 2), "u": (3, None)})
    assert rows(got) == [("t", 2, "2", "PASS"), ("u", 2, "3+", "WARN")]
    assert rows(quality.completeness({"t": (t, ["id", "name"])})) == [("t", "id", 100.0, "PASS"), ("t", "name", 50.0, "WARN")]
    assert quality.completeness({"t": (t.limit(0), ["id"])}).first()["completeness_pct"] == 0.0


def test_priorities(spark):
    res = spark.createDataFrame([("a", "PASS")] * 2 + [("a", "FAIL")] * 3 + [("b", "PASS")], "e string, s string")
    drift = spark.createDataFrame([("a", 6.0), ("b", None)], "e string, d double")
    feat = spark.createDataFrame([("a",)], "e string")
    got = {r["e"]: (r["priority_score"], r["priority_category"]) for r in quality.priority_score(res, "e", "s", drift, "d", feat).collect()}
    assert got == {"a": (85, "HIGH"), "b": (0, "LOW")}
    t = spark.createDataFrame([("FAIL", 6.0, 12.0, True), ("PASS", 1.0, 0.0, True), ("WARN", None, None, None)], "s string, d double, g double, f boolean")
    scored = quality.target_score(t, "s", "d", "g", "f").collect()
    assert [(r["priority_score"], r["reason"]) for r in scored] == [
        (95, "Featured film, FAIL status (6.0% drift), High cross-lang drift (12.0%)"), (20, "WARN status (0.0% drift)"),
    ]


def test_candidates(spark):
    df = spark.createDataFrame([("k", 1, 500, True, 90.0), ("k", 2, 10, False, 120.0), ("k", None, 99999, False, 100.0)], "k string, id int, n int, hi boolean, run double")
    best = quality.best_candidate(df, ["k"], "id", "n", "hi").first()
    assert (best["id"], best["score"]) == (2, 10010)
    near = quality.closest_candidate(df.filter("id is not null").withColumn("want", F.lit(100.0)), ["k"], "id", "run", "want", 10.0).first()
    assert (near["id"], near["drift_percent"], near["within_tolerance"]) == (1, 10.0, True)


def test_compare_runs_by_whole_numbers(spark):
    """Figures that lie on the half of the last digit, in any order of rows."""
    drifts = [0.0001, 12.3451, 3.3333, 7.0] * 5
    old = [("a", "PASS" if k % 3 else "fail", d) for k, d in enumerate(drifts)] + [("b", "PASS", None)]
    new = [("a", "pass", 0.0) for _ in range(16)] + [("c", "WARN", 1.0)]
    schema = "m string, status string, drift double"
    for parts in (1, 7):
        a, z = (spark.createDataFrame(x, schema).repartition(parts) for x in (old, new))
        got = {r["m"]: r for r in quality.compare_runs(a, z, "status", "drift", "m").collect()}
        assert got["a"]["baseline_pass_rate"] == 65.0 and got["a"]["pass_rate_change"] == 35.0
        assert got["a"]["drift_reduction"] == 5.66963  # 113.3925 / 20 is 5.669625
        assert (got["b"]["new_pass_rate"], got["b"]["baseline_pass_rate"], got["b"]["pass_rate_change"], got["b"]["target_met"]) == (0.0, 100.0, 0.0, False)
        assert (got["_ALL_"]["baseline_total"], got["_ALL_"]["new_total"], got["_ALL_"]["target_met"]) == (21, 17, True)
