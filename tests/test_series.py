import random

import pandas as pd
import pytest
from conftest import plan_of, rows
from pyspark.sql import functions as F

from strandline.operators import correlation, ordered, profiles, series


def walk(spark, keys=3, n=60, seed=7):
    rng = random.Random(seed)
    data = []
    for k in range(keys):
        t = 0
        for _ in range(n):
            t += rng.choice([1, 1, 1, 2, 9])
            data.append((f"k{k}", t, rng.randint(0, 9) / 10, rng.randint(0, 5) / 7))
    return spark.createDataFrame(data, "k string, t long, x double, y double")


@pytest.mark.parametrize("window", [3, 4, 7, 10])
def test_rolling_matches_pandas(spark, window):
    df = walk(spark)
    got = series.rolling_mean_window(df, ["k"], "t", ["x"], window).toPandas().sort_values(["k", "t"])
    want = df.toPandas().sort_values(["k", "t"])
    want["x"] = want.groupby("k")["x"].transform(lambda s: s.rolling(window, center=True, min_periods=1).mean())
    pd.testing.assert_series_equal(got["x"].reset_index(drop=True), want["x"].reset_index(drop=True), rtol=1e-9)


def test_rolling_mean_of_a_constant(spark):
    flat = walk(spark).withColumn("x", F.lit(0.25))
    assert {r["x"] for r in series.rolling_mean(flat, ["k"], "t", ["x"]).collect()} == {0.25}


def test_multi_window_needs_one_exchange(spark):
    plan = plan_of(series.multi_window_smooth(walk(spark), ["k"], "t", "x"))
    assert plan.count("Exchange hashpartitioning") == 1
    plan = plan_of(series.methodology_metrics(walk(spark).withColumn("d", F.lit(50)), ["k"], "t", "x", "d"))
    assert plan.count("Exchange hashpartitioning(k") <= 2


def test_unpivot_then_pivot_is_identity(spark):
    df = walk(spark)
    back = series.unpivot_dims(df, ["k", "t"], ["x", "y"]).groupBy("k", "t").pivot("dimension", ["x", "y"]).agg(F.first("score"))
    assert rows(back) == rows(df)


def test_top_k_limits_before_the_shuffle(spark):
    plan = plan_of(ordered.top_k(walk(spark), ["k"], [F.col("x").desc(), F.col("t").asc()], 5))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_peaks_break_ties_by_time(spark):
    df = spark.createDataFrame([("a", 3, 0.5), ("a", 1, 0.5), ("a", 2, 0.4)], "k string, t long, x double")
    got = series.peaks_per_dimension(df, ["k"], "t", ["x"], k=2).orderBy("peak_rank").collect()
    assert [(r["t"], r["peak_rank"], r["peak_id"]) for r in got] == [(1, 1, "a_x_1"), (3, 2, "a_x_3")]


def test_chunked_operators_equal_plain_windows(spark):
    df = walk(spark, keys=2, n=80).unionByName(walk(spark, keys=1, n=5, seed=1).withColumn("k", F.lit(None).cast("string")))
    w = series.Window.partitionBy("k").orderBy("t")
    chunk = F.floor(F.col("t") / 7)
    prev = ordered.chunked_previous(df, ["k"], ["t"], "x", "p", chunk)
    assert rows(prev) == rows(df.withColumn("p", F.lag("x").over(w)))
    total = ordered.chunked_running_sum(df, ["k"], ["t"], F.col("t"), "s", chunk)
    assert rows(total) == rows(df.withColumn("s", F.sum("t").over(w)))
    lines = df.withColumn("e", F.col("t") + F.col("x"))
    assert rows(series.gaps(lines, ["k"], "t", "e", 1.5, 5)) == rows(series.gaps(lines, ["k"], "t", "e", 1.5))
    assert rows(series.cluster_peaks(df, ["k"], "t", "x", 5, 6)) == rows(series.cluster_peaks(df, ["k"], "t", "x", 5))
    plain = series.sequence_check(df, ["k"], ["t"], "t")
    assert rows(series.sequence_check_chunked(df, ["k"], ["t"], "t", chunk)) == rows(plain)


def test_global_row_ids(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5003).alias("v"))
    out = ordered.global_row_ids(df, ["v"], "n", 5)
    got = [(r["v"], r["n"]) for r in out.orderBy("v").collect()]
    assert [n for _, n in got] == list(range(1, 5001)) and got == sorted(got)
    assert "SinglePartition" not in plan_of(out.select("v"))


def test_nearest_lines(spark):
    peaks = spark.createDataFrame([("a", 60.0)], "k string, c double")
    lines = spark.createDataFrame([("a", s, i) for i, s in enumerate([44.9, 45.0, 59.0, 61.0, 70.0, 75.0, 75.1])], "k string, s double, i int")
    got = series.nearest_lines(peaks, lines, ["k"], "c", "s", 15.0, 3, tie="i")
    assert [r["s"] for r in got.orderBy("rank").collect()] == [59.0, 61.0, 70.0]
    every = series.nearest_lines(peaks, lines, ["k"], "c", "s", 15.0, 99, tie="i")
    assert sorted(r["s"] for r in every.collect()) == [45.0, 59.0, 61.0, 70.0, 75.0]
    assert "CartesianProduct" not in plan_of(every) and "NestedLoop" not in plan_of(every)


def test_longest_lines_placeholder(spark):
    lines = spark.createDataFrame([("a", 0, "short", 1), ("a", 0, "x" * 90, 2), ("a", 1, "  ", 3)], "k string, m long, t string, o int")
    wanted = spark.createDataFrame([("a", 0), ("a", 1)], "k string, m long")
    got = {r["m"]: r["excerpts"] for r in series.longest_lines(lines, ["k", "m"], "t", order="o", buckets=wanted).collect()}
    assert got == {0: ["x" * 77 + "...", "short"], 1: ["[No dialogue]"]}


def test_axis_extent_of_nothing(spark):
    assert tuple(series.axis_extent(walk(spark).limit(0), [], "t").first()) == (0, 0)


def test_baseline_diff_skips_zero_baseline(spark):
    df = spark.createDataFrame([("en", 1.0, 0.0), ("fr", 1.5, 3.0), ("es", 1.05, 1.0)], "m string, x double, y double")
    got = profiles.baseline_diff(df, "m", ["x", "y"], "en").collect()
    assert [(r["m"], r["dimension"], round(r["difference_pct"], 6)) for r in got] == [("fr", "x", 50.0)]


def test_pair_difference_null_for_zero(spark):
    df = spark.createDataFrame([("f", "a", 0.0), ("f", "b", 1.0), ("f", "c", 1.3)], "f string, m string, x double")
    got = {(r["member_a"], r["member_b"]): (r["percent_difference"], r["is_significant"]) for r in profiles.pair_difference(df, ["f"], "m", ["x"]).collect()}
    assert got == {("a", "b"): (None, False), ("a", "c"): (None, False), ("b", "c"): (30.0, True)}


def test_constant_member_has_no_correlation(spark):
    df = spark.createDataFrame([("f", t, m, 1.0 if m == "a" else float(t)) for t in range(4) for m in "ab"], "f string, t long, m string, v double")
    aligned = correlation.align_members(df, ["f"], "t", "m", "v", ["a", "b"])
    assert correlation.pairwise_correlation(aligned, ["f"], ["a", "b"]).first()["r"] is None


def test_level_is_summed_along_time(spark):
    """The class at a threshold hangs on the last bit of a sum, so it mustn't hang on the order of rows."""
    rng = random.Random(3)
    data = [(f"k{k}", t, rng.choice([-1, 1]) * rng.randint(1, 9999) / 997) for k in range(40) for t in range(30)] + [("gap", 1, None), ("gap", 2, 0.5)]
    want = {}
    for k, t, x in sorted(data, key=lambda r: (r[0], r[1])):
        last = 2 if k == "gap" else 29
        for name, held in (("avg_compound", True), ("beginning", 10 * t <= last), ("ending", 10 * t >= 9 * last)):
            total, n = want.get((k, name), (0.0, 0))
            want[k, name] = (total + x, n + 1) if held and x is not None else (total, n)
    rng.shuffle(data)
    df = spark.createDataFrame([(*r, 1) for r in data], "k string, t long, x double, n long").repartition(7)
    got = profiles.sentiment_summary(df, ["k"], "t", F.col("x"), "x", "n").collect()
    assert {(r["k"], c): r[c] for r in got for c in ("avg_compound", "beginning", "ending")} == {key: total / n if n else None for key, (total, n) in want.items()}
