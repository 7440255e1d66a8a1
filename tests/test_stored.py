"""Keyed loads, gates, clustered marts, sketches and versions."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from strandline.operators import quality, sketches, success, versions
from strandline.session import scratch_path
from strandline.sources import clustered, gates, keyed


# --- keyed loads -----------------------------------------------------------------------------


def orders(spark, keys, tag="a"):
    return spark.createDataFrame([(k, f"{tag}{k}") for k in keys], "k long, v string")


def test_load_reads_only_the_buckets_it_meets(spark):
    path = scratch_path(spark, "t-keyed")
    first = keyed.load_keyed(orders(spark, range(500)), path, ["k"], 32)
    assert (first.brought, first.appended, first.files_read) == (500, 500, 0)
    second = keyed.load_keyed(orders(spark, [3, 7, 1000], "b"), path, ["k"], 32)
    got = keyed.keyed_table(spark, path, orders(spark, [1]).schema)
    assert second.brought == 3 and second.appended == 1 and second.files_read <= 3 and len(got.inputFiles()) >= 32
    assert got.count() == 501 and got.where("k = 3").first()["v"] == "a3" and got.where("k = 1000").first()["v"] == "b1000"


def test_load_repeated_after_a_failure(spark):
    """A load that died behind its first committed folders is simply run again."""
    path = scratch_path(spark, "t-keyed")
    whole = orders(spark, range(100))
    part = whole.withColumn("bucket", keyed.bucket_of(["k"], 8)).where("bucket < 3")
    part.write.partitionBy("bucket").parquet(path)
    again = [keyed.load_keyed(whole, path, ["k"], 8).appended for _ in range(2)]
    assert again == [100 - part.count(), 0] and rows(keyed.keyed_table(spark, path, whole.schema).select("k")) == sorted([(k,) for k in range(100)], key=repr)


def test_null_keys_and_empty_loads(spark):
    path = scratch_path(spark, "t-keyed")
    odd = spark.createDataFrame([(None, "x", 1), (None, "x", 2), (1, None, 3), (1, "x", 4)], "a int, b string, n int")
    assert keyed.load_keyed(odd.limit(0), path, ["a", "b"]).brought == 0
    assert [keyed.load_keyed(odd, path, ["a", "b"], 4).appended for _ in range(2)] == [3, 0]
    with pytest.raises(ValueError):
        keyed.load_keyed(odd.withColumn("bucket", F.lit(1)), path, ["a"])


def test_stream_loads_each_key_once(spark):
    source, path = scratch_path(spark, "t-arrivals"), scratch_path(spark, "t-keyed")
    for part in (range(50), range(25, 80), range(70, 90)):
        orders(spark, part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("k long, v string").option("maxFilesPerTrigger", 1).parquet(source)
    keyed.load_keyed_batches(stream, path, ["k"], scratch_path(spark, "t-state"), 8).awaitTermination(120)
    assert keyed.keyed_table(spark, path, orders(spark, [1]).schema).count() == 90
    loads = spark.read.parquet(f"{path}-loads")
    assert loads.count() == 3 and loads.agg(F.sum("appended"), F.sum("brought")).first() == (90, 125)


# --- gates -----------------------------------------------------------------------------------

SCHEMA = "k long, kind string, n int"


def rules():
    return [
        {"name": "key", "kind": "not_null", "column": "k"}, {"name": "kinds", "kind": "accepted_values", "column": "kind", "values": ["a", "b"]},
        {"name": "small", "kind": "expression", "condition": F.col("n") < 10},
    ]


def test_gate_counts_while_it_writes(spark):
    df = spark.createDataFrame([(1, "a", 1), (None, "c", 20), (3, None, None), (4, "b", 9)], SCHEMA)
    want = {r["rule"]: r["failures"] for r in quality.rule_failures(df, rules()).collect()}
    path = scratch_path(spark, "t-gate")
    bad = gates.gated_write(df, path, rules(), 1)
    assert (bad.total, bad.failures, bad.kept) == (4, want, False) and spark.read.schema(SCHEMA).parquet(path).count() == 0
    kept = gates.gated_write(df, path, rules(), 1, {"key": 1, "kinds": 1, "small": 2})
    assert kept.kept and spark.read.schema(SCHEMA).parquet(path).count() == 4
    # a repeated load takes the place of the earlier one, another is added
    gates.gated_write(df.where("n = 1"), path, rules(), 1)
    gates.gated_write(df.where("n = 9"), path, rules(), 2)
    assert rows(spark.read.schema(SCHEMA).parquet(path).select("k", "kind", "n")) == [(1, "a", 1), (4, "b", 9)]
    assert gates.gated_write(df.limit(0), path, rules(), 3).failures == {"key": 0, "kinds": 0, "small": 0}


def test_gate_scans_once_and_refuses_rules_over_rows(spark):
    source = scratch_path(spark, "t-source")
    spark.range(100).selectExpr("id AS k", "'a' AS kind", "1 AS n").write.parquet(source)
    watched, _ = gates.watched(spark.read.parquet(source), {"small": F.col("n") >= 10})
    plan = watched._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "CollectMetrics" in plan and "Exchange" not in plan
    with pytest.raises(ValueError):
        gates.gated_write(watched, source + "-x", [{"name": "u", "kind": "unique", "columns": ["k"]}])


def test_gate_of_every_micro_batch(spark):
    source, path = scratch_path(spark, "t-arrivals"), scratch_path(spark, "t-gate")
    for k, n in enumerate((1, 50, 2)):
        spark.createDataFrame([(k, "a", n)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    gates.stream_gated_write(stream, path, rules(), scratch_path(spark, "t-state")).awaitTermination(120)
    verdicts = spark.read.parquet(f"{path}-verdicts/*").where("rule = 'small'")
    assert sorted(r["failures"] for r in verdicts.collect()) == [0, 0, 1] and spark.read.schema(SCHEMA).parquet(path).count() == 2


# --- clustered marts --------------------------------------------------------------------------


def test_lookup_reads_few_row_groups(spark):
    rng = random.Random(1)
    data = [(f"Name_{rng.randint(0, 40)}", rng.randint(0, 999), k) for k in range(40_000)] + [(None, None, -1), (None, 3, -2)]
    df = spark.createDataFrame(data, "name string, score int, k int")
    path, plain = scratch_path(spark, "t-mart"), scratch_path(spark, "t-plain")
    clustered.write_clustered(df, path, ["name", "score"], files=4, group_bytes=1 << 16, page_rows=500)
    df.coalesce(4).write.parquet(plain)
    whole = spark.read.parquet(path)
    assert rows(whole.select("name", "score", "k")) == rows(df)
    for wanted, same in (({"name": "name_7"}, F.col("name") == "Name_7"), ({"score": 77}, F.col("score") == 77)):
        found = clustered.clustered_lookup(spark, path, wanted)
        assert rows(found) == rows(df.where(same)) and clustered.rows_scanned(found) < 0.5 * len(data)
    assert clustered.rows_scanned(spark.read.parquet(plain).where("score = 77")) > 0.9 * len(data)
    assert clustered.clustered_lookup(spark, path, {"name": None}).count() == len(data)


def test_interleaved_key_keeps_order_in_both_columns(spark):
    df = spark.createDataFrame([(a, z) for a in range(16) for z in range(16)], "a int, z int")
    cuts = {c: list(range(1, 16)) for c in "az"}
    got = {(r["a"], r["z"]): r["key"] for r in df.withColumn("key", clustered.interleaved(cuts, 4)).collect()}
    assert sorted(got.values()) == list(range(256)) and got[0, 1] == 1 and got[1, 0] == 2 and got[15, 15] == 255


# --- sketches --------------------------------------------------------------------------------


def test_distinct_counts_from_stored_sketches(spark):
    df = spark.range(60_000).selectExpr("id % 3 AS member", "id % 7 AS day", "id % 11000 AS user", "cast(id AS double) AS x")
    path = scratch_path(spark, "t-sketches")
    for part in ("day < 3", "day >= 3", "day = 2"):
        sketches.append_sketches(df.where(part), path, ["member"], "day", item="user", value="x")
    stored = spark.read.parquet(path)
    assert stored.count() == 21 and stored.agg(F.sum("rows")).first()[0] == 60_000
    for keys in ([], ["member"], ["day"]):
        exact = {tuple(r[k] for k in keys): r["n"] for r in df.groupBy(*keys).agg(F.countDistinct("user").alias("n")).collect()}
        got = {tuple(r[k] for k in keys): r["n"] for r in sketches.rolled_up(stored, keys).select(*keys, sketches.distinct_count().alias("n")).collect()}
        assert exact.keys() == got.keys() and all(abs(got[k] - n) <= 0.05 * n for k, n in exact.items())


def test_tiers_within_the_rank_error(spark):
    df = spark.range(20_000).selectExpr("id", "pow(id % 5003, 1.5) AS x").unionAll(spark.createDataFrame([(-1, None), (-2, float("nan"))], "id long, x double"))
    kept = df.where("x IS NULL OR NOT isnan(x)")
    sketch = sketches.sketched(df.withColumn("day", F.col("id") % 5), ["day"], value="x")
    both = success.quartile_tier(sketches.sketched_tiers(kept, "x", sketch), "x", "exact")
    apart = both.agg(F.avg((F.col("tier") != F.col("exact")).cast("double"))).first()[0]
    assert apart <= 3 * 0.012  # three borders, each within its rank error
    assert both.where("id = -1").first()["tier"] == "bottom_quartile"
    by_key = sketches.sketched_tiers(df.where("id >= 0").withColumn("day", F.col("id") % 5), "x", sketch, ["day"])
    assert by_key.groupBy("day").agg(F.count(F.when(F.col("tier") == "top_quartile", 1)).alias("n")).where("n BETWEEN 900 AND 1100").count() == 5


# --- versions --------------------------------------------------------------------------------


def test_versions_against_a_plain_comparison(spark):
    rng = random.Random(9)
    old = {(k, k % 3 or None): (k, rng.random()) for k in range(400)}
    new = {k: v for k, v in old.items() if k[0] % 57}
    new |= {k: (None, v[1]) for k, v in new.items() if k[0] % 41 == 3}
    new |= {k: (v[0], v[1] + 1) for k, v in new.items() if k[0] % 83 == 3}
    new |= {(1000 + k, None): (k, 0.5) for k in range(5)} | {(None, 1): (1, 1.0)}
    frame = lambda d: spark.createDataFrame([(*k, *v) for k, v in d.items()], "a int, b int, x int, y double")
    want = [(*k, "added", ()) for k in new.keys() - old.keys()] + [(*k, "removed", ()) for k in old.keys() - new.keys()]
    for k in old.keys() & new.keys():
        apart = tuple(c for c, p, q in zip("xy", old[k], new[k]) if p != q)
        want += [(*k, "changed", apart)] if apart else []
    plain = lambda df: sorted(((r[0], r[1], r[2], tuple(r[3])) for r in df.collect()), key=repr)
    assert plain(versions.compare_versions(frame(old), frame(new), ["a", "b"])) == sorted(want, key=repr)
    assert versions.compare_versions(frame(old), frame(old), ["a", "b"]).count() == 0


def test_stored_versions_read_in_proportion_to_what_changed(spark):
    old = spark.range(20_000).selectExpr("id AS k", "id * 2 AS v")
    new = old.withColumn("v", F.when(F.col("k").isin(5, 77), 0).otherwise(F.col("v")))
    paths = [scratch_path(spark, "t-version") for _ in range(3)]
    for side, path in zip((old, new, old), paths):
        versions.write_version(side, path, ["k"])
    found, files = versions.compare_stored(paths[0], paths[1], old.schema, spark, ["k"])
    assert rows(found.select("k", "change")) == [(5, "changed"), (77, "changed")]
    assert len(files) == 4 and len(spark.read.parquet(paths[0]).inputFiles()) >= 200
    assert versions.compare_stored(paths[0], paths[2], old.schema, spark, ["k"])[1] == []
    sums = [versions.summed(side, ["k"]) for side in (old, new)]
    levels = {r["level"]: (r["nodes"], r["differing"]) for r in versions.tree_levels(*sums).collect()}
    assert levels[0] == (1, 1) and levels[4] == (16, levels[4][1]) and levels[12][1] == 2 and levels[8][1] == 2
