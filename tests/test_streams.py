from conftest import rows
from pyspark.sql import functions as F

from strandline.operators import series
from strandline.plans import vector_queries
from strandline.session import scratch_path
from strandline.streaming import streams


def source(spark, tmp_path, batches):
    folder = str(tmp_path / "in")
    for b in batches:
        spark.createDataFrame(b, "k string, sec long, x double").withColumn("ts", F.timestamp_seconds("sec")).coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    return spark.read.parquet(folder), spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_minutes_equal_the_batch_twin(spark, tmp_path):
    batch, stream = source(spark, tmp_path, [[("a", 5, 0.2), ("a", 59, 0.4), ("b", 61, 1.0)], [("a", 70, 0.5), ("z", 10_000, 0.0)]])
    out = streams.run_to_parquet(streams.stream_minute_aggregate(stream, ["k"], "ts", ["x"], "1 minute", "1 hour"), "minutes", 120)
    got = spark.read.parquet(out).select("k", F.floor(F.unix_timestamp("bucket_start") / 60).alias("m"), "dialogue_count", F.round("x", 9))
    want = series.minute_aggregate(batch.filter("k <> 'z'"), ["k"], "sec", ["x"]).select("k", "minute_offset", "dialogue_count", F.round("x", 9))
    assert rows(got) == rows(want)


def test_duplicates_and_gate(spark, tmp_path):
    batch, stream = source(spark, tmp_path, [[("a", 1, 0.5), ("a", 1, 0.5), ("b", 2, 1.5)], [("a", 3, 0.5), ("c", 4, None)]])
    once = spark.read.parquet(streams.run_to_parquet(streams.stream_idempotent(stream, ["k"], "ts", "1 hour"), "once", 120))
    assert sorted(r["k"] for r in once.collect()) == ["a", "b", "c"]
    path = scratch_path(spark, "gate")
    streams.stream_quality_gate(stream, (F.col("x") < 0) | (F.col("x") > 1), path, scratch_path(spark, "gate-state")).awaitTermination(120)
    got = spark.read.option("basePath", path).parquet(path)
    assert rows(got.select(batch.columns)) == rows(batch) and got.where("side = 'quarantine'").count() == 2
    assert got.select("batch").distinct().count() == 2


def test_batch_load_is_idempotent(spark, tmp_path):
    _, stream = source(spark, tmp_path, [[("a", 1, 0.5)], [("a", 9, 0.7), ("b", 2, 1.0)]])
    path = scratch_path(spark, "stored")
    query = streams.load_batches(stream, path, ["k"], scratch_path(spark, "state"))
    query.awaitTermination(120)
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == ["a", "b"]


def test_a_closing_arrival_completes_open_windows(spark):
    df = spark.createDataFrame([("a", 5, 0.2), ("a", 70, 0.5), ("b", 130, 1.0)], "k string, sec long, x double").withColumn("ts", F.timestamp_seconds("sec"))
    marker = df.limit(1).select(F.lit(None).cast("string").alias("k"), F.lit(10**9).alias("sec"), F.lit(0.0).alias("x"), F.timestamp_seconds(F.lit(10**9)).alias("ts"))
    path = streams.staged_arrivals(df, F.floor(F.col("sec") / 100), [0, 1], marker, "arrivals")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = streams.run_to_parquet(streams.stream_minute_aggregate(stream, ["k"], "ts", ["x"], "1 minute", "3 minutes"), "closed", 120)
    assert sorted((r["k"], r["dialogue_count"]) for r in spark.read.parquet(out).collect()) == [("a", 1), ("a", 1), ("b", 1)]


def test_events_over_years_are_each_loaded_once(spark, tmp_path, monkeypatch):
    """Any order of a part's files: the last part used to hold all that came after twenty days."""
    stamps = [f"timestamp_ntz'2023-12-0{1 + i % 9} 00:00:00' + make_dt_interval({i * 47 % 900})" for i in range(60)]
    rows_ = spark.range(60).select(
        F.col("id").alias("event_id"), F.expr(f"element_at(array({', '.join(stamps)}), cast(id + 1 as int))").alias("ts"),
        (F.col("id") % 7).alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"),
    )
    rows_.repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(vector_queries, "_FILE_BYTES", 2000)
    got = vector_queries.stream_idempotent_load(spark, str(tmp_path))
    assert sorted(r["event_id"] for r in got.collect()) == list(range(60))


def test_parts_are_micro_batches_however_many_files(spark, tmp_path, monkeypatch):
    events = spark.range(4000).select(
        F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id % 30 as int))").alias("ts"),
        (F.col("id") % 7).alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"),
    )
    events.repartition(6).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(vector_queries, "_FILE_BYTES", 8000)
    taken = []
    stream = vector_queries._event_stream(spark, str(tmp_path), again=True)
    stream.writeStream.foreachBatch(lambda df, n: taken.append(df.count())).option("checkpointLocation", scratch_path(spark, "parts")).trigger(availableNow=True).start().awaitTermination()
    assert len(taken) == 5 and sum(taken) == 8001
    assert len(list(tmp_path.glob("events.parquet/*.parquet"))) == 6
