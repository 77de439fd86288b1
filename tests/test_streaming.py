"""Streams over the event log against the same question asked of the table."""

import pytest
from pyspark.sql import functions as F

from statuta import registry
from statuta.streaming import breaker

COLUMNS = ("loop", "event_id", "reason", "calls", "failures")


@pytest.fixture()
def log(spark, sf, tmp_path):
    """The event log in order of time, as three files; every event is there twice in its file."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    edges = events.approxQuantile("event_id", [0.33, 0.66], 0.0)
    by_time = events.selectExpr("*", "row_number() OVER (ORDER BY ts, event_id) AS place")
    for k in range(3):
        low, high = [0, *edges, 1e18][k : k + 2]
        by_time.filter((F.col("place") > low) & (F.col("place") <= high)).drop("place").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    return f"{tmp_path}/log", events


def drain(stream, tmp_path, name):
    stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()


def test_breaker_keeps_its_state_between_batches(spark, sf, log, tmp_path):
    path, events = log
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    rows = stream.select((F.col("user_id") % 500).alias("loop"), "ts", "event_id", F.col("event_type").isin("view", "error").alias("failed"))
    drain(breaker.trips(rows), tmp_path, "trips")
    got = {tuple(r) for r in spark.table("trips").select(*COLUMNS).collect()}
    assert got and got == {tuple(r) for r in registry.queries()["breaker_trips"](spark, sf).select(*COLUMNS).collect()}


def test_distinct_events(spark, log, tmp_path):
    path, events = log
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    drain(breaker.distinct_events(stream.unionByName(stream), ["event_id"]), tmp_path, "once")
    assert spark.table("once").count() == events.select("event_id").distinct().count()


def test_closed_sessions(spark, sf, log, tmp_path):
    path, events = log
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    drain(breaker.session_counts(stream, "user_id"), tmp_path, "closed")
    got = {(r.user_id, r.began, r.n) for r in spark.table("closed").withColumn("began", F.unix_micros("began")).collect()}
    every = registry.queries()["sessions"](spark, sf)
    last = events.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0] - 86_400_000_000
    # what the watermark has passed is put out, and nothing else
    assert got == {(r.user_id, r.began, r.n) for r in every.collect() if r.closes <= last}
