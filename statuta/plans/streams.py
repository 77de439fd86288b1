"""Queries that drain a stream (inventory 2.13)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.steps import shared_folder
from ..registry import query
from ..streaming.controls import drained
from ..streaming.monitor import monitor


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, max(value) AS highest FROM events GROUP BY 1, 2")
def event_monitor(spark, d):
    """2.13: event counts by day and type, from a stream with a watermark."""
    return monitor(spark, f"{d}/events.parquet")


@query()
def job_controls(spark, d):
    """2.13.14: the event log as work of a hundred jobs with rows that pause, resume and cancel them; tests hold the stream against a
    loop over the table."""
    folder, _, name = f"{d}/events.parquet".rpartition("/")
    events = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).option("pathGlobFilter", name).parquet(folder)
    kind = F.when(F.col("event_type") == "error", "pause").when(F.col("event_type") == "signup", "resume").when((F.col("event_type") == "purchase") & (F.col("value") > 95), "cancel").otherwise("work")
    rows = events.select((F.col("user_id") % 100).alias("job"), "ts", kind.alias("kind"), F.col("event_id").alias("item"))
    return drained(spark, rows, f"{shared_folder(spark)}/controls-{uuid.uuid4().hex}")
