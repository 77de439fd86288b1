"""Monitors over the event log as Structured Streaming queries (inventory 2.13)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

LATE = "1 day"


def windowed_counts(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Counts by event type and window of event time; works on streams and tables alike."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("highest"))


def monitor(spark: SparkSession, path: str, width: str = "1 day") -> DataFrame:
    """Drains the log at `path` as a stream. Each batch's updates are written; the last one of a window counts."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = root or tempfile.mkdtemp(prefix="statuta-")
    out = f"{root.rstrip('/')}/monitor-{uuid.uuid4().hex}"
    folder, _, name = path.rpartition("/")
    events = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", name).parquet(folder)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.select(F.col("window.start").alias("start"), "event_type", "n", "highest", F.lit(batch_id).alias("batch")).write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")

    stream = windowed_counts(events, width).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    rows = spark.read.schema("start timestamp, event_type string, n long, highest double, batch long").parquet(f"{out}/rows")
    last = rows.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "highest"), "batch").alias("x"))
    return last.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "x.n", "x.highest")
