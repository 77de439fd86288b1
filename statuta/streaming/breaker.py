"""A circuit breaker for each loop of the event log, with its state kept by the stream (inventory 2.13.7, 2.13.8)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Failures in a row, and the share of failures after so many calls, that open the breaker.
IN_A_ROW, RATE_MOST, CALLS_LEAST = 3, 0.8, 10
OUTPUT = "loop long, event_id long, reason string, calls long, failures long"
STATE = "calls long, failures long, in_a_row long, open boolean"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Counts on from the state; the first trip is put out, and the loop stays open from then on. A loop's rows of one micro-batch
    are sorted by time, as far as they came together; its state is four numbers."""
    calls, failures, in_a_row, is_open = state.get if state.exists else (0, 0, 0, False)
    rows = [] if is_open else sorted((r for b in batches for r in zip(b["ts"], b["event_id"], b["failed"])))
    for _, event_id, failed in rows:
        calls, failures, in_a_row = calls + 1, failures + int(failed), in_a_row + 1 if failed else 0
        reason = "consecutive" if in_a_row >= IN_A_ROW else "rate" if calls >= CALLS_LEAST and failures / calls > RATE_MOST else None
        if failed and reason:
            is_open = True
            yield pd.DataFrame({"loop": [key[0]], "event_id": [event_id], "reason": [reason], "calls": [calls], "failures": [failures]})
            break
    state.update((calls, failures, in_a_row, is_open))


def trips(events: DataFrame) -> DataFrame:
    """From a stream of loop, ts, event_id and failed: the event at which each loop's breaker opens."""
    rows = events.select(F.col("loop").cast("long").alias("loop"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "failed")
    return rows.groupBy("loop").applyInPandasWithState(_advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def distinct_events(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Events once for each key; a key is forgotten when the watermark has passed it, so the state stays bounded (2.13.8, 2.13.10)."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def session_counts(events: DataFrame, key: str, gap: str = "1 day", late: str = "1 day") -> DataFrame:
    """Sessions of a key, closed by a gap of silence (2.13.17); for streams in append mode."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("began"), F.col("w.end").alias("closes"), "n")
