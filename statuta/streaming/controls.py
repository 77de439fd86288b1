"""Jobs that are paused, resumed and cancelled by rows of a control stream beside their work (inventory 2.13.14).

Work and controls of a job meet in one stateful operator. Rows wait until the watermark has passed their tick, so rows that come late, but
not later than the watermark allows, act in the order of their own times, and the result is what a table of the whole log would give.
A pause ends by itself after a limit, by a timer, so no job is held for good by a lost row. State of a job: its status, the items held,
and the rows that still wait.

Rules: a paused job holds its items and does them when it goes on; a cancelled job drops what it holds and all that comes; pausing a paused
job, resuming a running one and any control after a cancellation change nothing; of one time controls come first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "job long, item long, at long, done_at long, outcome string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Milliseconds: rows of one tick share a timer; a pause lasts LIMIT at most.
TICK, LIMIT = 60_000, 6 * 3_600_000
#: Controls before work of the same time.
ORDER = {"pause": 0, "resume": 0, "cancel": 0, "work": 1}


class Job:
    """What a job does with rows in the order of their times; the same for streams and tables."""

    def __init__(self, status: str = "running", since: int = 0, held: list[tuple[int, int]] | None = None, limit: int = LIMIT):
        self.status, self.since, self.held, self.limit, self.out = status, since, held or [], limit, []

    def until(self, at: int) -> None:
        """Time goes on: a pause that has lasted its limit ends."""
        if self.status == "paused" and at >= self.since + self.limit:
            self._on(self.since + self.limit)

    def _on(self, at: int) -> None:
        self.out += [(item, when, at, "done") for item, when in self.held]
        self.status, self.held = "running", []

    def row(self, at: int, kind: str, item: int) -> None:
        self.until(at)
        if self.status == "cancelled":
            if kind == "work":
                self.out.append((item, at, at, "dropped"))
        elif kind == "work":
            if self.status == "paused":
                self.held.append((item, at))
            else:
                self.out.append((item, at, at, "done"))
        elif kind == "cancel":
            self.out += [(i, when, at, "dropped") for i, when in self.held]
            self.status, self.held = "cancelled", []
        elif kind == "pause" and self.status == "running":
            self.status, self.since = "paused", at
        elif kind == "resume" and self.status == "paused":
            self._on(at)


def tick(at: int) -> int:
    return -(-at // TICK) * TICK


class Controlled(StatefulProcessor):
    def __init__(self, limit: int = LIMIT):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", "status string, since long")
        self.held = handle.getListState("held", "item long, at long")
        self.waiting = handle.getListState("waiting", "at long, kind string, item long")
        self.next = handle.getValueState("next", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(a), str(k), int(i)) for b in rows for a, k, i in zip(b["at"], b["kind"], b["item"])]
        self.waiting.appendList(new)
        # one timer for all that waits: it does whatever is due, and sets the next one
        first = min((tick(a) for a, _, _ in new), default=None)
        known = self.next.get()[0] if self.next.exists() else None
        if first is not None and (known is None or first < known):
            self.handle.registerTimer(first)
            self.next.update((first,))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # all that the watermark has passed, not this timer's rows alone: a timer set on the way would wait for another batch
        now = timerValues.getCurrentWatermarkInMs()
        every = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in every if tick(r[0]) <= now), key=lambda r: (r[0], ORDER[r[1]], r[1], r[2]))
        status, since = self.status.get() if self.status.exists() else ("running", 0)
        job = Job(status, since, [tuple(r) for r in self.held.get()] if self.held.exists() else [], self.limit)
        for at, kind, item in due:
            job.row(at, kind, item)
        if job.status == "paused" and tick(job.since + self.limit) <= now:
            job.until(job.since + self.limit)
        rest = [r for r in every if tick(r[0]) > now]
        self.waiting.put(rest) if rest else self.waiting.clear()
        if rest:
            first = min(tick(r[0]) for r in rest)
            self.handle.registerTimer(first)
            self.next.update((first,))
        else:
            self.next.clear()
        self.held.put(job.held) if job.held else self.held.clear()
        self.status.update((job.status, job.since))
        if job.status == "paused":
            self.handle.registerTimer(tick(job.since + self.limit))
        if job.out:
            yield pd.DataFrame([(key[0], *row) for row in job.out], columns=["job", "item", "at", "done_at", "outcome"])
        else:
            yield pd.DataFrame()

    def close(self) -> None:
        pass


def controlled(rows: DataFrame, late: str = "1 day", limit: int = LIMIT) -> DataFrame:
    """From a stream of job, ts, kind (work, pause, resume, cancel) and item: what was done and dropped, and when, in milliseconds. The
    stream needs a state store with timers: `PROVIDER`."""
    own = rows.select(F.col("job").cast("long").alias("job"), F.col("ts").cast("timestamp").alias("ts"), "kind", F.col("item").cast("long").alias("item"))
    own = own.withWatermark("ts", late).withColumn("at", F.unix_millis("ts"))
    return own.groupBy("job").transformWithStateInPandas(Controlled(limit), OUTPUT, "Append", "EventTime")


def drained(spark: SparkSession, rows: DataFrame, path: str, late: str = "1 day", limit: int = LIMIT) -> DataFrame:
    """The rows that a stream puts out until its source is read, written to `path`."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        stream = controlled(rows, late, limit).writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state")
        stream.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(OUTPUT).parquet(f"{path}/rows")
