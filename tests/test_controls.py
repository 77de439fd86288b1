"""Paused, resumed and cancelled jobs: streams against a loop over the whole log."""

import random

import pytest
from pyspark.sql import functions as F

from statuta.streaming import controls as C

LOG = "job long, ts timestamp, kind string, item long"


def loop(rows, limit, upto):
    """Rows of each job in the order of their times, as far as the watermark has passed their tick."""
    out = []
    for job in {r[0] for r in rows}:
        own = C.Job(limit=limit)
        for at, _, kind, item in sorted((at, C.ORDER[kind], kind, item) for j, at, kind, item in rows if j == job and C.tick(at) <= upto):
            own.row(at, kind, item)
        if own.status == "paused" and C.tick(own.since + limit) <= upto:
            own.until(own.since + limit)
        out += [(job, *r) for r in own.out]
    return sorted(out)


@pytest.mark.parametrize("rows, want", [
    ([(0, "work", 1), (5, "pause", 0), (6, "work", 2), (7, "pause", 0), (8, "resume", 0), (9, "work", 3)], [(1, 0, 0, "done"), (2, 6, 8, "done"), (3, 9, 9, "done")]),
    ([(0, "pause", 0), (1, "work", 1), (2, "cancel", 0), (3, "resume", 0), (4, "work", 2)], [(1, 1, 2, "dropped"), (2, 4, 4, "dropped")]),
    ([(0, "pause", 0), (50, "pause", 0), (60, "work", 1), (130, "work", 2)], [(1, 60, 100, "done"), (2, 130, 130, "done")]),
    ([(0, "resume", 0), (0, "work", 1)], [(1, 0, 0, "done")]),
])
def test_rules(rows, want):
    job = C.Job(limit=100)
    for r in rows:
        job.row(*r)
    assert job.out == want


@pytest.fixture()
def drain(spark, tmp_path):
    def run(batches, late, limit):
        for n, batch in enumerate(batches):
            df = spark.createDataFrame([(j, at / 1000, k, i) for j, at, k, i in batch], "job long, at double, kind string, item long")
            df.select("job", F.timestamp_millis((F.col("at") * 1000).cast("long")).alias("ts"), "kind", "item").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/log")
        return sorted(tuple(r) for r in C.drained(spark, stream, f"{tmp_path}/out", late, limit).collect())

    return run


def test_late_and_repeated_controls(drain):
    """Controls come batches after the work that they stop, some of them twice; within the watermark each acts at its own time."""
    minute, rng = 60_000, random.Random(3)
    rows, base = [], 1_700_000_000_000
    for job in range(6):
        for n in range(60):
            rows.append((job, base + n * minute + rng.randrange(minute), "work", n))
        for _ in range(5):
            control = (job, base + rng.randrange(60) * minute, rng.choice(["pause", "pause", "resume", "cancel" if job < 2 else "resume"]), 0)
            rows += [control] * rng.choice([1, 2])
    # arrival is up to 20 minutes late
    arrival = sorted(rows, key=lambda r: r[1] + (rng.randrange(20) * minute if r[2] != "work" else 0))
    batches = [arrival[k : k + 80] for k in range(0, len(arrival), 80)] + [[(99, base + 300 * minute, "work", 0)]]
    got = drain(batches, "30 minutes", 10 * minute)
    assert got == loop([r for b in batches for r in b], 10 * minute, base + 270 * minute)
    assert {r[4] for r in got} == {"done", "dropped"} and any(r[3] - r[2] > minute for r in got)


def test_query_is_the_table_s_loop(spark, sf):
    from statuta import registry

    got = sorted(tuple(r) for r in registry.queries()["job_controls"](spark, sf).collect())
    kind = lambda r: "pause" if r.event_type == "error" else "resume" if r.event_type == "signup" else "cancel" if r.event_type == "purchase" and r.value > 95 else "work"
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("at", F.unix_millis(F.col("ts").cast("timestamp"))).collect()
    rows = [(r.user_id % 100, r.at, kind(r), r.event_id) for r in events]
    assert got and got == loop(rows, C.LIMIT, max(r[1] for r in rows) - 86_400_000)


def test_one_timer_for_all_that_waits():
    """A timer for each tick would read a job's whole state as often as there are ticks."""
    from types import SimpleNamespace

    import pandas as pd

    value = lambda: SimpleNamespace(exists=lambda: False, update=lambda v: None, clear=lambda: None)
    timers, own = [], C.Controlled()
    own.init(SimpleNamespace(getValueState=lambda *a: value(), getListState=lambda *a: SimpleNamespace(appendList=lambda rows: None), registerTimer=timers.append))
    batch = pd.DataFrame({"at": [n * C.TICK for n in range(1, 500)], "kind": "work", "item": range(1, 500)})
    list(own.handleInputRows((1,), iter([batch]), None))
    assert timers == [C.TICK]
