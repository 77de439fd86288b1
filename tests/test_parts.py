"""Work that grew faster than its input: batches, payloads, groups, quotes."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from statuta.functions.checks import quoted_in
from statuta.operators import steps
from statuta.operators.catalogue import field_catalogue
from statuta.registry import queries


def test_batches_are_cut_into_parts_and_lose_no_row():
    batches = [pa.RecordBatch.from_pydict({"n": list(range(at, at + n))}) for at, n in ((0, 1000), (1000, 0), (1000, 64), (1064, 65))]
    parts = list(steps.in_parts(iter(batches)))
    assert [n for b in parts for n in b.column(0).to_pylist()] == list(range(1129))
    assert all(0 < b.num_rows <= steps.PART for b in parts)


def test_payloads_of_one_partition_are_dealt_and_kept_only_where_they_hold_more(spark, monkeypatch):
    payloads = ['{"a": [1, 2.5, null, "x"], "b": {"c": true, "d": false}}', '[]', 'no', None, '"t"', '{"a": {}} x', '-7e3'] * 30
    wide, stored, written = [], [], steps.Steps.written

    def spied(self, name, df):
        found = written(self, name, df)
        if name.startswith("level"):
            wide.append(df.rdd.getNumPartitions())
            stored.append(found.filter("kind NOT IN ('object', 'array') AND v IS NOT NULL").count())
        return found

    monkeypatch.setattr(steps.Steps, "written", spied)
    rows = spark.createDataFrame([(p,) for p in payloads], "p string").coalesce(1)
    told = {(r.path, r.kind): r.n for r in field_catalogue(rows, "p").collect()}
    assert told == {
        ("$", "object"): 30, ("$", "array"): 30, ("$", "string"): 30, ("$", "number"): 30, ("$.a", "array"): 30, ("$.b", "object"): 30,
        ("$.a[]", "number"): 60, ("$.a[]", "null"): 30, ("$.a[]", "string"): 30, ("$.b.c", "boolean"): 30, ("$.b.d", "boolean"): 30,
    }
    assert wide[0] > 1 and stored == [0] * len(stored) and len(stored) == 3


def test_exports_are_grouped_without_sorting_their_facts(spark, sf):
    plan = queries()["export_groups"](spark, sf)._jdf.queryExecution().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_quotes_are_found_as_a_loop_finds_them_and_words_are_asked_first(spark):
    rng, signs = random.Random(3), ["A", "b", "é", "9", " ", "  ", ".", ";\n"]
    pairs = [("".join(rng.choices(signs, k=12)), "".join(rng.choices(signs, k=rng.randrange(4)))) for _ in range(400)] + [(None, "a"), ("a", None), ("", "")]
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    rows = spark.createDataFrame([(i, p, q) for i, (p, q) in enumerate(pairs)], "i int, p string, q string").select("i", quoted_in(F.col("p"), F.col("q")).alias("found"))
    assert {r.i: r.found for r in rows.collect()} == {i: plain(q) != "" and plain(q) in plain(p) for i, (p, q) in enumerate(pairs)}
    assert "forall" in rows._jdf.queryExecution().toString()
