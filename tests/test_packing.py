"""Packing against a plain loop, with small targets so that each rule is met often."""

import re

import pytest
from pyspark.sql import functions as F

from statuta.operators.packing import passages


def packed(pieces, target, glue):
    out, held = [], []
    for p in pieces:
        if held and sum(map(len, held)) + len(p) > target:
            out.append(glue.join(held))
            held = []
        held.append(p)
    return out + ([glue.join(held)] if held else [])


def plain(text, target, whole_most):
    out, held = [], []
    for p in [q.strip() for q in re.split(r"\n\s*\n", text or "")]:
        if len(p) < 10:
            continue
        if len(p) > whole_most:
            out += packed(held, target, "\n\n")
            held = []
            out += packed([q.strip() for q in p.split("\n") if len(q.strip()) >= 10], target, "\n")
        else:
            held.append(p)
    return out + packed(held, target, "\n\n")


@pytest.mark.parametrize("target, whole_most", [(120, 400), (3000, 15_000)])
def test_passages_agree_with_a_loop(spark, sf, target, whole_most):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.regexp_replace("text", r"\. ", ".\n\n").alias("text"))
    made = [(-1, None), (-2, ""), (-3, "short"), (-4, "a long enough one\n \n\n" * 9), (-5, "one line here\n" * 60 + "\n\nthe next one is alone"), (-6, "x\ny\n" * 400), (-7, "x" * 500 + "\n\n" + "1234567890"), (-8, "first of them\n\n" + "a\n" * 300 + "\n\nlast of them")]
    docs = docs.unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {}
    for r in passages(docs, target, whole_most).orderBy("doc_id", "ordinal").collect():
        got.setdefault(r.doc_id, []).append(r.passage)
        assert r.label == f"Paragraph {len(got[r.doc_id])}" and r.ordinal == len(got[r.doc_id])
    assert got == {k: p for k, t in texts.items() if (p := plain(t, target, whole_most))}
