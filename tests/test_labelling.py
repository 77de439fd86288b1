"""Batches against one sorted list, labels against entries worked out by hand."""

import json
import random

from statuta.operators import labelling as L

SCHEMA = "id long, version long, ordinal long, text string"


def test_batches_are_one_sorted_list(spark):
    r = random.Random(4)
    rows = [(i, r.choice([None, 5, 5, 5, r.randrange(10**9)]), r.choice([None, 3, r.randrange(10**6)]), r.choice([None, "", " " * 200, "x" * 149 + " ", " " + "y" * 150])) for i in range(3000)]
    done = set(range(0, 3000, 7))
    found = L.batched(spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame([(i,) for i in done], "id long"), first=9).collect()
    order = sorted((x for x in rows if x[0] not in done and len((x[3] or "").strip()) >= 150), key=lambda x: (x[1] is not None, x[1] or 0, -1 if x[2] is None else x[2], x[0]))
    assert sorted((f.batch, f.place, f.id) for f in found) == [(9 + i // 15, 1 + i % 15, x[0]) for i, x in enumerate(order)]
    assert L.batched(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "id long")).count() == 0


def test_batch_texts(spark):
    batches = spark.createDataFrame([(7, 1, 2), (8, 1, 1)], "id long, batch long, place long")
    passages = spark.createDataFrame([(7, "CO, SB 1", "one"), (8, None, "two")], "id long, label string, text string")
    row = L.batch_texts(batches, passages, "Label these.").first()
    assert row.ids == [8, 7] and row.value == "Label these.\n--- PASSAGE ID: 8 ---\nDocument: Unknown\n\ntwo\n\n--- PASSAGE ID: 7 ---\nDocument: CO, SB 1\n\none\n\nEND OF BATCH"


def test_labels_read(spark):
    block = lambda *items, agent="scope": {"agent": agent, "items": list(items)}
    entry = lambda i, *blocks: {"passage_id": i, "extractions": list(blocks)}
    answers = [
        ("a", json.dumps([entry(1, block({"b": 1, "a": 2}), block({"x": 1}, agent="nobody")), entry(2), entry(9, block({"a": 1})), {"extractions": [block({"a": 1})]}, {"passage_id": 0}])),
        ("b", json.dumps({"results": [entry(1, block({"a": 2, "b": 1}, {"a": 3}))]})),
        ("c", json.dumps(entry(2, block({"old": True}, {"q": "é"})))),
        ("d", "{broken"), ("e", "4"), ("f", None), ("g", "[]"), ("h", json.dumps({"passages": [{"passage_id": 2}]})),
    ]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    known = df([(2, "SCOPE", '{"old":true}')], "passage_id long, kind string, payload string")
    found = L.labels_read(df(answers, "file string, text string"), df([(1,), (2,), (2,)], "id long"), df([("scope", "SCOPE")], "agent string, kind string"), known)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([
        ("a", 1, "scope", "SCOPE", '{"a":2,"b":1}', "label"), ("a", 1, "scope", "SCOPE", '{"a":2,"b":1}', "repeated"), ("b", 1, "scope", "SCOPE", '{"a":3}', "label"),
        ("a", 1, "nobody", None, None, "unknown agent"), ("a", 2, None, None, None, "abstained"), ("h", 2, None, None, None, "abstained"), ("a", 9, None, None, None, "unknown passage"),
        ("a", None, None, None, None, "no passage id"), ("a", None, None, None, None, "no passage id"), ("c", 2, "scope", "SCOPE", '{"old":true}', "repeated"), ("c", 2, "scope", "SCOPE", '{"q":"é"}', "label"),
        ("d", None, None, None, None, "no json"), ("e", None, None, None, None, "no entries"), ("f", None, None, None, None, "no json"),
    ], key=str)


def test_a_text_that_only_begins_as_json_is_none(spark):
    """What stands behind a value is not dropped."""
    texts = ['{"passage_id": 1} and more', "4763047 Of thnd", "[1] x", '"x" y', "5 6", "1, 2", "[1] , [2", '1}, {"v": 2', '1, "a": 2', '{"passage_id": 1}{}', "", " ", None, ' {"passage_id": 1}\n', "4", "[]", "null"]
    df = spark.createDataFrame([(f"{i:02}", t) for i, t in enumerate(texts)], "file string, text string")
    found = L.labels_read(df, spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([("scope", "SCOPE")], "agent string, kind string"), spark.createDataFrame([], "passage_id long, kind string, payload string"))
    assert sorted((r.file, r.status) for r in found.collect()) == [(f"{i:02}", "no json") for i in range(13)] + [("13", "abstained"), ("14", "no entries"), ("16", "no entries")]
