"""Trees of conditions, worked out by hand."""

import pytest

from statuta.operators.conditions import condition_nodes, tree


@pytest.mark.parametrize(
    "text, nodes",
    [
        (None, [(0, None, 0, "LEAF", "")]),
        ("  ", [(0, None, 0, "LEAF", "")]),
        ("a thing", [(0, None, 0, "LEAF", "a thing")]),
        ("if a and b or c", [(0, None, 0, "OR", None), (1, 0, 0, "AND", None), (2, 1, 0, "LEAF", "a"), (3, 1, 1, "LEAF", "b"), (4, 0, 1, "LEAF", "c")]),
        ("unless a; b", [(0, None, 0, "NOT", None), (1, 0, 0, "AND", None), (2, 1, 0, "LEAF", "a"), (3, 1, 1, "LEAF", "b")]),
        ("a and (b or c)", [(0, None, 0, "AND", None), (1, 0, 0, "LEAF", "a"), (2, 0, 1, "OR", None), (3, 2, 0, "LEAF", "b"), (4, 2, 1, "LEAF", "c")]),
        ("EXCEPT WHEN (a)", [(0, None, 0, "NOT", None), (1, 0, 0, "LEAF", "a")]),
        ("(a and b", [(0, None, 0, "LEAF", "(a and b")]),
        ("()", [(0, None, 0, "LEAF", "()")]),
    ],
)
def test_tree(text, nodes):
    assert tree(text) == nodes


def test_nodes(spark):
    rows = spark.createDataFrame([(1, "a or b"), (2, None)], "k long, c string")
    found = condition_nodes(rows, "k", "c")
    assert sorted((r.k, r.node_id, r.type) for r in found.collect()) == [(1, 0, "OR"), (1, 1, "LEAF"), (1, 2, "LEAF"), (2, 0, "LEAF")]
    assert condition_nodes(rows.limit(0), "k", "c").count() == 0
