"""Conditions in words as trees (inventory 2.12.12, 2.8.9)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Openings that negate a condition, openings that only announce it, and what joins its parts, the loosest first.
NEGATIONS = (r"unless\s+", r"except\s+(?:where|when|if|that|as)?\s*", r"provided\s+that\s+.+\s+(?:does|do)\s+not\s+", r"excluding\s+", r"other\s+than\s+")
OPENING = r"(?:if|when|where|provided\s+that|in\s+the\s+event\s+that|in\s+cases?\s+where|to\s+the\s+extent\s+that)\s+"
JOINTS = (("OR", r"(?:;\s*|,\s*|\s+)or\s+"), ("AND", r"(?:;\s*|,\s*|\s+)and\s+"), ("AND", r"\s*;\s*"))


def _parts(text: str, joint: str) -> list[str]:
    """`text` cut at a joint, but not inside brackets; empty parts go."""
    depth, at, found = 0, 0, []
    inside = []
    for ch in text:
        depth += ch == "("
        inside.append(depth > 0)
        depth -= ch == ")" and depth > 0
    for m in re.finditer(joint, text, re.I):
        if not inside[m.start()]:
            found.append(text[at : m.start()])
            at = m.end()
    return [p.strip() for p in (*found, text[at:]) if p.strip()]


def tree(text: str | None) -> list[tuple[int, int | None, int, str, str | None]]:
    """Nodes (id, parent, ordinal, type, text) in pre-order. Brackets that are left open hold to the end of the text."""
    nodes, waiting = [], []
    text = (text or "").strip()
    negated = next((m for p in NEGATIONS if (m := re.match(p, text, re.I)) and text[m.end() :].strip()), None)
    if negated:
        nodes.append((0, None, 0, "NOT", None))
        waiting.append((text[negated.end() :].strip(), 0, 0))
    else:
        opening = re.match(OPENING, text, re.I)
        waiting.append((text[opening.end() :].strip() if opening else text, None, 0))
    while waiting:
        text, parent, ordinal = waiting.pop()
        kind, parts = next(((k, p) for k, j in JOINTS if len(p := _parts(text, j)) > 1), ("LEAF", []))
        if not parts and text.startswith("(") and text.endswith(")") and text[1:-1].strip():
            waiting.append((text[1:-1].strip(), parent, ordinal))
            continue
        nodes.append((len(nodes), parent, ordinal, kind, None if parts else text))
        waiting += [(p, nodes[-1][0], i) for i, p in reversed(list(enumerate(parts)))]
    return nodes


def condition_nodes(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, node_id, parent_id, ordinal, type, text: a tree for each row, null and empty conditions being a leaf. No shuffle."""
    key = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trees = [tree(t) for t in b.column(1).to_pylist()]
            owner = b.column(0).take(pa.array([i for i, t in enumerate(trees) for _ in t], pa.int64()))
            nodes = list(zip(*(n for t in trees for n in t))) or [()] * 5
            types = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([owner, *(pa.array(c, t) for c, t in zip(nodes, types))], names=[id_col, "node_id", "parent_id", "ordinal", "type", "text"])

    return rows.select(id_col, F.col(text_col)).mapInArrow(run, f"`{id_col}` {key}, node_id int, parent_id int, ordinal int, type string, text string")
