"""The fields that payloads really have: path, type and count, found in the rows (inventory 2.8.19).

Each round takes the objects and lists of the round before apart by one level and counts what it finds, before anything is shuffled;
there are as many rounds as payloads are deep. A list's items share one path, so the catalogue has a row for a field, not for an item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.payloads import parsed
from ..sources.tables import dealt
from .steps import Steps

#: Kinds by the first character of a value's JSON; all others are numbers, of any size one type.
KINDS = {"{": "object", "[": "array", '"': "string", "t": "boolean", "f": "boolean", "n": "null"}


def kind_of(value: Column) -> Column:
    """object, array, string, number, boolean or null; of no value, none."""
    first = F.substring(F.to_json(value), 1, 1)
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return F.when(value.isNotNull(), F.coalesce(F.element_at(kinds, first), F.lit("number")))


def field_catalogue(rows: DataFrame, payload: str) -> DataFrame:
    """path, kind, n over a column of JSON texts; the whole payload has the path `$`, an item `[]`. Texts that are no JSON, and nulls,
    have no fields."""
    steps, inner = Steps(rows.sparkSession), F.col("kind").isin("object", "array")
    # payloads of one small file would be one task, here and in every round
    found = dealt(rows.select(payload)).select(F.lit("$").alias("path"), parsed(F.col(payload)).alias("v"))
    out, depth = None, 0
    while True:
        # each value is parsed and told its kind once; only objects and lists are kept for the next round, and counts read none
        typed = found.select("path", "v", kind_of(F.col("v")).alias("kind")).select("path", "kind", F.when(inner, F.col("v")).alias("v"))
        level = steps.written(f"level{depth % 2}", typed).filter("kind IS NOT NULL")
        counts = steps.written(f"counts{depth}", level.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n")))
        out = counts if out is None else out.unionByName(counts)
        if counts.filter(inner).isEmpty():
            return out.groupBy("path", "kind").agg(F.sum("n").alias("n"))
        level.filter(inner).createOrReplaceTempView("_payload_level")
        found = rows.sparkSession.sql("SELECT CASE WHEN key IS NULL THEN concat(path, '[]') ELSE concat(path, '.', key) END AS path, value AS v FROM _payload_level, LATERAL variant_explode(v)")
        depth += 1
