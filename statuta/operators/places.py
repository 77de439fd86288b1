"""Rows numbered within a block, and each between its neighbours, without ordering a block's rows in one task (inventory 2.3.18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Turns of one cell: cells are ordered by themselves, and then only counted.
CELL = 1024


def placed(rows: DataFrame, block: str, turn: str, then: str, name: str = "place") -> DataFrame:
    """Adds `name`: 0, 1, 2, ... within a block by `turn` (nulls first) and `then`. Rows are ordered within cells of CELL turns and
    moved up by the rows of the cells before, of which a block has one row each."""
    cell = F.coalesce(F.floor(F.col(turn) / CELL), F.lit(-(1 << 62)))
    rows = rows.withColumn("__cell", cell)
    inside = Window.partitionBy(block, "__cell").orderBy(F.col(turn).asc_nulls_first(), F.col(then).asc_nulls_first())
    counts = rows.groupBy(F.col(block).alias("__b"), F.col("__cell").alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__b").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("__b", "__c", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__ahead"))
    numbered = rows.withColumn("__in", F.row_number().over(inside)).join(ahead, F.col(block).eqNullSafe(F.col("__b")) & (F.col("__cell") == F.col("__c")))
    return numbered.withColumn(name, F.col("__ahead") + F.col("__in") - 1).drop("__cell", "__b", "__c", "__in", "__ahead")


def neighbours(rows: DataFrame, block: str, turn: str, text: str) -> DataFrame:
    """One row for each row: block, turn, text, before, after. Each text is sent to its own place and to those beside it, so
    equal blocks and turns multiply nothing."""
    at = placed(rows.select(block, turn, text), block, turn, text)
    sent = F.explode(F.array(*[F.struct((F.col("place") + k).alias("to"), F.lit(k).alias("from")) for k in (0, 1, -1)])).alias("s")
    each = at.select(block, turn, text, sent)
    of = lambda k, *c: F.max(F.when(F.col("s.from") == k, F.struct(*c)))
    met = each.groupBy(block, "s.to").agg(of(0, turn, text).alias("own"), of(1, text)[text].alias("before"), of(-1, text)[text].alias("after"))
    return met.filter("own IS NOT NULL").select(block, f"own.{turn}", f"own.{text}", "before", "after")
