"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled but fixed order, served `repeats` times at most. A document's
turn has a virtual finish time: the source's words served up to its end, divided by the source's target. All turns of all
sources are sorted by finish time over ranges of the cluster and served whole until the total budget is spent; what has
been served by then is the mix. A source therefore ends within one document of its target, and the little that its last
document leaves goes to the others in proportion.

Defined results: a null text has no words; a document without words has one turn; a null source is a source of its own,
last in order; repeated rows are documents of their own, one after the other in their queue; ties in finish time go by
shuffled order; texts of any length are only counted and are served whole or not at all; an empty table gives no rows;
other columns are ignored, or carried along by `mixed_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, packed, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
SEED = "mix-1"
#: Ranges of finish time, at least; the one in which the budget runs out is summed up row by row.
RANGES = 64


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target. Sources by code point, null last, weigh `weights` in turn and share `share` of all
    sizes; a target stops at `repeats` times its source's size and the excess goes to the others by weight.

    One row per source: the level at which the last open source stops is found by sorting sources by the level at
    which they fill up, so no loop is needed. The windows run over one row per source, not over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name, everything = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()), Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.lit(repeats) * F.col("source_size")).withColumn("budget", F.lit(share) * F.sum("source_size").over(everything))
    by_level = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward)
    per = per.withColumn("level", level)
    # The first source, in that order, that is not full at its own level sets the level of all that follow.
    final = F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level"))))
    per = per.withColumn("final", final.over(everything)["level"])
    target = F.when(F.col("final").isNull() | (F.col("final") * F.col("weight") >= F.col("cap")), F.col("cap").cast("double")).otherwise(F.col("final") * F.col("weight"))
    return per.select("source", "source_size", target.alias("target"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, *carried: Column) -> DataFrame:
    """row, doc_id, source, size, shuffle and `carried`, written: words are counted once, and a row keeps its number."""
    name = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(text_col, F.lit(""))))
    shuffle = F.md5(F.concat_ws(":", F.lit(seed), name)).alias("shuffle")
    return written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(text_col).alias("size"), shuffle, *carried))


def finish_times(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """One row for each turn of each document: row, doc_id, source, size, shuffle, source_size, target, turn, finish.

    Running totals go by (source, cell) and then over the cells of a source, so that no source, however large, is
    summed up in one task."""
    base = sized.select("row", "doc_id", "source", "size", "shuffle", F.substring("shuffle", 1, 3).alias("cell"))
    targets = source_targets(base, weights, share, repeats)
    cells = base.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    ahead = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("cell_start", F.coalesce(F.sum("cell_size").over(ahead), F.lit(0)))
    same_source = lambda a, b: a["source"].eqNullSafe(b["source"])
    cells = cells.join(targets, same_source(cells, targets)).select(cells["source"].alias("s"), F.col("cell").alias("c"), "cell_start", "source_size", "target")
    within = Window.partitionBy("source", "cell").orderBy("shuffle", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queue = base.withColumn("upto", F.sum("size").over(within))
    queue = queue.join(cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c"))).withColumn("end", F.col("cell_start") + F.col("upto"))
    last = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.lit(repeats - 1))
    each = queue.select("row", "doc_id", "source", "size", "shuffle", "source_size", "target", "end", F.explode(F.sequence(F.lit(0), last)).alias("turn"))
    served = (F.col("turn") * F.col("source_size") + F.col("end")).cast("double")
    return each.withColumn("finish", F.when(F.col("target") > 0, served / F.col("target")).otherwise(F.lit(0.0))).drop("end")


def served_turns(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """`finish_times`, range-sorted, with `served`: whether the budget lasts to the end of the turn. Written.

    Ranges of finish time are summed up, which tells those before the end of the budget from those behind it; only the
    range in which it runs out is summed up turn by turn."""
    order = ["finish", "shuffle", "doc_id", "size", "row", "turn"]
    ranges = max(RANGES, int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    turns = written(finish_times(sized, weights, share, repeats).repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()))
    totals = turns.groupBy("range").agg(F.sum("size").alias("range_size"))
    behind = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("before", F.coalesce(F.sum("range_size").over(behind), F.lit(0)))
    budget = F.lit(share * (sized.agg(F.sum("size")).first()[0] or 0))
    turns = turns.join(F.broadcast(totals), "range")  # one row for each range
    crossed = (F.col("before") <= budget) & (F.col("before") + F.col("range_size") > budget)
    upto = F.sum("size").over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = turns.filter(crossed).withColumn("served", F.col("before") + upto <= budget)
    rest = turns.filter(~crossed).withColumn("served", F.col("before") + F.col("range_size") <= budget)
    return written(rest.unionByName(edge).drop("range", "range_size", "before"))


def fair_queue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, virtual_finish of its first turn, turns served, taken (their words)."""
    turns = served_turns(_sized(docs, id_col, text_col, source_col, seed), weights, share, repeats)
    served = F.count(F.when(F.col("served"), 1))
    found = turns.groupBy("row", "doc_id", "source", "size", "source_size", "target").agg(F.min("finish").alias("virtual_finish"), served.alias("turns"))
    return found.select("doc_id", "source", "size", "source_size", "target", "virtual_finish", "turns", (F.col("turns") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """The mix itself: the documents once for each turn served, range-sorted over the cluster by finish time."""
    sized = _sized(docs, id_col, text_col, source_col, seed, packed(docs))
    turns = served_turns(sized.drop("doc"), weights, share, repeats).filter("served").select("row", "finish", "shuffle", "turn")
    return sized.select("row", "doc").join(turns, "row").orderBy("finish", "shuffle", "row", "turn").select("doc.*")
