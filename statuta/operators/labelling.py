"""Passages given out in batches to be labelled by hand, and labels taken in again (inventory 2.1.30)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.payloads import parsed
from ..functions.text import strip

#: Passages of a batch, and the least length of a passage, without white space at its ends.
BATCH, LEAST = 15, 150
#: Spans of versions that are numbered apart, and how many places of a version are counted together.
SPANS, BLOCK = 256, 10_000


def in_order(rows: DataFrame) -> DataFrame:
    """`rows` (id, version, ordinal, ...) with n: 1, 2, 3, ... by version, ordinal and id. Places are counted by blocks of a version
    before they meet: a block's rows are numbered by themselves and moved up by the blocks ahead in their span of versions and
    by the spans ahead, of which there are SPANS at most. So neither one version nor all rows pass one task. A null version comes
    first; a null ordinal counts as -1."""
    ends = F.broadcast(rows.agg(F.coalesce(F.min("version"), F.lit(0)).alias("_lo"), F.coalesce(F.max("version"), F.lit(0)).alias("_hi")))  # one row
    spans = F.greatest(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1) * SPANS), F.lit(-1))
    placed = rows.crossJoin(ends).withColumn("_v", F.coalesce("version", F.col("_lo") - 1)).withColumn("_span", spans.cast("int")).withColumn("_block", F.floor(F.coalesce("ordinal", F.lit(-1)) / BLOCK))
    blocks = placed.groupBy("_span", "_v", "_block").agg(F.count(F.lit(1)).alias("_rows"))
    ahead = lambda *order: F.coalesce(F.sum("_rows").over(Window.partitionBy(*order[:-1]).orderBy(*order[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = blocks.select("_v", "_block", "_span", ahead("_span", ["_v", "_block"]).alias("_in_span"))
    one = F.lit(0)
    of_spans = blocks.groupBy("_span").agg(F.sum("_rows").alias("_rows")).select("_span", ahead(one, ["_span"]).alias("_of_span"))
    offsets = before.join(F.broadcast(of_spans), "_span").select("_v", "_block", (F.col("_in_span") + F.col("_of_span")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_v", "_block").orderBy(F.coalesce("ordinal", F.lit(-1)), "id"))
    return placed.join(offsets, ["_v", "_block"]).select(*rows.columns, (F.col("_before") + own).alias("n"))


def batched(passages: DataFrame, done: DataFrame, size: int = BATCH, least: int = LEAST, first: int = 1) -> DataFrame:
    """The passages (id, version, ordinal, text) that nobody has labelled (`done`: id), long enough, in order: id, version, ordinal,
    batch (from `first` on) and place in it. Texts stay behind; `batch_texts` joins what a batch needs."""
    lengthy = passages.filter(F.length(strip(F.col("text"))) >= least).select("id", "version", "ordinal")
    rows = in_order(lengthy.join(done.select("id"), "id", "left_anti"))
    at = F.col("n") - 1
    return rows.select("id", "version", "ordinal", (F.floor(at / size) + first).alias("batch"), (at % size + 1).alias("place"))


def batch_texts(batches: DataFrame, passages: DataFrame, instructions: str) -> DataFrame:
    """batch, ids, value: a batch as one text to be read by who labels it, each passage under its id and label. A batch holds as
    many passages as it was dealt, so the lists are bounded. passages: id, label, text."""
    head = lambda r: F.concat(F.lit("--- PASSAGE ID: "), r["id"].cast("string"), F.lit(" ---\nDocument: "), F.coalesce(r["label"], F.lit("Unknown")), F.lit("\n\n"), r["text"], F.lit("\n"))
    rows = batches.join(passages.select("id", "label", "text"), "id").groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("place", "id", "label", "text"))).alias("r"))
    return rows.select("batch", F.col("r.id").alias("ids"), F.concat_ws("\n", F.lit(instructions), F.array_join(F.transform("r", head), "\n"), F.lit("END OF BATCH")).alias("value"))


def labels_read(answers: DataFrame, passages: DataFrame, kinds: DataFrame, known: DataFrame) -> DataFrame:
    """Labels out of answers (file, text): JSON, a list of entries or an object with them under `results` or `passages`, or one entry.
    file, passage_id, agent, kind, payload, status: `label` for what is new; `repeated` for what is known (`known`: passage_id,
    kind, payload) or comes again; `abstained` for entries without labels; else what is wrong: no json, no entries, no
    passage id (0 is none), unknown passage, unknown agent. kinds: agent, kind. Payloads are compared and given with their names in
    order. An entry or block that is wrong is one row and spoils no other; a label that comes again is one more row."""
    read = answers.select("file", parsed(F.col("text")).alias("v"))
    get = lambda c, path, kind: F.try_variant_get(c, path, kind)
    many = "array<variant>"
    v = F.col("v")
    is_object = F.schema_of_variant(v).startswith("OBJECT")
    entries = F.when(v.isNull(), None).when(is_object, F.coalesce(get(v, "$.results", many), get(v, "$.passages", many), F.array(v))).otherwise(get(v, "$", many))
    whole = read.select("file", v.isNull().alias("broken"), entries.alias("entries"))
    nothing = F.lit(None).cast("string")
    spoilt = whole.filter("entries IS NULL").select("file", F.lit(None).cast("long").alias("passage_id"), nothing.alias("agent"), nothing.alias("kind"), nothing.alias("payload"), F.when(F.col("broken"), "no json").otherwise("no entries").alias("status"))

    e = F.col("e")
    one = whole.select("file", F.explode("entries").alias("e")).select("file", F.nullif(get(e, "$.passage_id", "long"), F.lit(0)).alias("passage_id"), get(e, "$.extractions", many).alias("blocks"))
    there = passages.select(F.col("id").alias("passage_id"), F.lit(True).alias("_there")).distinct()
    wrong = F.when(F.col("passage_id").isNull(), "no passage id").when(F.col("_there").isNull(), "unknown passage").when(F.coalesce(F.size("blocks") == 0, F.lit(True)), "abstained")
    judged = one.join(there, "passage_id", "left").withColumn("status", wrong)
    refused = judged.filter("status IS NOT NULL").select("file", "passage_id", nothing.alias("agent"), nothing.alias("kind"), nothing.alias("payload"), "status")
    b = F.col("b")
    blocks = judged.filter("status IS NULL").select("file", "passage_id", F.explode("blocks").alias("b")).select("file", "passage_id", get(b, "$.agent", "string").alias("agent"), get(b, "$.items", many).alias("items"))
    named = blocks.join(kinds.select("agent", "kind"), "agent", "left")
    foreign = named.filter("kind IS NULL").select("file", "passage_id", "agent", "kind", nothing.alias("payload"), F.lit("unknown agent").alias("status"))
    taken = named.filter("kind IS NOT NULL").select("file", "passage_id", "agent", "kind", F.explode("items").alias("i")).select("file", "passage_id", "agent", "kind", F.to_json("i").alias("payload"))
    key = ["passage_id", "kind", "payload"]
    first = taken.groupBy(*key).agg(F.min(F.struct("file", "agent")).alias("f"), F.count(F.lit(1)).alias("n"))
    new = first.join(known.select(*key, F.lit(True).alias("_known")).distinct(), key, "left")
    counted = new.select(F.col("f.file").alias("file"), "passage_id", F.col("f.agent").alias("agent"), "kind", "payload", F.when(F.col("_known"), "repeated").otherwise("label").alias("status"))
    again = new.filter("_known IS NULL AND n > 1").select(F.col("f.file").alias("file"), "passage_id", F.col("f.agent").alias("agent"), "kind", "payload", F.lit("repeated").alias("status"))
    return spoilt.unionByName(refused).unionByName(foreign).unionByName(counted).unionByName(again)
