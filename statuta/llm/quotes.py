"""Chat formatting by quotation linking.

A message's lines have quote levels: the number of `>` signs at their start, white space between them allowed. Lines of
one level that follow each other, up to an empty one, are a passage. Passages are normalised (ASCII white space, line
breaks among it, folded; A-Z lower-cased), so a rewrapped quotation is the same passage, hashed to 128 bits, and joined to
what messages of the same conversation say themselves: to the latest earlier turn that says the passage, or says it as one
of its lines. A quoted passage found nowhere as a whole falls back to its lines, those of `MIN_WORDS` words or more.
Quotations of every level are traced to their own originals (`origins`).

The turn that supplies most of a message's first-level quoted characters (the later one of equals) is its parent; a message
without such a quote is a root of its own. `position` is the place of a message in its conversation when every reply
follows what it replies to, before the next reply to the same message; threads follow each other by their first turn.
`clean_text` has no quoted lines. The result is sorted by conversation and position, so it reads as conversations.

The latest earlier turn is found by time blocks: within a block of turns by a window, across blocks from the last turn
of each block before, so a passage that fills a huge conversation is not ordered in one task; siblings and threads are
ordered by blocks too. Trees are walked by pointer doubling over the steps down and up their branches.

Defined results: a null text has no lines, and its clean_text is null; texts of any length are parsed line by line; a null
conv_id or turn is never linked and has no position; of a (conv_id, turn) that occurs more than once, all rows get the same
links and position; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written

#: Turns of a time block.
BLOCK = 1024
#: Words of a line that may link by itself, as a part of a passage.
MIN_WORDS = 3
_MARKS = r"^(?:[\x20\x09]*>)+"
_marks, _space = re.compile(_MARKS), re.compile(r"[\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def passages(text: str | None) -> list[tuple[int, list[str]]]:
    """(level, normalised lines) of each passage, in order."""
    out, open_ = [], False
    for line in (text or "").split("\n"):
        marks = _marks.match(line)
        level = marks.group().count(">") if marks else 0
        normal = _space.sub(" ", line[marks.end() :] if marks else line).strip(" ").translate(_LOWER)
        if not normal:
            open_ = False
        elif open_ and out[-1][0] == level:
            out[-1][1].append(normal)
        else:
            out.append((level, [normal]))
            open_ = True
    return out


def message_pieces(messages: DataFrame) -> DataFrame:
    """row, conv_id, turn, level, passage, part (-1: the whole passage, else one of its lines), key, size."""
    keyed = messages.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    own = keyed.select(F.monotonically_increasing_id().alias("row"), "conv_id", "turn", "text")
    names = ["row", "conv_id", "turn", "level", "passage", "part", "key", "size"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found = [], []
            for k, t in enumerate(b.column(3)):
                for n, (level, lines) in enumerate(passages(t.as_py())):
                    parts = [(-1, " ".join(lines))]
                    if len(lines) > 1:
                        parts += [(j, x) for j, x in enumerate(lines) if x.count(" ") + 1 >= MIN_WORDS]
                    found += [(level, n, j, hashlib.md5(x.encode("utf-8", "surrogatepass")).hexdigest(), len(x)) for j, x in parts]
                    at += [k] * len(parts)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64())
            columns = [pa.array(c, kind) for c, kind in zip(zip(*found) if found else [()] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(at, pa.int64())) for i in range(3)), *columns], names=names)

    kind = lambda c: messages.schema[c].dataType.simpleString()
    return own.mapInArrow(parse, f"row long, conv_id {kind('conv_id')}, turn {kind('turn')}, level int, passage int, part int, key string, size long")


def _block(turn: str = "turn") -> Column:
    return F.floor(F.col(turn) / BLOCK)


def quote_links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn (null if only deeper quotes are linked), n_linked (quoted passages, or their lines, with
    an original) and origins (`level:turn`, sorted, each once) for each message with a linked quote."""
    pieces = written(message_pieces(messages)).withColumn("block", _block()).withColumn("said", F.when(F.col("level") == 0, F.col("turn")))
    wanted = pieces.filter("level > 0").select("conv_id", "key").distinct()
    pieces = written(pieces.join(wanted, ["conv_id", "key"], "left_semi"))
    in_block = Window.partitionBy("conv_id", "key", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    quoted = pieces.withColumn("near", F.max("said").over(in_block)).filter("level > 0")
    blocks = pieces.groupBy("conv_id", "key", "block").agg(F.max("said").alias("said"))
    before = Window.partitionBy("conv_id", "key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    far = blocks.withColumn("far", F.max("said").over(before)).select("conv_id", "key", "block", "far")
    found = quoted.join(far, ["conv_id", "key", "block"]).withColumn("source", F.coalesce("near", "far")).filter("source IS NOT NULL")
    whole, piece = F.col("part") == -1, F.struct("source", "size")
    each = found.groupBy("row", "conv_id", "turn", "level", "passage").agg(F.max(F.when(whole, piece)).alias("whole"), F.collect_list(F.when(~whole, piece)).alias("parts"))
    each = each.select("conv_id", "turn", "level", F.explode(F.when(F.col("whole").isNotNull(), F.array("whole")).otherwise(F.col("parts"))).alias("p"))
    votes = each.groupBy("conv_id", "turn", F.col("p.source").alias("source")).agg(F.sum(F.when(F.col("level") == 1, F.col("p.size")).otherwise(0)).alias("chars"), F.count(F.lit(1)).alias("n"), F.collect_set("level").alias("levels"))
    best = F.max(F.when(F.col("chars") > 0, F.struct("chars", "source")))["source"]
    traced = F.collect_list(F.transform("levels", lambda x: F.struct(x.alias("level"), F.col("source"))))
    origins = F.array_join(F.transform(F.sort_array(F.flatten(traced)), lambda x: F.concat_ws(":", x["level"].cast("string"), x["source"].cast("string"))), ",")
    return votes.groupBy("conv_id", "turn").agg(best.alias("parent_turn"), F.sum("n").alias("n_linked"), origins.alias("origins"))


def threads(links: DataFrame) -> DataFrame:
    """conv_id, turn, depth, thread_root of each message with a parent, by pointer doubling: rounds grow with the
    logarithm of the longest chain of replies."""
    state = written(links.filter("parent_turn IS NOT NULL").select("conv_id", "turn", F.col("parent_turn").alias("up"), F.lit(1).cast("long").alias("depth")))
    while True:
        above = state.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("up").alias("up2"), F.col("depth").alias("depth2"))
        moved = state.join(above, (F.col("conv_id") == F.col("c")) & (F.col("up") == F.col("t")), "left")
        moved = written(moved.select("conv_id", "turn", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.col("up2").isNotNull().alias("moved")))
        state = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return state.withColumnRenamed("up", "thread_root")


def _next_by_blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `next`: the turn that follows within `keys`, of distinct turns."""
    rows = rows.withColumn("block", _block())
    blocks = rows.groupBy(*keys, "block").agg(F.min("turn").alias("opens"))
    blocks = blocks.withColumn("opens", F.lead("opens").over(Window.partitionBy(*keys).orderBy("block")))
    near = F.lead("turn").over(Window.partitionBy(*keys, "block").orderBy("turn"))
    return rows.withColumn("near", near).join(blocks, [*keys, "block"]).withColumn("next", F.coalesce("near", "opens")).drop("near", "opens", "block")


def positions(messages: DataFrame, links: DataFrame, tree: DataFrame) -> DataFrame:
    """conv_id, turn, position (from 0) of each message, repeated turns counted once."""
    turns = messages.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", "turn").distinct()
    nodes = turns.join(links.filter("parent_turn IS NOT NULL").select("conv_id", "turn", F.col("parent_turn").alias("parent")), ["conv_id", "turn"], "left")
    nodes = written(nodes.join(tree.select("conv_id", "turn", "thread_root"), ["conv_id", "turn"], "left").withColumn("root", F.coalesce("thread_root", "turn")).drop("thread_root"))

    # Where each thread begins: the messages of the threads before it.
    sizes = nodes.groupBy("conv_id", "root").agg(F.count(F.lit(1)).alias("n")).withColumn("block", _block("root"))
    blocks = sizes.groupBy("conv_id", "block").agg(F.sum("n").alias("m"))
    blocks = blocks.withColumn("ahead", F.coalesce(F.sum("m").over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("m")
    inside = F.sum("n").over(Window.partitionBy("conv_id", "block").orderBy("root").rowsBetween(Window.unboundedPreceding, -1))
    sizes = written(sizes.withColumn("inside", F.coalesce(inside, F.lit(0))).join(blocks, ["conv_id", "block"]).select("conv_id", "root", "n", (F.col("ahead") + F.col("inside")).alias("start")))

    # A walk goes down into each message and up again; what is left of it, counted in steps down, tells the place.
    members = nodes.join(sizes.filter("n > 1"), ["conv_id", "root"])
    children = members.filter("parent IS NOT NULL").select("conv_id", "turn", "parent")
    first = children.groupBy("conv_id", "parent").agg(F.min("turn").alias("first")).withColumnRenamed("parent", "turn")
    walk = members.select("conv_id", "turn", "parent").join(first, ["conv_id", "turn"], "left").join(_next_by_blocks(children, ["conv_id", "parent"]).select("conv_id", "turn", "next"), ["conv_id", "turn"], "left")
    step = lambda up, to, to_up, w: F.struct(F.lit(up).alias("up"), to.alias("to"), to_up.alias("to_up"), F.lit(w).cast("long").alias("left"))
    down = step(False, F.coalesce("first", "turn"), F.col("first").isNull(), 1)
    back = step(True, F.coalesce("next", "parent"), F.col("next").isNull(), 0)
    state = written(walk.select("conv_id", "turn", F.explode(F.array(down, back)).alias("s")).select("conv_id", "turn", "s.*"))
    while not state.filter("to IS NOT NULL").isEmpty():
        ahead = state.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("up").alias("u"), F.col("to").alias("to2"), F.col("to_up").alias("to_up2"), F.col("left").alias("left2"))
        met = (F.col("conv_id") == F.col("c")) & (F.col("to") == F.col("t")) & (F.col("to_up") == F.col("u"))
        state = written(state.join(ahead, met, "left").select("conv_id", "turn", "up", F.col("to2").alias("to"), F.col("to_up2").alias("to_up"), (F.col("left") + F.coalesce("left2", F.lit(0))).alias("left")))
    left = state.filter("NOT up").select("conv_id", "turn", "left")
    placed = nodes.join(sizes, ["conv_id", "root"]).join(left, ["conv_id", "turn"], "left")
    return placed.select("conv_id", "turn", (F.col("start") + F.when(F.col("left").isNull(), 0).otherwise(F.col("n") - F.col("left"))).alias("position"))


def linked_conversations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, parent_turn, thread_root, depth, position, n_quoted (quoted lines), n_linked, origins,
    clean_text per message, sorted by conversation and position."""
    own = messages.select("conv_id", "turn", "role", "text")
    links = written(quote_links(own))
    tree = threads(links)
    placed = positions(own, links, tree)
    level = lambda line: F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), r"[^>]", ""))
    lines = F.split("text", "\n", -1)
    out = own.withColumn("n_quoted", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.filter(lines, lambda x: level(x) > 0))).cast("long"))
    out = out.withColumn("clean_text", F.array_join(F.filter(lines, lambda x: level(x) == 0), "\n"))
    found = placed.join(links, ["conv_id", "turn"], "left").join(tree, ["conv_id", "turn"], "left").withColumnRenamed("conv_id", "c").withColumnRenamed("turn", "t")
    out = out.join(found, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
    out = out.select("conv_id", "turn", "role", "parent_turn", F.coalesce("thread_root", "turn").alias("thread_root"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.col("position").cast("long").alias("position"), "n_quoted", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.coalesce("origins", F.lit("")).alias("origins"), "clean_text")
    return out.orderBy("conv_id", "position", "turn")
