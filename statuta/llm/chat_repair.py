"""Conversation structure repair: backward cost-to-go over rows and grammar state, then a greedy walk forward.

A conversation's rows, by turn (nulls first; equal turns by role and then by a hash of the text), are edited until the
initials of their roles read `(s?(ua)+)?`. Keep costs 0, Rerole to user or assistant 1, Delete 2, Insert of an empty user or
assistant row 5; blank rows and repeats of an earlier row of the same role and text can only be deleted, and a truncated row
that is not deleted costs 5 more. The grammar has four states: nothing yet, after s, after u, after a.

1. A conversation's rows are sorted backwards, and one pass computes for each row what the rest costs from each state.
   Only the four differences are kept, in one number; they stay under 32, as whatever one state can do another one can after
   two inserts or a deletion.
2. These narrow rows are sorted forwards among the texts. The walk starts from the first state and takes, among the edits that lie on a cheapest path, the one
   with the least initial (D, I, K, R); as each edit leads to one state, this is the least of all cheapest audits.

Both passes read sorted rows in batches and hold four numbers, so a conversation's length does not bound them; Spark sorts
and spills. A conversation goes through one task, since its hash is one SHA-256 over all its rows, which cannot be parted.
Where rows repeat an earlier row, they are found by aggregates of (conversation, role, hash), which combine before they
shuffle; rows equal in all columns travel as one row with a count. Texts move once.

Defined results: a null conv_id is a conversation of its own; null roles and texts are one space (a blank row); a role counts
by its first character, whatever it is, and an empty role by none, which no grammar accepts; a null turn sorts first and
counts for no gap; rows equal in all columns are adjacent, and all but the first are duplicates; no rows, or none left, give
zeros, an empty audit and the hash of nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import exactly

SPACE_CHARS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States of the grammar: nothing yet, after s, after u, after a. What follows each state by an initial:
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that Rerole and Insert give in each state, and where it leads.
GIVEN = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
ACCEPTED = (0, 3)
#: Pieces that the rows of one (conversation, role, text) are dealt to when they meet their first turn.
SALTS = 16


def or_space(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and `copies` after the stated damage; dropped rows have 0 copies."""
    rows = exactly(conversations, "conv_id", "turn", "role", "text")
    kind = F.pmod(F.crc32(F.concat(or_space(F.col("conv_id")), F.lit(":"), or_space(F.col("turn"))).cast("binary")), F.lit(20))
    rows = rows.select("conv_id", "turn", or_space(F.col("role")).alias("role"), or_space(F.col("text")).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.cast("long").alias("copies"))


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, h (hash of the text), n (rows that are equal in all of these), blank, cut (truncated), seen (the
    role and text occurred at an earlier turn)."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE_CHARS))
    flat = rows.select("conv_id", "turn", "role", hashed().alias("h"), "copies", (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"))
    flat = flat.filter("copies > 0").groupBy("conv_id", "turn", "role", "h").agg(F.sum("copies").alias("n"), F.bool_or("blank").alias("blank"), F.bool_or("cut").alias("cut"))
    place = F.struct(F.col("turn").isNotNull().alias("told"), F.col("turn").alias("turn"))
    first = flat.filter(~F.col("blank")).groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("k")).agg(F.min(place).alias("first"), F.count("*").alias("turns"))
    first = first.filter("turns > 1").select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    salted = flat.withColumn("salt", F.pmod(F.xxhash64("turn"), F.lit(SALTS)).cast("int"))
    met = salted.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("k")) & (F.col("salt") == F.col("s")), "left")
    return met.select("conv_id", "turn", "role", "h", "n", "blank", "cut", F.coalesce(F.col("first") < place, F.lit(False)).alias("seen"))


def hashed() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary")))


def costs(ahead: tuple, initial: str, cut: bool) -> list[int]:
    """Cheapest way from each state over one row that may stay, if the rest costs `ahead`."""
    extra = TRUNCATED if cut else 0
    out = []
    for s in range(4):
        ways = [DELETE + ahead[s], REROLE + extra + ahead[GIVEN[s][1]]]
        if initial in STEPS[s]:
            ways.append(KEEP + extra + ahead[STEPS[s][initial]])
        out.append(min(ways))
    return with_inserts(out)


def with_inserts(cost: list[int]) -> list[int]:
    for _ in range(2):  # two inserts reach every state that inserts can reach
        cost = [min(c, INSERT + cost[GIVEN[s][1]]) for s, c in enumerate(cost)]
    return cost


#: What is left to pay at the end: a conversation may end empty or after an assistant.
AT_END = tuple(with_inserts([0 if s in ACCEPTED else 10**6 for s in range(4)]))


def packed_costs(cost) -> int:
    least = min(cost)
    return sum((c - least) << (8 * s) for s, c in enumerate(cost))


def unpacked_costs(code: int) -> tuple:
    return tuple(code >> (8 * s) & 255 for s in range(4))


def walk(state: int, ahead: tuple, initial: str, cut: bool) -> tuple[str, int, int]:
    """Edits up to and including this row's, the state after them, and their cost: the least initial among those that lie
    on a cheapest path, one after the other."""
    cost, extra, edits, paid = costs(ahead, initial, cut), TRUNCATED if cut else 0, "", 0
    while True:
        left = cost[state]
        if DELETE + ahead[state] == left:
            return edits + "D", state, paid + DELETE
        given = GIVEN[state][1]
        if INSERT + cost[given] == left:
            edits, state, paid = edits + "I", given, paid + INSERT
        elif initial in STEPS[state] and KEEP + extra + ahead[STEPS[state][initial]] == left:
            return edits + "K", STEPS[state][initial], paid + KEEP + extra
        else:
            return edits + "R", given, paid + REROLE + extra


class Remembered(dict):
    """A function of few distinct arguments."""

    def __init__(self, f):
        self.f = f

    def __missing__(self, args):
        self[args] = out = self.f(*args)
        return out


class _Start:
    """Equal to no conversation's id."""


def backward(rows: DataFrame) -> DataFrame:
    """Adds `ahead`: what the rows after this one cost from each state. Copies of a row come after it and are deleted."""
    before = Remembered(lambda code, initial, cut: packed_costs(costs(unpacked_costs(code), initial, cut)))
    ends = packed_costs(AT_END)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, code = _Start, ends
        for b in batches:
            ahead = []
            for c, initial, must, cut in zip(*(b.column(k).to_pylist() for k in ("conv_id", "initial", "must", "cut"))):
                if conv is _Start or c != conv:
                    conv, code = c, ends
                ahead.append(code)
                if not must:
                    code = before[code, initial, cut]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), pa.array(ahead, pa.int64())], names=[*names, "ahead"])

    names = ["conv_id", "turn", "role", "h", "n", "blank", "cut", "seen"]
    must = F.col("blank") | F.col("seen")
    rows = rows.select(*names, F.substring("role", 1, 1).alias("initial"), must.alias("must")).repartition("conv_id")
    rows = rows.sortWithinPartitions("conv_id", F.col("turn").desc_nulls_last(), F.desc("role"), F.desc("h"))
    types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in names)
    return rows.mapInArrow(run, f"{types}, ahead long")


class Told:
    """What is said of one conversation, row by row."""

    def __init__(self, conv):
        self.conv, self.state, self.initial = conv, 0, None
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.turns = 0
        self.low = self.high = None
        self.audit: list[str] = []
        self.hash, self.lines = hashlib.sha256(), 0

    def line(self, role: str, text: str = "") -> None:
        self.hash.update((("\n" if self.lines else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.lines += 1

    def inserted(self) -> None:
        role, self.state = GIVEN[self.state]
        self.line(role)

    def row(self, turn, role: str, n: int, blank: bool, cut: bool, seen: bool, ahead: int, walks: Remembered) -> str:
        """The edit of the first of n equal rows; the others are deleted."""
        initial = role[:1]
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if self.initial is not None:
            self.illegal += self.initial + initial not in ("su", "ua", "au")
        self.illegal, self.initial = self.illegal + n - 1, initial
        if blank or seen:
            self.blank, self.duplicate = self.blank + n * blank, self.duplicate + n * (not blank)
            self.audit.append("D" * n)
            self.cost += DELETE * n
            return "D"
        self.truncated, self.duplicate = self.truncated + cut, self.duplicate + n - 1
        edits, _, paid = walks[self.state, ahead, initial, cut]
        for _ in edits[:-1]:
            self.inserted()
        self.audit.append(edits + "D" * (n - 1))
        self.cost += paid + DELETE * (n - 1)
        return edits[-1]

    def edited(self, edit: str, role: str, text: str) -> None:
        if edit == "R":
            role, self.state = GIVEN[self.state]
        else:
            self.state = STEPS[self.state][role[:1]]
        self.line(role, text)

    def closed(self) -> dict:
        while self.state not in ACCEPTED:
            self.inserted()
            self.audit.append("I")
            self.cost += INSERT
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        numbers = {k: getattr(self, k) for k in ("blank", "duplicate", "truncated", "illegal", "cost")}
        return {"conv_id": self.conv, "gaps": gaps, **numbers, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def forward(rows: DataFrame, id_type: str) -> DataFrame:
    """The walk over sorted rows: `part` 0 opens a conversation, 1 is a row with its faults, 2 a text."""
    walks = Remembered(lambda state, code, initial, cut: walk(state, unpacked_costs(code), initial, cut))
    out = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, open_, pending, schema = None, None, None, None
        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema)
        for b in batches:
            if schema is None:
                names = [part.split()[0] for part in out.split(", ")]
                schema = pa.schema([("conv_id", b.schema.field("conv_id").type)] + [(k, pa.string() if k in ("audit", "repaired_sha256") else pa.int64()) for k in names])
            done = []
            columns = [b.column(k).to_pylist() for k in ("conv_id", "part", "turn", "role", "h", "n", "blank", "cut", "seen", "ahead", "text")]
            for conv, part, turn, role, h, n, blank, cut, seen, ahead, text in zip(*columns):
                if part == 0:
                    if told:
                        done.append(told.closed())
                    told, open_ = Told(conv), None
                elif part == 1:
                    edit = told.row(turn, role, n, blank, cut, seen, ahead, walks)
                    open_, pending = (edit if edit != "D" else None), (turn, role, h)
                elif open_ and pending == (turn, role, h):
                    told.edited(open_, role, text)
                    open_ = None  # equal rows have their text once
            if done:
                yield batch(done)
        if told:
            yield batch([told.closed()])

    return rows.mapInArrow(run, f"conv_id {id_type}, {out}")


def repaired(rows: DataFrame, original: DataFrame) -> DataFrame:
    """One row for each conv_id of `original`, from its rows (conv_id, turn, role, text, copies)."""
    flat = backward(faults(rows))
    none = lambda t: F.lit(None).cast(t)
    names = ["conv_id", "opens", "turn", "role", "h", "part", "n", "blank", "cut", "seen", "ahead", "text"]
    conv = exactly(original, "conv_id").distinct()
    turn_type, id_type = rows.schema["turn"].dataType.simpleString(), rows.schema["conv_id"].dataType.simpleString()
    heads = conv.select("conv_id", F.lit(0).alias("opens"), none(turn_type).alias("turn"), none("string").alias("role"), none("binary").alias("h"), F.lit(0).alias("part"), none("long").alias("n"), *[none("boolean").alias(k) for k in ("blank", "cut", "seen")], none("long").alias("ahead"), none("string").alias("text"))
    told = flat.withColumn("opens", F.lit(1)).withColumn("part", F.lit(1)).withColumn("text", none("string")).select(*names)
    texts = rows.filter("copies > 0").filter(F.rtrim(F.col("text"), F.lit(SPACE_CHARS)) != "")
    texts = texts.select("conv_id", F.lit(1).alias("opens"), "turn", "role", hashed().alias("h"), F.lit(2).alias("part"), none("long").alias("n"), *[none("boolean").alias(k) for k in ("blank", "cut", "seen")], none("long").alias("ahead"), "text")
    every = heads.select(*names).unionByName(told).unionByName(texts).repartition("conv_id")
    return forward(every.sortWithinPartitions("conv_id", "opens", F.col("turn").asc_nulls_first(), "role", "h", "part"), id_type)


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """The stated damage, then the repair."""
    return repaired(damaged(conversations), conversations)
