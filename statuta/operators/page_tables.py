"""Tables of stored pages as rows of cells, and the columns of trackers by what their heads say (inventory 2.1.13, 2.1.14, 2.9.39).

A page is read in pieces by one pass that keeps the open tables alone: their current row and the cells that reach down into later
rows. Rows leave as they close. What a table's columns mean is decided in the JVM by ordered rules over its heads.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from html.parser import HTMLParser
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.citations import state_code

#: Characters of a page that are read at once, and rows that leave at once.
PIECE, ROWS = 1 << 16, 1000
# How far a cell may reach by the standard of such pages.
WIDE_MOST, DEEP_MOST = 1000, 65534
UNSEEN = ("script", "style")
CELL = "struct<text:string,href:string,head:boolean>"


@dataclass
class _Cell:
    head: bool
    wide: int = 1
    deep: int = 1
    href: str | None = None

    def __post_init__(self):
        self.said: list[str] = []

    def told(self) -> dict:
        return {"text": " ".join("".join(self.said).split()), "href": self.href, "head": self.head}


def _reach(value: str | None, most: int, zero: int) -> int:
    try:
        n = int((value or "1").strip())
    except ValueError:
        return 1
    return zero if n == 0 else min(n, most) if n > 0 else 1


class _Table:
    """One open table: where it is in its page, its heads, the current row, and cells from above by column."""

    def __init__(self, number: int):
        self.number, self.row, self.cells, self.cell = number, -1, None, None
        self.above: dict[int, tuple[int, dict]] = {}  # column -> rows still to reach, cell
        self.begun: dict[int, tuple[int, dict]] = {}  # likewise, of cells that begin in this row
        self.heads: list[str] | None = None
        self.has_head = False
        self.again: set[int] = set()  # columns of this row into which a cell reaches from the left


class Reader(HTMLParser):
    """Rows (table, row, heads, cells) of a page's tables, in `out`, as they close. A table inside a cell is a table of its own, and its words
    are no part of the cell. A row has as many cells as it fills or as reach into it from above; gaps between are blank. Tags that are not closed end where HTML ends them: a cell before the next cell, a row before the next row."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[int, int, list[str], list[dict]]] = []
        self.open: list[_Table] = []
        self.tables, self.unseen = 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in UNSEEN:
            self.unseen += 1
        elif tag == "table":
            self.open.append(_Table(self.tables))
            self.tables += 1
        elif self.open:
            top = self.open[-1]
            if tag == "tr":
                self._end_row(top)
                top.row, top.cells = top.row + 1, []
            elif tag in ("td", "th"):
                self._end_cell(top)
                if top.cells is None:
                    top.row, top.cells = top.row + 1, []
                own = dict(attrs)
                top.cell = _Cell(tag == "th", _reach(own.get("colspan"), WIDE_MOST, 1), _reach(own.get("rowspan"), DEEP_MOST, DEEP_MOST))
            elif tag == "a" and top.cell and top.cell.href is None:
                top.cell.href = (dict(attrs).get("href") or "").strip() or None
            elif tag in ("br", "p", "div", "li") and top.cell:
                top.cell.said.append(" ")

    def handle_endtag(self, tag):
        if tag in UNSEEN:
            self.unseen = max(0, self.unseen - 1)
        elif self.open and tag in ("td", "th"):
            self._end_cell(self.open[-1])
        elif self.open and tag == "tr":
            self._end_row(self.open[-1])
        elif self.open and tag == "table":
            self._end_row(self.open[-1])
            self.open.pop()

    def handle_data(self, data):
        if self.open and self.open[-1].cell and not self.unseen:
            self.open[-1].cell.said.append(data)

    def close(self):
        super().close()
        while self.open:
            self._end_row(self.open.pop())

    def _end_cell(self, table: _Table) -> None:
        cell, table.cell = table.cell, None
        if cell is None:
            return
        told = cell.told()
        self._reached(table)
        for n in range(cell.wide):
            at = len(table.cells)
            table.cells.append(told)
            if n:
                table.again.add(at)
            if cell.deep > 1:
                table.begun[at] = (cell.deep - 1, told)

    def _reached(self, table: _Table) -> None:
        """Cells from above fill the columns that they reach into."""
        while held := table.above.get(len(table.cells)):
            table.cells.append(held[1])

    def _end_row(self, table: _Table) -> None:
        self._end_cell(table)
        if table.cells is None:
            return
        for at in range(len(table.cells), max(table.above, default=-1) + 1):
            table.cells.append(table.above[at][1] if at in table.above else {"text": "", "href": None, "head": False})
        cells, table.cells = table.cells, None
        table.above, table.begun = {at: (n - 1, told) for at, (n, told) in table.above.items() if n > 1} | table.begun, {}
        if cells and (table.heads is None or (any(c["head"] for c in cells) and not table.has_head)):
            table.heads, table.has_head = ["" if at in table.again else c["text"] for at, c in enumerate(cells)], any(c["head"] for c in cells)
        table.again = set()
        if cells:
            self.out.append((table.number, table.row, table.heads, cells))


def table_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, table, row, heads (of the table as far as read: its first row with head cells, else its first row; a head that reaches over
    several columns names the first of them), cells."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.struct([("text", pa.string()), ("href", pa.string()), ("head", pa.bool_())])

        def batch(keys: pa.Array, of: list[int], rows: list[tuple]) -> pa.RecordBatch:
            table, row, heads, cells = zip(*rows) if rows else ((), (), (), ())
            return pa.RecordBatch.from_arrays([keys.take(pa.array(of, pa.int64())), pa.array(table, pa.int32()), pa.array(row, pa.int32()), pa.array(heads, pa.list_(pa.string())), pa.array(cells, pa.list_(cell))], names=[key, "table", "row", "heads", "cells"])

        for b in batches:
            of, rows = [], []
            for n, said in enumerate(b.column(1)):
                text, reader = said.as_py() or "", Reader()
                for at in range(0, len(text), PIECE):
                    reader.feed(text[at : at + PIECE])
                    if at + PIECE >= len(text):
                        reader.close()
                    rows, of, reader.out = rows + reader.out, of + [n] * len(reader.out), []
                    if len(rows) >= ROWS:
                        yield batch(b.column(0), of, rows)
                        of, rows = [], []
            yield batch(b.column(0), of, rows)

    return pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, table int, row int, heads array<string>, cells array<{CELL}>")


@dataclass(frozen=True)
class Rule:
    """A head belongs to `role` if it holds all of `every` and, where given, one of `some`; `starts` and `whole` ask for its beginning or
    for all of it. With `once` it does so only while no head has the role; otherwise the last one has it."""

    role: str
    every: Sequence[str] = ()
    some: Sequence[str] = ()
    starts: str | None = None
    whole: str | None = None
    once: bool = False

    def fits(self, head: Column, roles: Column) -> Column:
        asks = [F.contains(head, F.lit(w)) for w in self.every]
        if self.some:
            asks.append(reduce(or_, [F.contains(head, F.lit(w)) for w in self.some]))
        if self.starts:
            asks.append(F.startswith(head, F.lit(self.starts)))
        if self.whole:
            asks.append(head == self.whole)
        if self.once:
            asks.append(roles[self.role].isNull())
        return reduce(and_, asks)


# The heads of two trackers, in the order in which they are tried; and what must be among a table's heads.
BILL_TRACKER = (
    Rule("state", ("state",), once=True), Rule("bill_number", ("bill", "number")), Rule("bill_title", ("bill", "title")), Rule("bill_number", whole="bill"),
    Rule("bill_number", starts="bill", once=True), Rule("status", ("status",), once=True), Rule("topic", some=("topic", "subject", "scope")),
    Rule("last_action", some=("action", "last")), Rule("effective_date", some=("effective", "date")), Rule("bill_title", ("title",), once=True),
)
LAW_TRACKER = (
    Rule("state", ("state",)), Rule("scope", ("scope",)), Rule("law_name", ("relevant", "law")), Rule("law_url", ("link",)), Rule("effective_date", ("effective",)),
    Rule("key_requirements", ("requirement",)), Rule("enforcement", some=("enforce", "penal")),
)
BILL_HEADS, BILL_HEADS_LEAST, CELLS_LEAST = ("state", "bill", "status"), 2, 3
LAW_HEADS = ("state", "effective")


def column_roles(heads: Column, rules: Sequence[Rule]) -> Column:
    """A struct of the column that each role has, null for roles without one. The first rule that fits a head decides about it."""
    roles = list(dict.fromkeys(r.role for r in rules))
    none = F.struct(*[F.lit(None).cast("int").alias(r) for r in roles])

    def next_(acc: Column, x: Column) -> Column:
        chosen = reduce(lambda other, rule: F.when(rule.fits(x["h"], acc), F.lit(rule.role)).otherwise(other), reversed(rules), F.lit(None).cast("string"))
        return F.transform(F.array(chosen), lambda c: F.struct(*[F.when(c == r, x["n"]).otherwise(acc[r]).alias(r) for r in roles]))[0]

    return F.aggregate(F.transform(heads, lambda h, n: F.struct(F.lower(h).alias("h"), n.alias("n"))), none, next_)


def _told(rows: DataFrame, key: str, rules: Sequence[Rule], fits: Column, links: Sequence[str]) -> DataFrame:
    """The data rows of each page's first table that fits, with a column for each role and the first link of the columns named."""
    first = F.min(F.when(fits, F.col("table"))).over(Window.partitionBy(key))
    own = rows.withColumn("_first", first).filter(F.col("table") == F.col("_first")).withColumn("_roles", column_roles(F.col("heads"), rules))
    cell = lambda role: F.get("cells", F.col(f"_roles.{role}"))
    text = lambda role: F.coalesce(cell(role)["text"], F.lit(""))
    roles = list(dict.fromkeys(r.role for r in rules))
    link = F.coalesce(*[cell(r)["href"] for r in links], F.lit(""))
    return own.select(key, "table", "row", "heads", "cells", *[text(r).alias(r) for r in roles], link.alias("url")).withColumn("state_code", state_code(F.col("state")))


def bill_tracker(rows: DataFrame, key: str) -> DataFrame:
    """Records of a tracker of bills: rows of three data cells or more that are no heads and name a state."""
    said = F.lower(F.array_join("heads", " "))
    fits = reduce(lambda a, b: a + b, [F.contains(said, F.lit(w)).cast("int") for w in BILL_HEADS]) >= BILL_HEADS_LEAST
    told = _told(rows, key, BILL_TRACKER, fits, ("bill_number", "bill_title"))
    low, first = F.transform("heads", F.lower), F.lower(F.get("cells", F.lit(0))["text"])
    data = F.size(F.filter("cells", lambda c: ~c["head"])) >= CELLS_LEAST
    return told.filter(data & ~F.array_contains(low, first) & (first != "state") & (F.col("state_code") != "")).drop("heads", "cells")


def law_tracker(rows: DataFrame, key: str) -> DataFrame:
    """Records of a tracker of laws: rows with data cells; the law's name may be that of its link."""
    said = F.lower(F.array_join("heads", " "))
    fits = reduce(and_, [F.contains(said, F.lit(w)) for w in LAW_HEADS])
    told = _told(rows, key, LAW_TRACKER, fits, ("law_url", "law_name"))
    shown = F.when(F.col("law_name") != "", F.col("law_name")).when(F.col("url") != "", F.col("law_url")).otherwise("")
    return told.filter(F.exists("cells", lambda c: ~c["head"])).withColumn("law_name", shown).drop("heads", "cells", "law_url")
