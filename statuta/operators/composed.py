"""Texts in composed form (NFC), which Spark has no function for (inventory 2.9.1).

Nearly all texts are composed already, and one look at their characters tells: those of the ranges in SAFE are never the second half
of a composition and have none of their own, so a text of nothing else is its own composed form and stays in the JVM. The rows with
any other character, and no others, pass through Python in Arrow batches, each with all its columns, and both parts are put together.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .steps import in_parts

#: Ranges of characters that composition neither changes nor joins to what stands before: Latin with its accented letters, Greek and
#: Cyrillic letters, the usual punctuation, Kana without voicing marks, Han, Hangul syllables.
SAFE = r"\x{0000}-\x{02FF}\x{0388}-\x{03FF}\x{0400}-\x{0482}\x{048A}-\x{0523}\x{2010}-\x{2027}\x{202F}-\x{205E}\x{20A0}-\x{20BF}\x{2190}-\x{21FF}\x{2500}-\x{26FF}\x{3001}-\x{3020}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{3400}-\x{4DB5}\x{4E00}-\x{9FA5}\x{AC00}-\x{D7A3}"


def surely_composed(text: Column) -> Column:
    return ~F.coalesce(text.rlike(f"[^{SAFE}]"), F.lit(False))


def composed(rows: DataFrame, text: str) -> DataFrame:
    """`rows` with `text` in composed form; nulls stay null."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            own = pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in b.column(text).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([own if c == text else b.column(c) for c in names], names=names)

    sure = surely_composed(F.col(f"`{text}`"))
    return rows.filter(sure).unionByName(rows.filter(~sure).mapInArrow(run, rows.schema))
