"""Rows of a tracker by jurisdiction and bill (inventory 2.1.16, 2.1.31)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import strip
from ..sources.sinks import _lacking, last_write


def _key(c: str | Column) -> Column:
    return F.lower(strip(F.col(c) if isinstance(c, str) else c))


def tracker_index(rows: DataFrame, codes: DataFrame, order: str) -> DataFrame:
    """`rows` (jurisdiction, bill, ...) under two keys each, the jurisdiction's name and its code out of `codes` (name, code), both
    in lower case: place, number, row. Of rows with one key the last by `order` stays, and of a name's codes the largest; rows
    without jurisdiction or bill have no key. A key is reduced before it is shuffled, so that one that many rows share stays
    small."""
    keyed = rows.select(_key("jurisdiction").alias("place"), _key("bill").alias("number"), F.struct(order, *[c for c in rows.columns if c != order]).alias("row"))
    keyed = keyed.filter("place <> '' AND number <> ''").groupBy("place", "number").agg(F.max("row").alias("row"))
    known = codes.select(_key("name").alias("place"), _key("code").alias("code")).filter("place <> '' AND code <> ''").groupBy("place").agg(F.max("code").alias("code"))
    coded = keyed.join(known, "place").select(F.col("code").alias("place"), "number", "row")
    return keyed.unionByName(coded).groupBy("place", "number").agg(F.max("row").alias("row"))


def tracked(asked: DataFrame, index: DataFrame) -> DataFrame:
    """`asked` (name, code, cite, bill_id, ...) with `row` of the index, null for none, and `how`: the bill is the short citation, or
    the id where there is none; the jurisdiction's name is asked first, then its code. Each row of `asked` stays once."""
    number = _key(F.coalesce(F.nullif("cite", F.lit("")), F.col("bill_id")))
    rows = asked.withColumns({"_name": _key("name"), "_code": _key("code"), "_number": number})
    by = lambda key, as_: index.select(F.col("place").alias(key), F.col("number").alias("_number"), F.col("row").alias(as_))
    both = rows.join(by("_name", "_named"), ["_name", "_number"], "left").join(by("_code", "_coded"), ["_code", "_number"], "left")
    how = F.when(F.col("_named").isNotNull(), "name").when(F.col("_coded").isNotNull(), "code")
    return both.select(*asked.columns, F.coalesce("_named", "_coded").alias("row"), how.alias("how"))


def edited(rows: DataFrame, changed: DataFrame, gone: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """A tracker after an edit: changed rows in place of those with their keys, new ones added, and the keys in `gone` out of it.
    The same edit twice changes nothing."""
    return _lacking(last_write(rows, changed, keys, order), gone, keys)
