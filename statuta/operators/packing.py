"""Texts cut into passages of about one size (inventory 2.5.7, 2.9.16, 2.1.9)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Characters of a passage, of a paragraph that is still kept whole, and of a piece that is not dropped.
TARGET, WHOLE_MOST, PIECE_LEAST = 3000, 15_000, 10


_RUN = T.StructType([T.StructField(n, T.IntegerType()) for n in ("first", "size", "own")])


@F.pandas_udf(T.ArrayType(_RUN))
def _runs(lengths: pd.Series, owners: pd.Series, target: pd.Series) -> pd.Series:
    """Runs of pieces, as full as the target allows; pieces of different owners never share a run. A fold, which no frame can say."""

    def fold(ns, owns, most):
        found, held = [], 0
        for i, (n, own) in enumerate(zip(ns, owns)):
            if not found or own != found[-1]["own"] or held + n > most:
                found.append({"first": i + 1, "size": 0, "own": own})
                held = 0
            found[-1]["size"] += 1
            held += n
        return found

    return pd.Series([fold(n, o, t) for n, o, t in zip(lengths, owners, target)])


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def passages(docs: DataFrame, target: int = TARGET, whole_most: int = WHOLE_MOST, id_col: str = "doc_id") -> DataFrame:
    """id, ordinal (from 1), label, passage. Paragraphs are joined while they fit; one above `whole_most` is cut at its lines and
    shares its passages with no other. Nothing is shuffled: each document is packed where it is. Null and empty texts give no row."""
    long_enough = lambda x: F.length(x) >= PIECE_LEAST
    paragraphs = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\n(?U:\s)*\n"), _stripped), long_enough)
    piece = lambda t, own: F.struct(t.alias("t"), own.alias("own"))

    def pieces(p: Column, i: Column) -> Column:
        lines = F.filter(F.transform(F.split(p, "\n"), _stripped), long_enough)
        some = F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit("")))
        return F.when(F.length(p) > whole_most, F.transform(some, lambda t: piece(t, i))).otherwise(F.array(piece(p, F.lit(-1))))

    cut = docs.select(id_col, F.flatten(F.transform(paragraphs, pieces)).alias("pieces")).filter(F.size("pieces") > 0)
    runs = _runs(F.transform("pieces", lambda x: F.length(x["t"])), F.transform("pieces", lambda x: x["own"]), F.lit(target))
    text = lambda r: F.array_join(F.transform(F.slice("pieces", r["first"], r["size"]), lambda x: x["t"]), "\n")
    spaced = lambda r: F.array_join(F.transform(F.slice("pieces", r["first"], r["size"]), lambda x: x["t"]), "\n\n")
    packed = cut.withColumn("runs", runs)
    made = F.filter(F.transform("runs", lambda r: F.when(r["own"] < 0, spaced(r)).otherwise(text(r))), lambda t: t != "")
    rows = packed.select(id_col, F.posexplode(made).alias("at", "passage"))
    return rows.select(id_col, (F.col("at") + 1).alias("ordinal"), F.concat(F.lit("Paragraph "), (F.col("at") + 1).cast("string")).alias("label"), "passage")
