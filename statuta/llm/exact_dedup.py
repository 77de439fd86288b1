"""Exact dedup: documents of equal normalised text, by 128-bit hash and then by bytes.

Defined results: a null text counts as empty; texts of any length are compared whole; rows repeated in full form a group like any other copies; the row with
the smallest doc_id stays (a null doc_id only where all of the group are null); an empty table gives no rows; other
columns are ignored by `exact_groups` and carried along by `drop_exact_copies`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import SPACE, packed, text_or_empty


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (and the 128-bit text_md5).

    Rows are grouped by (128-bit hash, bytes): map-side aggregation folds copies before the shuffle, so a group of
    any size sends one row per task, and two texts that share a hash stay apart. Only hashes travel in the join back.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.regexp_replace(text_or_empty(text_col), SPACE, " ").alias("norm"))
    groups = (
        base.groupBy(F.md5("norm").alias("text_md5"), "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("text_md5", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    rows = base.select("doc_id", F.md5("norm").alias("text_md5"), F.sha2("norm", 256).alias("text_sha256"))
    return rows.join(groups, ["text_md5", "text_sha256"], "left").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "text_md5"
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; of rows repeated in full, one."""
    key = lambda i, md5: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("")), md5)
    kept = exact_groups(docs, id_col, text_col).filter("kept").select(key(F.col("doc_id"), F.col("text_md5")).alias("key"))
    keyed = docs.select(packed(docs), key(F.col(id_col), F.md5(F.regexp_replace(text_or_empty(text_col), SPACE, " "))).alias("key"))
    return keyed.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("doc.*")
