"""Quality rules: word and repetition counts, and lines that too many documents of a host share.

A line is normalised (ASCII white space stripped at both ends, A-Z lower-cased) and hashed to 64 bits. For every host
(`source`) the distinct documents that hold it are counted; a line above the limit is taken out of all of them, and a
document of which too little is left is rejected. The limit follows the host: more than `MIN_DOCS` documents, and more
than `MAX_PERCENT_OF_HOST` percent of the host's rows.

Defined results: a null or empty text has no words, fails the base rules and is not kept; a text of any length is counted
whole, within its row; a null host is a host of its own; a line at the limit exactly stays; rows repeated in full count as
one document that holds a line, and share one verdict; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import WORD, text_or_empty, words_of

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A line is taken out if more documents than this, and more than this share of the host's rows, hold it.
MIN_DOCS = 5
MAX_PERCENT_OF_HOST = 2
#: A document is depleted if fewer words, or a smaller share of its words, are left.
MIN_WORDS_LEFT = 10
MIN_PERCENT_LEFT = 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window found twice or more. `hashes`: the hash of the window at each start, in order.

    Starts are sorted by hash, so equal windows are neighbours; the starts kept are then sorted again and each covers
    the words up to the next one, `window` at most. A text without equal windows, which a hash set tells, is not sorted.
    """
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(a: Column) -> Column:
        paired = lambda x, k: x["h"].eqNullSafe(F.get(a, k - 1)["h"]) | x["h"].eqNullSafe(F.get(a, k + 1)["h"])
        return F.sort_array(F.array_compact(F.transform(a, lambda x, k: F.when(paired(x, k), x["i"]))))

    covered = lambda s: F.aggregate(F.transform(s, lambda i, k: F.least(F.lit(window), F.coalesce(F.get(s, k + 1) - i, F.lit(window)))), F.lit(0), lambda t, n: t + n)
    # one-element arrays bind a value to a name inside an expression
    bound = lambda value, f: F.transform(F.array(value), f)[0]
    heavy = bound(placed, lambda a: bound(starts(a), covered))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(heavy)


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: doc_id, host, text_key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Everything happens within the row: no shuffle."""
    words = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text_or_empty(text_col).alias("text")).withColumn("words", words_of(F.col("text")))
    hashed = words.select(
        "doc_id",
        "host",
        F.xxhash64("text").alias("text_key"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("word_hashes"),
    )
    last = F.size("word_hashes") - WINDOW
    windows = F.when(last < 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get("word_hashes", i + k) for k in range(WINDOW)])))
    counted = hashed.withColumn("windows", windows).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    counted = counted.withColumn("n_repeat_words", repeated_words(F.col("windows")).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.select("doc_id", "host", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def document_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """host, line (hash), doc_id, text_key, words: one row for each distinct normalised line of a document that has words."""
    lines = F.split(F.translate(text_or_empty(text_col), _UPPER, _LOWER), "\n", -1)
    parts = F.filter(F.transform(lines, lambda x: F.struct(F.xxhash64(F.trim(x, F.lit(" \t\n\x0b\x0c\r"))).alias("line"), F.regexp_count(x, F.lit(WORD)).alias("n"))), lambda p: p["n"] > 0)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.xxhash64(text_or_empty(text_col)).alias("text_key"), parts.alias("parts"))
    each = rows.select("doc_id", "host", "text_key", F.explode(line_runs(F.col("parts"))).alias("run"))
    return each.select("host", F.col("run.line").alias("line"), "doc_id", "text_key", F.col("run.words").alias("words"))


def line_runs(parts: Column) -> Column:
    """(line, words) of each distinct line: lines are sorted, so equal ones are neighbours, and each run is counted from where
    it starts to where the next one does. One sort and one pass, however many lines a text has."""
    bound = lambda value, f: F.transform(F.array(value), f)[0]

    def runs(a: Column) -> Column:
        starts = F.array_compact(F.transform(a, lambda x, i: F.when((i == 0) | (x["line"] != F.get(a, i - 1)["line"]), i)))
        run = lambda s: F.transform(s, lambda i, k: F.struct(F.get(a, i)["line"].alias("line"), ((F.coalesce(F.get(s, k + 1), F.size(a)) - i) * F.get(a, i)["n"]).alias("words")))
        return bound(starts, run)

    return bound(F.sort_array(parts), runs)


def line_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, max_percent: float = MAX_PERCENT_OF_HOST) -> DataFrame:
    """base_counts plus n_common_words (words of lines above the limit), depleted and kept.

    Lines above the floor, at most one in `min_docs` of all, meet the sizes of their hosts; the join by host has one row
    a host on its other side, so a hot host's lines can be split."""
    base = base_counts(docs, id_col, text_col, host_col)
    lines = document_lines(docs, id_col, text_col, host_col)
    hosts = docs.groupBy(F.col(host_col).alias("of")).agg(F.count(F.lit(1)).alias("host_rows"))
    once = lines.groupBy("host", "line", "doc_id", "text_key").agg(F.max("words").alias("words"))
    # each line has words; that `words` is asked for here too lets both uses of `once` share one shuffle
    common = once.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"), F.min("words").alias("least")).filter((F.col("n") > min_docs) & (F.col("least") > 0))
    common = common.join(hosts, F.col("host").eqNullSafe(F.col("of"))).filter(100 * F.col("n") > max_percent * F.col("host_rows"))
    common = common.select(F.col("host").alias("h"), F.col("line").alias("l"))
    removed = once.join(common, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l"))).groupBy("doc_id", "text_key", "host").agg(F.sum("words").alias("n_common_words"))
    removed = removed.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), F.col("host").alias("h"), "n_common_words")
    out = base.join(removed, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")) & F.col("host").eqNullSafe(F.col("h")), "left")
    common_words = F.coalesce(F.col("n_common_words"), F.lit(0)).cast("long")
    left = F.col("n_words") - common_words
    depleted = (common_words > 0) & ((left < MIN_WORDS_LEFT) | (100 * left < MIN_PERCENT_LEFT * F.col("n_words")))
    out = out.withColumn("n_common_words", common_words).withColumn("depleted", depleted)
    return out.select(*base.columns, "n_common_words", "depleted", (~F.col("base_failed") & ~F.col("depleted")).alias("kept"))
