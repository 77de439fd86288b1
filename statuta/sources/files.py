"""Files as tables: texts and pages with their quality, vocabularies, exports (inventory 2.1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# What counts as a text too short, as a captured portal, and as a statute; bytes that are looked at for each.
LEAST_BYTES, HEAD_BYTES, SCAN_BYTES = 500, 512, 20_000
PORTAL = ("Rocket NXT", "enable JavaScript", "<html", "<!DOCTYPE html")
STATUTE = ("AN ACT", "Be it enacted", "BE IT ENACTED", "SECTION ", "Section ", "WHEREAS", "§", "CHAPTER ", "Chapter ", "Subd.")
#: Extensions by precedence, with the type they stand for.
TYPES = {"txt": "text/plain", "html": "text/html", "htm": "text/html", "pdf": "application/pdf"}


def _any(c: Column, words) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(c, F.lit(w))
    return found


def fulltext_status(content: Column) -> Column:
    """ok, too_short, capture_failed (a portal's page) or no_statutory_structure, from a file's bytes, null counting
    as none. Read as Latin-1, whose characters are bytes: the section sign is one of them, and the last one of its UTF-8 form."""
    raw = F.coalesce(content, F.lit("").cast("binary"))
    latin = lambda n: F.decode(F.substring(raw, 1, n), "ISO-8859-1")
    return F.when(F.octet_length(raw) < LEAST_BYTES, "too_short").when(_any(latin(HEAD_BYTES), PORTAL), "capture_failed").when(_any(latin(SCAN_BYTES), STATUTE), "ok").otherwise("no_statutory_structure")


def content_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), ext), F.lit("application/octet-stream"))


def local_files(spark: SparkSession, folder: str) -> DataFrame:
    """law_id, path, content_type, status, content: one file for each law, by precedence of its extension. Paths and sizes choose
    the file, so that no content is shuffled; contents are read for the chosen ones. Spark lists no file of 0 bytes, so a law that has nothing else is absent."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    rank = F.array_position(F.array(*map(F.lit, TYPES)), ext)
    names = files.select("path", F.regexp_extract("path", r"([^/]+)\.[A-Za-z0-9]+$", 1).alias("law_id"), rank.alias("rank")).filter("rank > 0")
    chosen = names.groupBy("law_id").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))
    found = files.select("path", "content").join(chosen, "path")
    return found.select("law_id", "path", content_type(F.col("path")).alias("content_type"), fulltext_status(F.col("content")).alias("status"), "content")


def split_quarantine(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that pass, and the others with the reason; the input stays as it is."""
    return files.filter("status = 'ok'"), files.filter("status <> 'ok'").select("law_id", "path", F.col("status").alias("reason"))


STRUCK = r"(?is)<(strike|del|s)(?:\s[^>]*)?>.*?</(?:strike|del|s)>"
STRUCK_STYLE = r"(?is)<span[^>]*line-through[^>]*>.*?</span>"
UNSEEN = r"(?is)<(?:script|style|nav|header|footer|noscript)(?:\s[^>]*)?>.*?</(?:script|style|nav|header|footer|noscript)>"
TAG, BLOCK_END = r"(?s)<[^>]*>", r"(?i)</(?:p|div|li|tr|h[1-6]|section|article)>|<br\s*/?>"
# Entities that pages use most; the ampersand comes last.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&sect;": "§", "&amp;": "&"}


def unstruck(html: Column) -> Column:
    """Without what is marked as deleted."""
    return F.regexp_replace(F.regexp_replace(html, STRUCK, ""), STRUCK_STYLE, "")


def page_text(html: Column) -> Column:
    """The text of a page: no scripts, frame, deletions or tags; one line a block."""
    text = F.regexp_replace(F.regexp_replace(unstruck(html), UNSEEN, " "), BLOCK_END, "\n")
    text = F.regexp_replace(text, TAG, " ")
    for k, v in ENTITIES.items():
        text = F.replace(text, F.lit(k), F.lit(v))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " "), r" ?\n[\n ]*", "\n"), F.lit(" \n"))


def page_text_sql(html: str) -> str:
    text = f"regexp_replace(regexp_replace({html}, '{STRUCK}', '', 'g'), '{STRUCK_STYLE}', '', 'g')"
    text = f"regexp_replace(regexp_replace(regexp_replace({text}, '{UNSEEN}', ' ', 'g'), '{BLOCK_END}', chr(10), 'g'), '{TAG}', ' ', 'g')"
    for k, v in ENTITIES.items():
        text = f"replace({text}, '{k}', '{v.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace(regexp_replace({text}, '[\\x20\\x09\\x0B-\\x0D]+', ' ', 'g'), ' ?\\n[\\n ]*', chr(10), 'g'), ' ' || chr(10))"


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table with a header, all columns as text; blank cells are null."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return rows.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) for c in rows.columns])


def vocabulary(aliases: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """term, code: `aliases` (raw_term, code) and `crosswalk` (code, terms: a list parted by semicolons), whose codes prevail; among
    equals the smallest code. Terms are compared in lower case."""
    a = aliases.select(F.lower(F.trim("raw_term")).alias("term"), "code", F.lit(2).alias("rank"))
    b = crosswalk.select(F.explode(F.split("terms", ";")).alias("term"), "code").select(F.lower(F.trim("term")).alias("term"), "code", F.lit(1).alias("rank"))
    known = a.unionByName(b).filter("term <> '' AND code IS NOT NULL")
    return known.groupBy("term").agg(F.min_by("code", F.struct("rank", "code")).alias("code"))


def coded(rows: DataFrame, column: str, terms: DataFrame, fallback: str = "other") -> tuple[DataFrame, DataFrame]:
    """`rows` with <column>_code, and the terms that the vocabulary lacks with their counts. Whether the vocabulary is broadcast is
    left to its measured size."""
    key = F.lower(F.trim(F.col(column)))
    joined = rows.withColumn("_term", key).join(terms.select(F.col("term").alias("_term"), F.col("code").alias("_code")), "_term", "left")
    unknown = joined.filter("_code IS NULL AND _term <> ''").groupBy(F.col("_term").alias("term")).agg(F.count(F.lit(1)).alias("n"))
    return joined.withColumn(f"{column}_code", F.coalesce("_code", F.lit(fallback))).drop("_term", "_code"), unknown


def merge_continuations(rows: DataFrame, order_col: str, key_col: str, table_col: str) -> DataFrame:
    """Rows without a key continue the row before them: their cells are appended to its cells. A table is one page of a tracker."""
    place = Window.partitionBy(table_col).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    blocks = rows.withColumn("_block", F.count_if(F.col(key_col).isNotNull()).over(place)).filter("_block > 0")
    cells = [c for c in rows.columns if c not in (order_col, table_col)]
    lists = [F.transform(F.filter(F.sort_array(F.collect_list(F.struct(order_col, F.col(c).alias("v")))), lambda x: x["v"].isNotNull()), lambda x: x["v"]).alias(c) for c in cells]
    merged = blocks.groupBy(table_col, "_block").agg(F.min(order_col).alias(order_col), *lists)
    return merged.select(table_col, order_col, *[F.array_join(c, " ").alias(c) for c in cells])


def export(facts: DataFrame, path: str, by: str, form: str = "csv") -> None:
    """One folder for each producer, `_unattributed` for rows without one. Rows are spread over tasks, so that a producer of a third
    of all rows is written by many of them."""
    rows = facts.withColumn(by, F.coalesce(F.col(by).cast("string"), F.lit("_unattributed")))
    rows.write.mode("errorifexists").partitionBy(by).format(form).option("header", True).save(path)


def low_confidence(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("tier").isin("C", "D"))
