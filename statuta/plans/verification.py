"""Facts verified in passes (inventory 2.14.5)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.citations import SECTION_SIGN
from ..functions.text import WHITE, any_script, strip_sql
from ..operators import verification as V
from ..operators.steps import shared_folder
from ..registry import query
from ..sources.tables import table

# A fact for each document: a quote, as it is, with other signs or from elsewhere; a number; a section of its source.
_QUOTE = "CASE doc_id % 4 WHEN 0 THEN substr(text, 11, 40) WHEN 1 THEN translate(substr(text, 5, 30), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN 2 THEN replace(substr(text, 1, 30), ' ', ' ; ') ELSE 'said nowhere ' || lang END"
_NUMBER = "CASE doc_id % 3 WHEN 0 THEN regexp_extract(text, '[0-9]+', 0) WHEN 1 THEN CAST(doc_id AS {}) END"
_CITED = "CASE doc_id % 5 WHEN 0 THEN 'Sec. ' || doc_id % 40 WHEN 1 THEN '§ ' || left(text, 9) WHEN 2 THEN NULL ELSE 'Part ' || doc_id % 400 END"
_PATH = "CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN ' SECTION ' || left(text, 20) ELSE 'Section ' || doc_id % 90 END"
_CITE = lambda c: f"regexp_replace(regexp_replace({strip_sql(f'lower({c})')}, '{any_script(SECTION_SIGN)}', 'section '), '{WHITE}', ' ', 'g')"
_LOOSE = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_HOW = "CASE WHEN path = ref THEN 1 WHEN starts_with(path, ref) THEN 2 WHEN contains(path, ref) OR contains(ref, path) THEN 3 WHEN number <> '' AND contains(path, number) THEN 4 END"


@query(f"""WITH f AS (SELECT doc_id AS fact_id, source, coalesce(text, '') AS text, {_QUOTE} AS quote, nullif({_NUMBER.format('VARCHAR')}, '') AS said, coalesce({_CITE(_CITED)}, '') AS ref FROM documents),
p AS (SELECT source, path, min(doc_id) AS place FROM (SELECT source, doc_id, {_CITE(f"coalesce({_PATH}, '')")} AS path FROM documents) WHERE path <> '' GROUP BY ALL),
s AS (SELECT fact_id, how, place FROM (SELECT fact_id, place, {_HOW} AS how FROM (SELECT *, regexp_extract(ref, '[0-9]+') AS number FROM f WHERE ref <> '') JOIN p USING (source))),
b AS (SELECT fact_id, min(how) AS how, arg_min(place, (how, place)) AS section FROM s WHERE how IS NOT NULL GROUP BY 1)
SELECT f.fact_id, {_LOOSE.format('quote')} <> '' AND contains({_LOOSE.format('text')}, {_LOOSE.format('quote')}) AS quote_found, CASE WHEN said IS NOT NULL THEN list_contains(regexp_extract_all(text, '[0-9]+'), said) END AS number_found,
section, ['exact', 'prefix', 'substring', 'number'][how] AS section_how, fact_id % 10 < 3 AS was_changed FROM f LEFT JOIN b USING (fact_id)""")
def facts_verified(spark, d):
    """2.14.5: two passes: the first over facts of which three in ten are then corrected; the second checks those alone, and its stamps are what
    a pass over everything would give."""
    docs = table(spark, d, "documents")
    path = f"{shared_folder(spark)}/passages-{uuid.uuid4().hex}"
    V.store_passages(docs.select(F.col("doc_id").alias("passage_id"), F.col("source").alias("law"), F.expr(_PATH).alias("path"), "text"), path)
    facts = docs.select(F.col("doc_id").alias("fact_id"), F.col("doc_id").alias("passage_id"), F.expr(_QUOTE).alias("quote"), F.expr(_NUMBER.format("STRING")).alias("number"), F.expr(_CITED).alias("cited"))
    wrong = F.col("fact_id") % 10 < 3
    first, _ = V.verification_pass(spark, facts.withColumn("quote", F.when(wrong, F.lit("nothing")).otherwise(F.col("quote"))), path)
    stamps = V.Steps(spark).written("stamps", first)
    second, _ = V.verification_pass(spark, facts, path, stamps)
    before = stamps.select(F.col("fact_id").alias("_f"), F.col("fingerprint").alias("_old"))
    return second.join(before, F.col("fact_id") == F.col("_f")).select("fact_id", *V.CHECKS, (F.col("fingerprint") != F.col("_old")).alias("was_changed"))
