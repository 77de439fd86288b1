"""Where laws come from and what trackers know of them (inventory 2.1.16, 2.1.23, 2.1.30, 2.9.59, 2.9.60)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import origins as O
from ..functions.text import strip_sql
from ..operators import labelling as L
from ..operators.trackers import tracked, tracker_index
from ..registry import query
from ..sources.exports import bill_rows
from ..sources.tables import jurisdictions, laws, table, versions, with_domain

_SAID = "CASE page_id % 12 WHEN 0 THEN 'West Virginia Code, ' WHEN 1 THEN 'SB 4 (KY), ' WHEN 2 THEN 'Minn. Stat. 325: ' WHEN 3 THEN 'NYC rule ' WHEN 4 THEN 'KRS 367 ' WHEN 5 THEN 'XX of TX and KS: ' WHEN 6 THEN 'An Arkansas act ' WHEN 7 THEN 'W. Va. Code ' ELSE '' END"
_TITLE = f"{_SAID} || coalesce(regexp_extract(html, '<title>([^<]*)', 1), '')"
_URL = "CASE page_id % 10 WHEN 0 THEN replace(url, 'example', 'www.ilga.gov') WHEN 1 THEN 'https://www.LEGIS.state.pa.us/bill/' || page_id WHEN 2 THEN 'IAPP tracker, page ' || page_id WHEN 3 THEN ' https://files.orrick.com/' || page_id || '.PDF ' WHEN 4 THEN 'page ' || page_id WHEN 5 THEN 'https://leg.colorado.gov/hb' || page_id ELSE url END"


@query(f"""WITH r AS (SELECT page_id, coalesce({_TITLE}, '') AS title, coalesce({_URL}, '') AS url FROM pages), s AS ({O.inferred_state_sql('page_id', 'r')}), c AS (SELECT *, {O.url_class_sql('url')} AS kind FROM r)
SELECT page_id, state, kind, CASE WHEN kind NOT IN ('stub', 'none') THEN {strip_sql('url')} END AS primary_url, '{O.REFERENCE}/' || replace(state, ' ', '-') || '/' AS reference_url FROM c LEFT JOIN s USING (page_id)""")
def states_inferred(spark, d):
    """2.9.59, 2.9.60: the state of each page by address, name, code or citation, the kind of its address and what it is kept as.
    The lists are fixed, so each row is asked within itself."""
    rows = table(spark, d, "pages").select("page_id", F.expr(_TITLE).alias("title"), F.expr(_URL).alias("url"))
    found = rows.select("page_id", "url", O.inferred_state(F.col("title"), F.col("url")).alias("state"))
    return found.select("page_id", "state", O.url_class(F.col("url")).alias("kind"), O.primary_url(F.col("url")).alias("primary_url"), O.reference_url(F.col("state")).alias("reference_url"))


_BILL = "CASE version_id % 11 WHEN 0 THEN ' ' ELSE 'SB ' || version_id % 97 END"
_CITE = "CASE law_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'sb ' || law_id % 97 END"
_NAME = "CASE law_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' || lower(jurisdiction) ELSE jurisdiction END"


@query(with_domain(f"""b AS (SELECT lower(jurisdiction) AS name, 'j' || jurisdiction_id AS code, version_id, lower({_BILL}) AS number FROM versions JOIN laws USING (law_id) JOIN jurisdictions USING (jurisdiction_id)),
k AS (SELECT place, number, max(version_id) AS row FROM (SELECT name AS place, number, version_id FROM b UNION ALL SELECT code, number, version_id FROM b) WHERE trim(number) <> '' GROUP BY 1, 2),
a AS (SELECT law_id, lower(trim({_NAME})) AS name, 'j' || jurisdiction_id AS code, lower(coalesce(nullif({_CITE}, ''), 'SB ' || law_id % 90)) AS number FROM laws JOIN jurisdictions USING (jurisdiction_id))
SELECT law_id, coalesce(n.row, c.row) AS entry, CASE WHEN n.row IS NOT NULL THEN 'name' WHEN c.row IS NOT NULL THEN 'code' END AS how FROM a LEFT JOIN k n ON n.place = a.name AND n.number = a.number LEFT JOIN k c ON c.place = a.code AND c.number = a.number"""))
def tracker_entries(spark, d):
    """2.1.16: a tracker's rows by name or code of the jurisdiction and bill, the last row of a key, and the row of each law."""
    places = jurisdictions(spark, d)
    rows = versions(spark, d).join(laws(spark, d), "law_id").join(places, "jurisdiction_id").select("version_id", "jurisdiction", F.expr(_BILL).alias("bill"))
    code = F.concat(F.lit("J"), F.col("jurisdiction_id").cast("string")).alias("code")
    index = tracker_index(rows, places.select(F.col("jurisdiction").alias("name"), code), "version_id")
    asked = laws(spark, d).join(places, "jurisdiction_id").select("law_id", F.expr(_NAME).alias("name"), code, F.expr(_CITE).alias("cite"), F.expr("'SB ' || law_id % 90").alias("bill_id"))
    return tracked(asked, index).select("law_id", F.col("row.version_id").alias("entry"), "how")


_MODEL = "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 'm' || l_linenumber END"
_READ = "CASE WHEN l_suppkey % 5 <> 0 THEN l_partkey END"


@query(with_domain(f"""SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS agent_name, coalesce({_MODEL}, '') AS model_id, coalesce({_READ}, 0) AS input_tokens, l_suppkey AS output_tokens, l_quantity > 40 AS truncated, l_linestatus AS review_status, jurisdiction, 'law ' || law_id AS law, title,
coalesce(CASE WHEN l_linenumber % 4 <> 0 THEN '{{"flag":"' || l_returnflag || '","line":' || l_linenumber || '}}' END, '') AS payload_json, strftime(l_shipdate, '%Y-%m-%dT00:00:00') AS created_at FROM lineitem JOIN versions ON version_id = l_orderkey JOIN laws USING (law_id) JOIN jurisdictions USING (jurisdiction_id)"""))
def bill_export(spark, d):
    """2.1.23: what the export of facts on whole bills holds; `sources.exports.export_bills` writes it under its head."""
    payload = F.when(F.col("l_linenumber") % 4 != 0, F.to_json(F.struct(F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("line"))))
    taken = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("version_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("agent_name"), F.expr(_MODEL).alias("model_id"), F.expr(_READ).alias("input_tokens"),
        F.col("l_suppkey").alias("output_tokens"), (F.col("l_quantity") > 40).alias("truncated"), F.col("l_linestatus").alias("review_status"), payload.alias("payload_json"), F.col("l_shipdate").alias("created_at"),
    )
    named = laws(spark, d).select("law_id", "jurisdiction_id", F.concat(F.lit("law "), F.col("law_id").cast("string")).alias("law"), "title")
    return bill_rows(taken, versions(spark, d).select("version_id", "law_id"), named, jurisdictions(spark, d))


@query(f"""WITH r AS (SELECT doc_id AS id, length(source) * 7 + doc_id // 3 % 40 AS version, doc_id % 5 AS ordinal, text FROM documents), d AS (SELECT doc_id FROM labels WHERE quality = 1),
n AS (SELECT *, row_number() OVER (ORDER BY version NULLS FIRST, ordinal, id) - 1 AS k FROM r WHERE length({strip_sql('text')}) >= {L.LEAST} AND id NOT IN (SELECT doc_id FROM d))
SELECT id, version, ordinal, k // {L.BATCH} + 1 AS batch, k % {L.BATCH} + 1 AS place FROM n""")
def labelling_batches(spark, d):
    """2.1.30: passages that nobody has labelled yet, numbered in order and dealt in batches; `labels_read` takes labels in."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.expr("CAST(length(source) * 7 + doc_id div 3 % 40 AS BIGINT)").alias("version"), (F.col("doc_id") % 5).alias("ordinal"), "text")
    return L.batched(rows, table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("id")))


_ANSWER = """CASE doc_id % 6 WHEN 0 THEN '[{"passage_id": ' || doc_id || ', "extractions": [{"agent": "' || lang || '", "items": [{"n": ' || n_chars || ', "at": "' || source || '"}, {"n": ' || doc_id || '}]}]}, {"passage_id": ' || (doc_id + 1) || '}]'
WHEN 1 THEN '{"results": [{"passage_id": ' || (doc_id - 1) || ', "extractions": [{"agent": "en", "items": [{"n": ' || (doc_id - 1) || '}]}]}, {"extractions": []}]}' WHEN 2 THEN '{"passage_id": ' || (doc_id + 1000000000) || ', "extractions": [{"agent": "en", "items": [{}]}]}' WHEN 3 THEN CAST(doc_id AS STRING) ELSE coalesce(text, '') END"""


@query(f"""WITH v AS (SELECT 'f' || doc_id AS file, TRY_CAST({_ANSWER} AS JSON) AS j FROM documents), e AS (SELECT file, unnest(CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') WHEN json_exists(j, '$.results') THEN json_extract(j, '$.results[*]') ELSE [j] END) AS e FROM v WHERE json_type(j) IN ('ARRAY', 'OBJECT')),
p AS (SELECT file, nullif(CAST(e->>'$.passage_id' AS BIGINT), 0) AS passage_id, json_extract(e, '$.extractions[*]') AS blocks FROM e), k AS (SELECT *, CASE WHEN passage_id IS NULL THEN 'no passage id' WHEN passage_id NOT IN (SELECT doc_id FROM documents) THEN 'unknown passage' WHEN coalesce(len(blocks), 0) = 0 THEN 'abstained' END AS status FROM p),
b AS (SELECT file, passage_id, unnest(blocks) AS b FROM k WHERE status IS NULL), i AS (SELECT file, passage_id, b->>'$.agent' AS agent, unnest(json_extract(b, '$.items[*]')) AS i FROM b), g AS (SELECT passage_id, upper(agent) AS kind, n, CASE WHEN src IS NULL THEN '{{"n":' || n || '}}' ELSE '{{"at":"' || src || '","n":' || n || '}}' END AS payload, min(file || '|' || agent) AS f, count(*) AS times
FROM (SELECT *, i->>'$.n' AS n, i->>'$.at' AS src FROM i) WHERE agent IN ('en', 'de', 'fr') GROUP BY passage_id, agent, n, src),
o AS (SELECT file, passage_id, NULL AS agent, status FROM k WHERE status IS NOT NULL UNION ALL SELECT file, passage_id, b->>'$.agent', 'unknown agent' FROM b WHERE b->>'$.agent' NOT IN ('en', 'de', 'fr') UNION ALL SELECT file, NULL, NULL, CASE WHEN j IS NULL THEN 'no json' ELSE 'no entries' END FROM v WHERE coalesce(json_type(j), '') NOT IN ('ARRAY', 'OBJECT'))
SELECT status, kind, count(*) AS n, min(payload) AS payload, max(passage_id) AS passage_id, min(file) AS file FROM (SELECT file, passage_id, agent, NULL AS kind, NULL AS payload, status FROM o UNION ALL SELECT split_part(f, '|', 1), passage_id, split_part(f, '|', 2), kind, payload, 'label' FROM g UNION ALL SELECT split_part(f, '|', 1), passage_id, split_part(f, '|', 2), kind, payload, 'repeated' FROM g WHERE times > 1) GROUP BY 1, 2""")
def labels_taken(spark, d):
    """2.1.30: labels read out of answers on all documents, by status and kind: how many, and which come first or last."""
    docs = table(spark, d, "documents")
    answers = docs.select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file"), F.expr(_ANSWER).alias("text"))
    kinds = spark.createDataFrame([(c, c.upper()) for c in ("en", "de", "fr")], "agent string, kind string")
    known = spark.createDataFrame([], "passage_id long, kind string, payload string")
    found = L.labels_read(answers, docs.select(F.col("doc_id").alias("id")), kinds, known)
    return found.groupBy("status", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("payload").alias("payload"), F.max("passage_id").alias("passage_id"), F.min("file").alias("file"))
