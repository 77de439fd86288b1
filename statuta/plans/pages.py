"""Pages, files and vocabularies over the test tables (inventory 2.1)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import page_tables as P
from ..operators.catalogue import field_catalogue
from ..operators.composed import composed
from ..operators.steps import shared_folder
from ..registry import query
from ..sources import append_log as L, files as S
from ..sources.tables import table

_HTML = "replace(html, '<p>', '<p><del class=\"x\">gone</del><span style=\"text-decoration: line-through\">too</span>')"
_LIKE = lambda words, c: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
_EXT = "CASE page_id % 4 WHEN 0 THEN '/a.HTML' WHEN 1 THEN '/b.txt' WHEN 2 THEN '/c.pdf' ELSE '/d' END"
_BODY = "CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN repeat('plain words. ', 40) || 'Section 5' ELSE repeat('plain words. ', 1 + page_id % 60) END"


@query(f"""SELECT page_id, CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'txt' THEN 'text/plain' WHEN 'html' THEN 'text/html' WHEN 'htm' THEN 'text/html' WHEN 'pdf' THEN 'application/pdf' ELSE 'application/octet-stream' END AS content_type, {S.page_text_sql(_HTML)} AS text, regexp_matches({_HTML}, '{S.STRUCK}') AS struck,
CASE WHEN octet_length(encode(body)) < 500 THEN 'too_short' WHEN {_LIKE(S.PORTAL, 'body[1:512]')} THEN 'capture_failed' WHEN {_LIKE(S.STATUTE, 'body')} THEN 'ok' ELSE 'no_statutory_structure' END AS status
FROM (SELECT page_id, url || {_EXT} AS path, coalesce(html, '') AS html, {_BODY} AS body FROM pages)""")
def page_texts(spark, d):
    """2.1.4, 2.1.5, 2.1.7, 2.1.8: texts of pages without deletions, and the gate that keeps portals and stubs out."""
    p = table(spark, d, "pages").select("page_id", F.concat("url", F.expr(_EXT)).alias("path"), F.coalesce("html", F.lit("")).alias("html"))
    rows = p.select("page_id", S.content_type(F.col("path")).alias("content_type"), F.expr(_HTML).alias("html"), F.encode(F.expr(_BODY), "UTF-8").alias("body"))
    return rows.select("page_id", "content_type", S.page_text(F.col("html")).alias("text"), F.col("html").rlike(S.STRUCK).alias("struck"), S.fulltext_status(F.col("body")).alias("status"))


@query("""WITH a AS (SELECT lower(p_type) AS term, 'T' || CAST(min(p_size) AS VARCHAR) AS code FROM part WHERE p_size > 25 GROUP BY 1), b AS (SELECT lower(p_brand) AS term, 'B' AS code FROM part WHERE p_size <= 10 GROUP BY 1),
v AS (SELECT term, arg_min(code, (rank, code)) AS code FROM (SELECT term, code, 2 AS rank FROM a UNION ALL SELECT term, code, 1 FROM b) GROUP BY 1)
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE ' ' || upper(p_brand) END AS raw, coalesce(code, 'other') AS raw_code FROM part LEFT JOIN v ON term = lower(trim(CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand END))""")
def coded_terms(spark, d):
    """2.1.17, 2.1.18: terms by a vocabulary of aliases and of a crosswalk that prevails; others fall back."""
    part = table(spark, d, "part")
    aliases = part.filter("p_size > 25").groupBy(F.col("p_type").alias("raw_term")).agg(F.concat(F.lit("T"), F.min("p_size").cast("string")).alias("code"))
    crosswalk = part.filter("p_size <= 10").select(F.lit("B").alias("code"), F.concat("p_brand", F.lit("; ;"), "p_brand").alias("terms"))
    raw = part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(F.concat(F.lit(" "), F.upper("p_brand"))).alias("raw"))
    return S.coded(raw, "raw", S.vocabulary(aliases, crosswalk))[0].select("p_partkey", "raw", "raw_code")


@query("""WITH v AS (SELECT DISTINCT lower(p_type) AS term FROM part WHERE p_size > 25) SELECT term, count(*) AS n FROM (SELECT lower(trim(CASE WHEN p_size % 2 = 0 THEN p_type ELSE ' ' || p_brand END)) AS term FROM part) WHERE term <> '' AND term NOT IN (SELECT term FROM v) GROUP BY 1""")
def unknown_terms(spark, d):
    """2.9.50: terms that the vocabulary lacks, with their counts, for its keepers to review."""
    part = table(spark, d, "part")
    terms = part.filter("p_size > 25").select(F.lower("p_type").alias("term"), F.lit("T").alias("code")).distinct()
    raw = part.select(F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.concat(F.lit(" "), "p_brand")).alias("raw"))
    return S.coded(raw, "raw", terms)[1]


# The links of a page's list as the rows of a tracker: stored pages have lists, and trackers have tables.
_TABLE = "regexp_replace(regexp_replace(regexp_replace(html, '<ul>', '<table><thead><tr><th>State<th>Bill Number</th><th colspan=2> Bill <b>title</b></th><th>Status</th></tr></thead>'{}), '</ul>', '<tr><td>State</td><td>x</td><td>y</td><td>z</td></tr><tr><td>Elsewhere<td>1<td>2<td>3</table>'{}), '<li><a href=\"([^\"]*)\">([^<]*)</a></li>', '<tr><td>In <i>New</i> York<td>SB <script>no</script>{1}2<td>{1}2, <table><tr><td>inner</table><td><a href=\" {1}1 \">{1}2</a></td><td>Signed</td></tr>'{})"


@query("""WITH p AS (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS hrefs, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS names FROM pages),
r AS (SELECT page_id, unnest(hrefs) AS href, unnest(names) AS name, generate_subscripts(names, 1) AS row FROM p)
SELECT page_id, row, 'In New York' AS state, 'NY' AS state_code, 'SB ' || name AS bill_number, name || ',' AS bill_title, 'Signed' AS status, '' AS url FROM r""")
def tracker_bills(spark, d):
    """2.1.13, 2.9.39: the bills of a tracker out of stored pages: the page's first table with the heads of one, its columns by what their heads
    say, its rows without heads and without those that name no state."""
    said = F.expr(_TABLE.replace("{1}", "$").replace("{}", ""))
    rows = P.table_rows(table(spark, d, "pages").select("page_id", said.alias("html")), "page_id", "html")
    return P.bill_tracker(rows, "page_id").select("page_id", "row", "state", "state_code", "bill_number", "bill_title", "status", "url")


_LAWS = _TABLE.replace("<th>Bill Number</th><th colspan=2> Bill <b>title</b></th><th>Status</th>", "<th>AI scope</th><th>Relevant law</th><th>Law link</th><th>Effective</th>")


@query("""WITH p AS (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS hrefs, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS names FROM pages),
r AS (SELECT page_id, unnest(hrefs) AS href, unnest(names) AS name, generate_subscripts(names, 1) AS row FROM p)
SELECT page_id, row, 'NY' AS state_code, 'SB ' || name AS scope, name || ',' AS law_name, trim(href) AS url, 'Signed' AS effective_date FROM r
UNION ALL SELECT page_id, len(names) + 1, '', 'x', 'y', '', '' FROM p UNION ALL SELECT page_id, len(names) + 2, '', '1', '2', '', '' FROM p""")
def tracker_laws(spark, d):
    """2.1.14: the laws of another tracker, whose name or link column has the law's address."""
    said = F.expr(_LAWS.replace("{1}", "$").replace("{}", ""))
    rows = P.table_rows(table(spark, d, "pages").select("page_id", said.alias("html")), "page_id", "html")
    return P.law_tracker(rows, "page_id").select("page_id", "row", "state_code", "scope", "law_name", "url", "effective_date")


# Accented letters as a letter and a mark behind it.
_APART = "replace(replace(replace(coalesce({}, ''), 'é', 'é'), 'ü', 'ü'), 'ñ', 'ñ')"


@query(f"SELECT doc_id, md5(nfc_normalize({_APART.format('text')})) AS composed, length({_APART.format('text')}) AS n_before, length(nfc_normalize({_APART.format('text')})) AS n_after FROM documents")
def texts_composed(spark, d):
    """2.9.1: texts with accents written apart, in composed form; texts without any never reach Python."""
    rows = table(spark, d, "documents").select("doc_id", F.expr(_APART.format("text")).alias("text")).withColumn("n_before", F.length("text").cast("long"))
    return composed(rows, "text").select("doc_id", F.md5("text").alias("composed"), "n_before", F.length("text").cast("long").alias("n_after"))


_PAYLOAD = """'{"title": "' || p_name || '", "size": ' || p_size || ', "maker": {"brand": "' || p_brand || '", "sizes": [' || p_size || ', 1.5, null]}, "flags": [{"on": true}, {"on": "' || p_type || '"}]' || CASE WHEN p_size % 3 = 0 THEN ', "deep": {"a": {"b": {"c": [[1], [], [{"d": {}}]]}}}' WHEN p_size % 7 = 0 THEN ', "cut' ELSE '' END || '}'"""


@query(f"""WITH t AS (SELECT unnest(f) AS x FROM (SELECT (SELECT list({{'fullkey': fullkey, 'type': type}}) FROM json_tree(p)) AS f FROM (SELECT {_PAYLOAD} AS p FROM part) WHERE json_valid(p)))
SELECT regexp_replace(regexp_replace(x.fullkey, '\\[[0-9]+\\]', '[]', 'g'), '"', '', 'g') AS path, CASE x.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind, count(*) AS n FROM t GROUP BY ALL""")
def payload_catalogue(spark, d):
    """2.8.19: paths and types that payloads have, as deep as they go; texts cut off have none."""
    return field_catalogue(table(spark, d, "part").select(F.expr(_PAYLOAD).alias("payload")), "payload")


@query("SELECT event_id AS record_id, 'answer_' || event_type AS warning_type, 'value ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS details, props AS raw_response FROM events WHERE event_type = 'error'")
def warnings_logged(spark, d):
    """2.1.27: warnings appended to a log of JSON lines and read back; a task that ran twice has its rows once."""
    e = table(spark, d, "events").filter("event_type = 'error'")
    rows = e.select(F.col("event_id").alias("record_id"), F.concat(F.lit("answer_"), "event_type").alias("warning_type"), F.concat(F.lit("value "), F.floor("value").cast("string")).alias("details"), F.col("props").alias("raw_response"))
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    L.append(L.warning_rows(rows), path)
    return L.read_log(spark, path, "record_id long, warning_type string, details string, raw_response string")
