"""Rules over whole tables: dates, status, authority, priority, routing, damage (inventory 2.9-2.11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import WHITE
from ..registry import query
from ..sources.tables import table, versions, with_domain

_SAID = "CASE version_id % 9 WHEN 0 THEN strftime(effective, '%Y-%m-%d') WHEN 1 THEN strftime(effective, '%Y-%m') WHEN 2 THEN '7/' || version_id % 28 || '/34' WHEN 3 THEN version_id % 12 + 1 || '/03/2026' WHEN 4 THEN 'on Sept 4 or October ' || version_id % 28 || ', 2031' WHEN 5 THEN 'Jan. 5 2026' WHEN 6 THEN 'by MAY 2027' WHEN 7 THEN 'effective 2029' ELSE 'pending' END"


@query(with_domain(f"SELECT version_id, said, {R.normal_date_sql('said')} AS day FROM (SELECT version_id, {_SAID} AS said FROM versions)"))
def dates_in_words(spark, d):
    """2.10.1: dates of seven shapes in ISO form."""
    as_spark = _SAID.replace("strftime(effective, '%Y-%m-%d')", "date_format(effective, 'yyyy-MM-dd')").replace("strftime(effective, '%Y-%m')", "date_format(effective, 'yyyy-MM')")
    rows = versions(spark, d).select("version_id", F.expr(as_spark).alias("said"))
    return rows.select("version_id", "said", R.normal_date(F.col("said")).alias("day"))


_STATUS = "CASE p_partkey % 8 WHEN 0 THEN 'Passed House; In Senate Committee' WHEN 1 THEN ' Signed by Governor' WHEN 2 THEN 'Stalled' WHEN 3 THEN 'vetoed, then enacted' WHEN 4 THEN 'Referred to Committee' WHEN 5 THEN 'in effect' WHEN 6 THEN 'carried over' ELSE p_name END"
_TITLE = "CASE p_partkey % 9 WHEN 0 THEN 'Proposed regulation on ' || p_type WHEN 1 THEN 'Executive Order' WHEN 2 THEN 'Smith v. Jones' WHEN 3 THEN 'Guidance for the Privacy Act' WHEN 4 THEN 'Consumer Act' WHEN 5 THEN 'A proposed bill' ELSE p_name END"
_URL = "CASE p_partkey % 5 WHEN 0 THEN 'https://www.federalregister.gov/proposed' WHEN 1 THEN 'https://legislature.example/x' ELSE '' END"
_BILL = "CASE p_partkey % 4 WHEN 0 THEN 'SB ' || p_size WHEN 1 THEN 'H.' || p_size ELSE '' END"


@query(f"SELECT p_partkey, {R.status_sql('status')} AS status, {R.authority_sql(1)} AS kind, {R.authority_sql(2)} AS effect, {R.authority_sql(3)} AS certainty FROM (SELECT p_partkey, {_STATUS} AS status, lower({_TITLE}) AS title, lower({_BILL}) AS bill, {_URL} AS url FROM part)")
def authority(spark, d):
    """2.9.37, 2.9.56: status and authority from free text, by ordered rules."""
    rows = table(spark, d, "part").select("p_partkey", F.expr(_STATUS).alias("status"), F.lower(F.expr(_TITLE)).alias("title"), F.lower(F.expr(_BILL)).alias("bill"), F.expr(_URL).alias("url"))
    return rows.select("p_partkey", R.status_of(F.col("status")).alias("status"), R.authority(1).alias("kind"), R.authority(2).alias("effect"), R.authority(3).alias("certainty"))


_NOTE = "CASE p_partkey % 10 WHEN 0 THEN 'up to $' || p_size || ' million' WHEN 1 THEN 'fine of $' || p_size || ',000 and $500' WHEN 2 THEN 'a misdemeanor, $5' WHEN 3 THEN 'no civil penalty' WHEN 4 THEN 'TBD, $5 million' WHEN 5 THEN '$' || p_size || '0k a day' WHEN 6 THEN 'by the attorney general' WHEN 7 THEN '' WHEN 8 THEN '$1.5m' END"
_MOST = f"list_max(list_transform(range(1, len(regexp_extract_all(low, '{R.DOLLARS}')) + 1), lambda i: TRY_CAST(replace(regexp_extract_all(low, '{R.DOLLARS}', 1)[i], ',', '') AS DOUBLE) * CASE WHEN starts_with(regexp_extract_all(low, '{R.DOLLARS}', 2)[i], 'm') THEN 1e6 WHEN regexp_extract_all(low, '{R.DOLLARS}', 2)[i] IN ('thousand', 'k') THEN 1e3 ELSE 1.0 END))"
_BAND = f"CASE WHEN coalesce(low, '') = '' THEN NULL WHEN regexp_matches(low, '{R.UNDECIDED}') THEN 'unspecified' WHEN regexp_matches(low, '{R.CRIMINAL}') THEN 'criminal' WHEN most >= 1e6 THEN 'over_1m' WHEN most >= 1e5 THEN '100k_to_1m' WHEN most >= 1e4 THEN '10k_to_100k' WHEN most IS NOT NULL THEN 'under_10k' WHEN regexp_matches(low, '{R.NO_PENALTY}') THEN 'none' ELSE 'unspecified' END"


def _weight_sql(c: str, weights: dict) -> str:
    return f"CASE {' '.join(f'WHEN {c} = {k!r} THEN {w}::DOUBLE' for k, w in weights.items())} ELSE 1.0::DOUBLE END"


_STANDING = "CASE p_size % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'closed' WHEN 2 THEN NULL ELSE 'enacted' END"
_RISK = "CASE p_partkey % 6 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' END"
_URGENCY = "CASE p_partkey % 7 WHEN 0 THEN 'now' WHEN 1 THEN 'soon' WHEN 2 THEN 'future' ELSE 'unknown' END"


@query(f"""WITH n AS (SELECT p_partkey, p_size, lower({_NOTE}) AS low, {_STANDING} AS standing, {_RISK} AS risk, {_URGENCY} AS urgency FROM part), m AS (SELECT *, {_MOST} AS most FROM n), b AS (SELECT *, {_BAND} AS band FROM m),
s AS (SELECT *, {_weight_sql('risk', R.RISK_WEIGHT)} * {_weight_sql('band', R.PENALTY_WEIGHT)} * {_weight_sql('urgency', R.URGENCY_WEIGHT)} AS product FROM b)
SELECT p_partkey, most, band, CASE WHEN standing IN ('open', 'closed') THEN 'P3' WHEN p_size < 2 THEN NULL WHEN product >= 4 AND standing = 'enacted' THEN 'P0' WHEN product >= 2 THEN 'P1' ELSE 'P2' END AS tier,
CASE WHEN standing IN ('open', 'closed') THEN 0.0 WHEN p_size < 2 THEN NULL ELSE product END::DOUBLE AS score FROM s""")
def priorities(spark, d):
    """2.11.13, 2.11.21: the largest penalty of a note, its band, and the law's priority."""
    rows = table(spark, d, "part").select("p_partkey", "p_size", *[F.expr(e).alias(n) for n, e in (("note", _NOTE), ("standing", _STANDING), ("risk", _RISK), ("urgency", _URGENCY))])
    band = R.penalty_severity(F.col("note"))
    found = rows.select("p_partkey", R.largest_dollars(F.col("note")).alias("most"), band.alias("band"), R.priority(F.col("standing"), F.col("p_size"), F.col("risk"), band, F.col("urgency")).alias("p"))
    return found.select("p_partkey", "most", "band", "p.tier", "p.score")


RECALL_RATE = 0.05
#: Each text is routed as it is, and once more behind a clause that signals something; structural lines stand for themselves.
_HEAD = "CASE kind WHEN 'whole' THEN text ELSE CASE doc_id % 5 WHEN 0 THEN 'Be it enacted ' || coalesce(text, '') WHEN 1 THEN 'It shall be defined ' || coalesce(text, '') WHEN 2 THEN 'the right to appeal; more than 5 means a penalty under federal law. ' || coalesce(text, '') WHEN 3 THEN 'Chapter ' || doc_id ELSE ' Definitions: ' END END"
_CLEAN = f"trim(regexp_replace(coalesce(body, ''), '{WHITE}', ' ', 'g'))"
_FOUND = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(low, '{p}') THEN '{k}' END" for k, p in R.SIGNALS.items()) + "], lambda x: x IS NOT NULL)"


@query(f"""WITH b AS (SELECT doc_id, kind, {_HEAD} AS body FROM documents, (VALUES ('whole'), ('led')) k(kind)), l AS (SELECT *, {_CLEAN} AS clean, regexp_replace(lower(coalesce(body, '')), '{R.LETTERS}', 'x', 'g') AS low FROM b), f AS (SELECT *, {_FOUND} AS found FROM l),
r AS (SELECT *, CASE WHEN regexp_matches(clean, '{R.STRUCTURE}') OR (regexp_matches(clean, '{R.ENACTING}') AND length(clean) < 300) THEN [] WHEN regexp_matches(clean, '{R.DEFINITIONS_HEAD}') THEN ['definition_actor'] WHEN len(found) = 0 OR len(found) >= 5 THEN {list(R.SIGNALS)} ELSE found END AS readers FROM f)
SELECT doc_id, kind, array_to_string(readers, ',') AS routed, len(readers) > 0 AND substr(md5(CAST(doc_id AS VARCHAR)), 1, 6) < '{int(RECALL_RATE * 16**6):06x}' AS bypassed FROM r""")
def routing(spark, d):
    """2.9.21, 2.9.25, 2.9.26: who reads a passage, by its signals, and the fixed twentieth of passages that all of them read."""
    each = table(spark, d, "documents").select("doc_id", "text", F.explode(F.array(F.lit("whole"), F.lit("led"))).alias("kind"))
    rows = each.select("doc_id", "kind", F.coalesce(F.expr(_HEAD), F.lit("")).alias("body"))
    routed = rows.select("doc_id", "kind", R.route(F.col("body")).alias("readers"))
    return routed.select("doc_id", "kind", F.array_join("readers", ",").alias("routed"), ((F.size("readers") > 0) & R.sampled(F.col("doc_id"), RECALL_RATE)).alias("bypassed"))


@query()
def text_damage(spark, d):
    """2.9.19, 2.4.32: damage of texts by its signs; runs of one character need a back-reference, which SQL lacks: tests compare a plain loop."""
    t = R.text_damage(F.col("text"))
    return table(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", "t.score", F.array_join("t.flags", ",").alias("flags"))


_TERM = r"[\"“]([^\"”]{2,80})[\"”]\s+(?:means?|refers? to|shall mean|is defined as|has the meaning)"
_DEFINED = "text || ' \"' || source || '\" means a source; “' || lang || ' text” refers to one. \"x\" means'"


@query(f"""SELECT doc_id, array_to_string(regexp_extract_all({_DEFINED}, '{_TERM}', 1), '|') AS terms, regexp_replace(regexp_replace('<think>' || lang || '</think>```json' || chr(10) || source || chr(10) || '```', '(?s)<think>.*?</think>', '', 'g'), '```(?:json)?\\s*', '', 'g') AS answer,
length(regexp_replace(coalesce(text, ''), '\\[[^\\]]*\\]', '', 'g')) < length(coalesce(text, '')) AS bracketed FROM documents""")
def defined_terms(spark, d):
    """2.9.29, 2.9.35, 2.12.4, 2.12.5: terms that a passage defines; answers without fences and reasoning."""
    docs = table(spark, d, "documents")
    answer = F.concat(F.lit("<think>"), F.col("lang"), F.lit("</think>```json\n"), F.col("source"), F.lit("\n```"))
    text = F.coalesce("text", F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(answer, r"(?s)<think>.*?</think>", ""), r"```(?:json)?\s*", "")
    terms = F.regexp_extract_all(F.expr(_DEFINED.replace('\\"', '"')), F.lit(_TERM), F.lit(1))
    return docs.select("doc_id", F.array_join(terms, "|").alias("terms"), bare.alias("answer"), (F.length(F.regexp_replace(text, r"\[[^\]]*\]", "")) < F.length(text)).alias("bracketed"))


_BILL_SAID = "CASE p_partkey % 6 WHEN 0 THEN 'Senate  Bill ' || p_size WHEN 1 THEN ' H.B. ' || p_size WHEN 2 THEN 'House Joint Resolution No. ' || p_size WHEN 3 THEN 'senate bill' WHEN 4 THEN 'SB-' || p_size ELSE p_name END"
_SUMMARY = "CASE p_partkey % 7 WHEN 0 THEN 'Deepfake notices in an ELECTION' WHEN 1 THEN 'Hiring by algorithmic means' WHEN 2 THEN 'Insurance disclosure' WHEN 3 THEN 'notice to a patient' WHEN 4 THEN 'School platform' WHEN 5 THEN '' ELSE p_type END"


@query(f"SELECT p_partkey, {R.bill_id_sql('bill')} AS bill, {R.category_sql('summary')} AS category FROM (SELECT p_partkey, {_BILL_SAID} AS bill, {_SUMMARY} AS summary FROM part)")
def bill_ids(spark, d):
    """2.9.44, 2.9.45, 2.9.58: bill numbers in one form, and categories by ordered words."""
    p = table(spark, d, "part").select("p_partkey", F.expr(_BILL_SAID).alias("bill"), F.expr(_SUMMARY).alias("summary"))
    return p.select("p_partkey", R.bill_id(F.col("bill")).alias("bill"), R.category(F.col("summary")).alias("category"))
