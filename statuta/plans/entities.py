"""Names, numbers and addresses in one form, over whole tables (inventory 2.3.14, 2.9.18, 2.9.27-2.9.30, 2.9.31-2.9.33, 2.9.38, 2.9.41,
2.9.46, 2.9.48, 2.9.53, 2.9.59)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions.text import bound
from ..operators import segments as G
from ..registry import query
from ..sources.tables import laws, table, with_domain

_CODE = "CASE p_partkey % 9 WHEN 0 THEN 'CO' WHEN 1 THEN 'CA' WHEN 2 THEN 'NY' WHEN 3 THEN 'tx' WHEN 4 THEN 'CT' WHEN 5 THEN 'IL' WHEN 6 THEN 'UT' WHEN 7 THEN 'US' END"
_CITED = """CASE p_partkey % 9 WHEN 0 THEN CASE p_size % 2 WHEN 0 THEN 'C.R.S. § 6-1-' || p_size || '(3)(a)' ELSE 'Colo. Rev. Stat. § ' || p_size END WHEN 1 THEN 'Cal. Bus. & Prof. Code § ' || p_size WHEN 2 THEN CASE p_size % 2 WHEN 0 THEN 'N.Y. Gen. Bus. Law § 899-' || p_size ELSE 'New York Laws Chapter ' || p_size END
WHEN 3 THEN 'Tex. Bus. & Com. Code Ann. § ' || p_size || '.001' WHEN 4 THEN 'Conn. Gen. Stat. ' || p_size || 'a-701b' WHEN 5 THEN p_size || ' ILCS 5/' || p_size || '-110' WHEN 6 THEN 'Utah Code Ann. § 13-37-' || p_size WHEN 7 THEN p_size || ' U.S.C. § 6501' ELSE CASE p_size % 3 WHEN 0 THEN ' Section  ' || p_size || '(a)' WHEN 1 THEN 'Subsection ' || p_size ELSE '&sect;' || p_size END END"""


@query(f"SELECT p_partkey, {C.normal_citation_sql('ref', 'code')} AS citation FROM (SELECT p_partkey, {_CITED} AS ref, {_CODE} AS code FROM part)")
def citations_normal(spark, d):
    """2.9.46: citations of eight jurisdictions as the sign of a section and its number."""
    rows = table(spark, d, "part").select("p_partkey", F.expr(_CITED).alias("ref"), F.expr(_CODE).alias("code"))
    return rows.select("p_partkey", C.normal_citation(F.col("ref"), F.col("code")).alias("citation"))


_SAID = "CASE p_partkey % 6 WHEN 0 THEN ' ny ' WHEN 1 THEN 'West Virginia' WHEN 2 THEN 'the State of New Mexico' WHEN 3 THEN 'zz' WHEN 4 THEN 'arkansas' ELSE p_name END"
_ID = "CASE p_partkey % 4 WHEN 0 THEN 'TMP-' || p_partkey WHEN 1 THEN 'CO-' || p_partkey WHEN 2 THEN NULL ELSE 'TMP-x' END"
_BILL = "CASE p_size % 3 WHEN 0 THEN ' SB ' || p_size WHEN 1 THEN '' END"
_PLACE = "CASE p_size % 2 WHEN 0 THEN 'co' END"
_URL = "CASE p_partkey % 3 WHEN 0 THEN 'https://r.jina.ai/https://leg.example/' || p_partkey WHEN 1 THEN 'https://leg.example/' END"
_ACTOR = "CASE p_partkey % 5 WHEN 0 THEN 'regulator' WHEN 1 THEN 'individual' WHEN 2 THEN '' WHEN 3 THEN 'deployer' END"


@query(f"""SELECT p_partkey, {C.state_code_sql('said')} AS state, coalesce(starts_with(id, 'TMP-'), FALSE) AS placeholder, CASE WHEN starts_with(id, 'TMP-') THEN CASE WHEN coalesce(trim(bill), '') = '' THEN NULL WHEN place IS NULL THEN trim(bill) ELSE upper(place) || ' ' || trim(bill) END END AS name,
CASE WHEN starts_with(url, 'https://r.jina.ai/') THEN url[19:] ELSE url END AS url, CASE WHEN coalesce(actor, '') = '' THEN NULL WHEN actor IN ('regulator', 'government_agency') THEN 'government' WHEN actor = 'individual' THEN 'individual' ELSE 'regulated_entity' END AS role
FROM (SELECT p_partkey, {_SAID} AS said, {_ID} AS id, {_BILL} AS bill, {_PLACE} AS place, {_URL} AS url, {_ACTOR} AS actor FROM part)""")
def entity_forms(spark, d):
    """2.9.38, 2.9.48, 2.9.53, 2.9.59: states by code, name or part of it; placeholder ids; addresses without proxy; roles of actors."""
    rows = table(spark, d, "part").select("p_partkey", *[F.expr(e).alias(n) for n, e in (("said", _SAID), ("id", _ID), ("bill", _BILL), ("place", _PLACE), ("url", _URL), ("actor", _ACTOR))])
    name = C.placeholder_name(F.col("id"), F.col("bill"), F.col("place"))
    return rows.select("p_partkey", C.state_code(F.col("said")).alias("state"), C.is_placeholder(F.col("id")).alias("placeholder"), name.alias("name"), C.source_url(F.col("url")).alias("url"), C.actor_role(F.col("actor")).alias("role"))


_NAMED = "CASE doc_id % 4 WHEN 0 THEN 'The Connecticut General Statutes provide; ' WHEN 1 THEN 'Ohio, Iowa and Ohio: ' WHEN 2 THEN 'In Texas ' ELSE '' END || coalesce(text, '')"
_NAMES_SQL = "(VALUES " + ", ".join(f"('{n}', '{c}')" for n, c in C.STATES.items()) + ") s(name, code)"
_TITLES_SQL = "(VALUES " + ", ".join(f"('{p}', '{c}')" for c, p in C.STATE_TITLES.items()) + ") s(title, code)"


@query(f"""WITH t AS (SELECT doc_id, lower({_NAMED}) AS low FROM documents), n AS (SELECT doc_id, code, len(regexp_extract_all(low, '\\b' || name || '\\b')) AS k FROM t, {_NAMES_SQL} WHERE contains(low, name)
UNION ALL SELECT doc_id, code, 3 * len(regexp_extract_all(low, title)) FROM t, {_TITLES_SQL}), c AS (SELECT doc_id, code, CAST(sum(k) AS BIGINT) AS k FROM n GROUP BY 1, 2 HAVING sum(k) >= 2)
SELECT doc_id, arg_max(code, (k, code)) AS code, max(k) AS strength FROM c GROUP BY 1""")
def jurisdictions_told(spark, d):
    """2.9.41: the state that a whole text names most, its statutes' titles counting three times; two mentions at least. The
    lists are fixed, so each text is asked within its row."""
    def told(low):
        strength = {}
        for name, code in C.STATES.items():
            strength.setdefault(code, []).append(F.when(F.contains(low, F.lit(name)), F.regexp_count(low, F.lit(rf"\b{name}\b"))).otherwise(0))
        for code, title in C.STATE_TITLES.items():
            strength[code].append(F.regexp_count(low, F.lit(title)) * C.TITLE_WEIGHT)
        return F.array_max(F.array(*[F.struct(sum(k[1:], k[0]).cast("long").alias("k"), F.lit(code).alias("code")) for code, k in strength.items()]))

    found = table(spark, d, "documents").select("doc_id", bound(F.lower(F.expr(_NAMED)), told).alias("t"))
    return found.filter(F.col("t.k") >= C.SIGNAL_LEAST).select("doc_id", F.col("t.code").alias("code"), F.col("t.k").alias("strength"))


_LINK = "CASE p_partkey % 3 WHEN 0 THEN 'SB ' || p_size WHEN 1 THEN 'hb' || p_size ELSE 'AB ' || p_size END"
_OWN = "CASE law_id % 5 WHEN 0 THEN 'SB 24-' || law_id % 50 WHEN 1 THEN 'AB ' || law_id % 90 || '/HB ' || law_id % 40 WHEN 2 THEN 'HB' || law_id % 50 WHEN 3 THEN ' ' ELSE 'XX 1' END"
_KEY = lambda c: f"upper(regexp_replace({c}, '\\s+', '', 'g'))"


@query(with_domain(f"""l AS (SELECT {_KEY(_LINK)} AS key, min(p_partkey) AS link FROM part GROUP BY 1), o AS (SELECT law_id, {_OWN} AS bill FROM laws),
k AS (SELECT law_id, 1 AS rank, {_KEY('bill')} AS key FROM o UNION ALL SELECT law_id, 2, regexp_replace({_KEY('bill')}, '^([A-Z]{{1,3}})[0-9]{{2}}-', '\\1') FROM o UNION ALL SELECT law_id, 2 + i, {_KEY("string_split(bill, '/')[i]")} FROM o, (VALUES (1), (2)) h(i) WHERE contains(bill, '/'))
SELECT law_id, arg_min(link, rank) AS link, min(rank) AS how FROM k JOIN l USING (key) WHERE key <> '' GROUP BY 1"""))
def bill_links(spark, d):
    """2.3.14: links to laws by bill number: as it is, without the year, or by a half of a double number, the first that hits."""
    key = lambda c: F.upper(F.regexp_replace(c, r"\s+", ""))
    links = table(spark, d, "part").groupBy(key(F.expr(_LINK)).alias("key")).agg(F.min("p_partkey").alias("link"))
    own = laws(spark, d).select("law_id", F.expr(_OWN).alias("bill"))
    halves = F.when(F.contains("bill", F.lit("/")), F.transform(F.split("bill", "/"), lambda x: key(x))).otherwise(F.array().cast("array<string>"))
    keys = F.concat(F.array(key(F.col("bill")), F.regexp_replace(key(F.col("bill")), r"^([A-Z]{1,3})[0-9]{2}-", "$1")), halves)
    asked = own.select("law_id", F.posexplode(keys).alias("at", "key")).filter("key <> ''")
    return asked.join(links, "key").groupBy("law_id").agg(F.min_by("link", "at").alias("link"), (F.min("at") + 1).alias("how"))


_RESTATED = "CASE p_partkey % 4 WHEN 0 THEN 'Section ' || p_size % 5 || '.1 of the Penal Code, as amended, is amended to read: ' WHEN 1 THEN 'Section ' || p_size || ' is added to the Civil Code. Section 7.5 is added to it. ' WHEN 2 THEN 'Section 5 of the Penal Code. It is amended to read: ' ELSE '' END || p_name"
AMENDED = r"^\s*Section\s+([0-9]+(?:\.[0-9]+)*)\s+of\s+the\s+(.+?Code)[^.]{0,120}?\bis\s+amended\s+to\s+read\s*:"
ADDED = r"Section\s+([0-9]+(?:\.[0-9]+)*)\s+is\s+added\s+to"


@query(f"""WITH r AS (SELECT p_partkey, p_brand, p_name, {_RESTATED} AS t FROM part), a AS (SELECT *, nullif(lower(trim(regexp_extract(t, '{AMENDED}', 2))) || ':' || regexp_extract(t, '{AMENDED}', 1), ':') AS target FROM r),
g AS (SELECT *, count(*) OVER w AS n, max(p_partkey) OVER w AS last FROM a WINDOW w AS (PARTITION BY p_brand, target)) SELECT p_partkey, target, CASE WHEN target IS NOT NULL AND n > 1 THEN n END AS n_parallel, target IS NOT NULL AND n > 1 AND last = p_partkey AS speaks, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '{ADDED}', 1))), ',') AS added,
CASE WHEN length(t) < 20 THEN 0.5 WHEN length(t) > 5000 THEN 0.8 ELSE 1.0 END::DOUBLE AS quality FROM g""")
def restatements(spark, d):
    """2.9.18, 2.9.27, 2.9.28, 2.9.30: what a passage restates, versions of one section side by side with the last to speak for
    them, sections that are added, and quality by length. Groups are counted before they meet their members again."""
    t = F.expr(_RESTATED)
    target = F.nullif(F.concat(F.lower(F.trim(F.regexp_extract(t, AMENDED, 2))), F.lit(":"), F.regexp_extract(t, AMENDED, 1)), F.lit(":"))
    quality = F.when(F.length(t) < 20, 0.5).when(F.length(t) > 5000, 0.8).otherwise(1.0)
    rows = table(spark, d, "part").select("p_partkey", "p_brand", target.alias("target"), F.array_join(F.sort_array(F.array_distinct(F.regexp_extract_all(t, F.lit(ADDED), F.lit(1)))), ",").alias("added"), quality.alias("quality"))
    groups = rows.filter("target IS NOT NULL").groupBy("p_brand", "target").agg(F.count(F.lit(1)).alias("n"), F.max("p_partkey").alias("last")).filter("n > 1")
    found = rows.join(groups, ["p_brand", "target"], "left")
    return found.select("p_partkey", "target", F.col("n").alias("n_parallel"), F.coalesce(F.col("last") == F.col("p_partkey"), F.lit(False)).alias("speaks"), "added", "quality")


_MARKED = "replace(coalesce(text, ''), chr(10), chr(10) || chr(10) || 'Section ' || (doc_id % 90 + 1) || '. ')"


@query()
def sections_cut(spark, d):
    """2.9.14, 2.9.15: whole texts as sections, marker-only heads joined with what follows, small ones packed; tests compare a loop."""
    rows = table(spark, d, "documents").select("doc_id", F.expr(_MARKED).alias("text"))
    return G.sectioned(rows, "doc_id", "text").select("doc_id", "place", "section", F.length("text").alias("size"), "start", "end", F.array_join("markers", "|").alias("markers"))


_SCOPED = "'Lead. (a) ' || coalesce(text, '') || ' (1) a synthetic voice (2) as in subdivision (b) and (d) (b) ' || source || ' under Section 12.5 (A) x (B) y (c) ' || lang"


@query()
def scope_regions(spark, d):
    """2.9.31-2.9.33: regions of restated sections that a bill is about, and their excerpt; tests compare worked examples."""
    rows = table(spark, d, "documents").select("doc_id", F.expr(_SCOPED).alias("text"), F.array(F.lit("12.5")).alias("added"))
    found = G.scoped(rows, "doc_id", "text", "added")
    return found.select("doc_id", F.length("excerpt").alias("excerpt_size"), F.inline("regions"))


@query()
def evidence_offsets(spark, d):
    """2.9.4, 2.9.8: where altered quotes stand in the raw texts; tests compare offsets of known quotes."""
    quote = F.upper(F.regexp_replace(F.expr("substr(text, CAST(1 + (doc_id * 31) % greatest(length(text) - 60, 1) AS INT), 60)"), "[ ,.]+", " ; "))
    rows = table(spark, d, "documents").select("doc_id", quote.alias("quote"), "text")
    return G.located(rows, "doc_id", "quote", "text")
