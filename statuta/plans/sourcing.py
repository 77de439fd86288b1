"""Seeds, lookups with fallbacks, exports, bill contexts and agents (inventory 2.1.1, 2.1.21, 2.1.22, 2.1.24, 2.1.25, 2.2.12, 2.3.3, 2.3.18, 2.5.4,
2.9.34, 2.9.36, 2.9.40, 2.9.49, 2.9.51, 2.15.2-2.15.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bills as B
from ..operators.agents import Agents
from ..functions.text import strip_sql
from ..operators.places import neighbours
from ..operators.steps import Steps
from ..registry import query
from ..sources.tables import facts, jurisdictions, laws, table, versions, with_domain


@query(with_domain("""s AS (SELECT 'LAW-' || law_id % 700 AS canonical, law_id, trim(title) AS title, jurisdiction FROM laws LEFT JOIN jurisdictions USING (jurisdiction_id))
SELECT canonical, arg_min(title, law_id) AS title, arg_min(jurisdiction, law_id) AS jurisdiction, count(*) - 1 AS dropped FROM s GROUP BY 1"""))
def law_seeds(spark, d):
    """2.1.1: seed rows with their jurisdiction looked up, one for each canonical id, the first one."""
    rows = laws(spark, d).join(jurisdictions(spark, d), "jurisdiction_id", "left").select(F.concat(F.lit("LAW-"), (F.col("law_id") % 700).cast("string")).alias("canonical"), "law_id", F.trim("title").alias("title"), "jurisdiction")
    first = F.min(F.struct("law_id", "title", "jurisdiction"))
    return rows.groupBy("canonical").agg(first.alias("f"), (F.count(F.lit(1)) - 1).alias("dropped")).select("canonical", "f.title", "f.jurisdiction", "dropped")


@query(with_domain("""t AS (SELECT lower(title) AS k, min(law_id) AS by_title FROM laws GROUP BY 1), p AS (SELECT lower(title)[1:17] AS k, min(law_id) AS by_head FROM laws GROUP BY 1),
r AS (SELECT p_partkey, 'customer#' || lpad(CAST(p_partkey % 2000 AS VARCHAR), 9, '0') || CASE WHEN p_partkey % 3 = 0 THEN ' as amended' ELSE '' END AS said FROM part)
SELECT p_partkey, coalesce(by_title, by_head) AS law_id, CASE WHEN by_title IS NOT NULL THEN 'title' WHEN by_head IS NOT NULL THEN 'head' ELSE 'none' END AS how FROM r LEFT JOIN t ON t.k = said LEFT JOIN p ON p.k = said[1:17]"""))
def law_fallback(spark, d, head: int = 17):
    """2.2.12, 2.3.13: a law by its whole title, else by the head of it; each index has one row a key, so nothing is multiplied."""
    own = laws(spark, d).select("law_id", F.lower("title").alias("title"))
    said = F.concat(F.lit("customer#"), F.lpad((F.col("p_partkey") % 2000).cast("string"), 9, "0"), F.when(F.col("p_partkey") % 3 == 0, " as amended").otherwise(""))
    refs = table(spark, d, "part").select("p_partkey", said.alias("said")).withColumn("first", F.substring("said", 1, head))
    whole = own.groupBy(F.col("title").alias("said")).agg(F.min("law_id").alias("by_title"))
    part = own.groupBy(F.substring("title", 1, head).alias("first")).agg(F.min("law_id").alias("by_head"))
    rows = refs.join(whole, "said", "left").join(part, "first", "left")
    how = F.when(F.col("by_title").isNotNull(), "title").when(F.col("by_head").isNotNull(), "head").otherwise("none")
    return rows.select("p_partkey", F.coalesce("by_title", "by_head").alias("law_id"), how.alias("how"))


@query("""WITH b AS (SELECT user_id, count(*) AS attempts, arg_max(event_type, (ts, event_id)) AS last, max(value) FILTER (WHERE event_type = 'error') AS worst FROM events GROUP BY 1), l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS legal, max(ts) AS at FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY 1)
SELECT c_custkey, coalesce(attempts, 0) AS attempts, last, worst, legal FROM customer LEFT JOIN b ON user_id = c_custkey LEFT JOIN l ON l.user_id = c_custkey""")
def attempt_details(spark, d):
    """2.3.3, 2.5.4: each record with its attempts, the worst failure and its last event of given types; records without any stay."""
    e = table(spark, d, "events")
    last = lambda c: F.max_by("event_type", F.when(c, F.struct("ts", "event_id")))
    own = e.groupBy(F.col("user_id").alias("c_custkey")).agg(F.count(F.lit(1)).alias("attempts"), last(F.lit(True)).alias("last"), F.max(F.when(F.col("event_type") == "error", F.col("value"))).alias("worst"), last(F.col("event_type").isin("signup", "purchase")).alias("legal"))
    rows = table(spark, d, "customer").select("c_custkey").join(own, "c_custkey", "left")
    return rows.select("c_custkey", F.coalesce("attempts", F.lit(0)).alias("attempts"), "last", "worst", "legal")


@query(with_domain("""o AS (SELECT version_id, law_id, title, jurisdiction FROM versions JOIN laws USING (law_id) JOIN jurisdictions USING (jurisdiction_id))
SELECT CASE WHEN agent_id > 90 THEN '_unattributed' ELSE CAST(agent_id AS VARCHAR) END AS producer, tier IN ('C', 'D') AS low_confidence, count(*) AS n, min(title || '/' || jurisdiction || '/v' || version_id) AS provenance FROM facts JOIN o USING (version_id) GROUP BY 1, 2"""))
def export_groups(spark, d):
    """2.1.21, 2.1.22, 2.1.24: what the exports hold: facts with law, jurisdiction and version, by producer, and the weak ones apart."""
    # Spark sorts all rows to find the least of texts by group. Instead versions are sorted once by what is said of them, and each gets a number in that
    # order, which facts are grouped by in a few numbers' room.
    origin = versions(spark, d).join(laws(spark, d), "law_id").join(jurisdictions(spark, d), "jurisdiction_id").select("version_id", F.concat_ws("/", "title", "jurisdiction", F.concat(F.lit("v"), F.col("version_id").cast("string"))).alias("provenance"))
    ranked = Steps(spark).written("origin", origin.orderBy("provenance").withColumn("rank", F.monotonically_increasing_id()))
    producer = F.when(F.col("agent_id") <= 90, F.col("agent_id"))
    rows = facts(spark, d).select("version_id", producer.alias("producer"), F.col("tier").isin("C", "D").alias("low_confidence")).join(ranked.select("version_id", "rank"), "version_id")
    groups = rows.groupBy("producer", "low_confidence").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("rank"))
    return groups.join(ranked.select("rank", "provenance"), "rank").select(F.coalesce(F.col("producer").cast("string"), F.lit("_unattributed")).alias("producer"), "low_confidence", "n", "provenance")


@query("""SELECT conv_id, turn, concat_ws(' | ', lag(text) OVER w, text, lead(text) OVER w) AS context FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, text NULLS FIRST)""")
def neighbour_texts(spark, d):
    """2.3.18: each passage between the one before it and the one behind it; rows of one turn follow by their text."""
    return neighbours(table(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", F.concat_ws(" | ", "before", "text", "after").alias("context"))


_PATH = "CASE doc_id % 5 WHEN 0 THEN 'Definitions' WHEN 1 THEN 'Short-title' WHEN 2 THEN 'Remedies' ELSE 'Section ' || doc_id END"
_SAID = "CASE doc_id % 4 WHEN 0 THEN 'This act shall apply to all. ' WHEN 1 THEN 'The following terms have the meaning given: “' || lang || ' system” means this, \"' || upper(lang) || ' System\" refers to that; a violation is liable to fines up to. ' ELSE '' END || coalesce(text, '')"
_IS = lambda words, path: f"(regexp_matches(lower(path), '{path}') OR regexp_matches(lower(said[1:500]), '{words}'))"
# the budgets, marks and rules are written out here; they do not come from the code
_PARTS = lambda kind, most: f"""{kind} AS (SELECT source AS bill, string_agg(CASE WHEN upto <= {most} THEN bare WHEN nth = 1 THEN bare[1:{most} - 4] || ' [...]' END, chr(10) || '---' || chr(10) ORDER BY doc_id)
  || CASE WHEN min(upto) <= {most} AND max(upto) > {most} THEN chr(10) || '---' || chr(10) || '[... truncated ...]' ELSE '' END AS {kind}
  FROM (SELECT *, sum(length(bare) + 4) OVER w AS upto, row_number() OVER w AS nth FROM p WHERE is_{kind} AND bare <> '' WINDOW w AS (PARTITION BY source ORDER BY doc_id)) GROUP BY 1)"""  # noqa: E731


@query(f"""WITH q AS (SELECT *, {', '.join(f'{_IS(w, path)} AS in_{kind}' for kind, (w, path, _) in B.KINDS.items())}, {strip_sql('said')} AS bare FROM (SELECT doc_id, source, {_PATH} AS path, {_SAID} AS said FROM documents)),
p AS (SELECT *, in_definitions AS is_definitions, in_scope AS is_scope, in_enforcement AND NOT in_definitions AS is_enforcement FROM q), {_PARTS('definitions', 30000)}, {_PARTS('scope', 20000)}, {_PARTS('enforcement', 10000)},
o AS (SELECT source AS bill, string_agg('  ' || path, chr(10) ORDER BY doc_id) FILTER (WHERE upto <= 5000) || CASE WHEN max(upto) > 5000 THEN chr(10) || '  ...' ELSE '' END AS structure FROM (SELECT *, sum(length(path) + 3) OVER (PARTITION BY source ORDER BY doc_id) AS upto FROM p) GROUP BY 1),
x AS (SELECT source AS bill, doc_id, unnest(f) AS term, generate_subscripts(f, 1) AS i FROM (SELECT source, doc_id, regexp_extract_all(said, '["“]([^"”]{{2,80}})["”][ ]+(?:means?|refers? to|shall mean|is defined as|has the meaning)', 1) AS f FROM p WHERE is_definitions)),
t AS (SELECT bill, string_agg(term, '|' ORDER BY doc_id, i) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY bill, lower(term) ORDER BY doc_id, i) AS nth FROM x) WHERE nth = 1 GROUP BY 1),
n AS (SELECT source AS bill, count(*) AS total_passages, count(*) FILTER (WHERE is_definitions) AS definitions_passages, count(*) FILTER (WHERE is_enforcement) AS enforcement_passages FROM p GROUP BY 1)
SELECT bill, md5(coalesce(definitions, '')) AS definitions, md5(coalesce(scope, '')) AS scope, md5(coalesce(enforcement, '')) AS enforcement, md5(structure) AS structure, coalesce(terms, '') AS terms, total_passages, definitions_passages, enforcement_passages,
CASE WHEN length(coalesce(scope, '')) <= 800 THEN coalesce(scope, '') ELSE 'MATCHED SECTIONS:' || chr(10) || md5(scope) || chr(10) || chr(10) || 'OPENING OF BILL:' || chr(10) || scope[1:400] || chr(10) || chr(10) || 'END OF BILL:' || chr(10) || right(scope, 400) END AS excerpt
FROM n LEFT JOIN definitions USING (bill) LEFT JOIN scope USING (bill) LEFT JOIN enforcement USING (bill) LEFT JOIN o USING (bill) LEFT JOIN t USING (bill)""")
def bill_contexts(spark, d):
    """2.9.34, 2.9.36, 2.9.40: what a reader of one passage is told of its bill: passages that define, set the scope or enforce,
    as far as budgets go, an outline, the terms defined, counts, and an excerpt. That the first 500 characters tell a
    passage's kind is the reference's rule."""
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("bill"), F.expr(_PATH).alias("path"), F.expr(_SAID).alias("said"))
    found = B.bill_context(rows, "bill", "doc_id", "said", "path")
    counts = ("total_passages", "definitions_passages", "enforcement_passages")
    return found.select("bill", *[F.md5(k).alias(k) for k in (*B.KINDS, "structure")], F.array_join("defined_terms", "|").alias("terms"), *counts, B.bill_excerpt(F.col("scope"), F.md5("scope"), 400).alias("excerpt"))


_RAW = "CASE p_partkey % 5 WHEN 0 THEN 'any ' || p_brand WHEN 1 THEN p_type WHEN 2 THEN '' ELSE 'someone' END"
_NAMED = "CASE p_partkey % 7 WHEN 0 THEN p_brand WHEN 1 THEN 'website' WHEN 2 THEN 'a  b  c' WHEN 3 THEN 'ab' WHEN 4 THEN NULL ELSE 'coded ' || p_size END"
_CODE = "CASE p_partkey % 4 WHEN 0 THEN 'civil_penalty' WHEN 1 THEN 'ag_enforcement' WHEN 2 THEN 'own words' END"


@query(f"""WITH a AS (SELECT lower(p_type) AS term, 'coded ' || min(p_size) AS code FROM part GROUP BY 1), r AS (SELECT p_partkey, {_RAW} AS raw, {_NAMED} AS named, {_CODE} AS penalty FROM part),
c AS (SELECT r.*, a.code AS raw_code, CASE WHEN trim(named) <> '' AND length(trim(named)) > 3 AND lower(trim(named)) NOT IN ({', '.join(f"'{w}'" for w in B.NO_ACTORS)}) AND NOT regexp_matches(trim(named), '\\s{{2,}}|\\t') THEN trim(named) END AS clean FROM r LEFT JOIN a ON a.term = lower(trim(raw)))
SELECT p_partkey, CASE WHEN coalesce(trim(raw), '') = '' THEN clean WHEN clean IS NOT NULL AND (contains(lower(raw), lower(clean)) OR coalesce(raw_code = lower(clean), FALSE)) THEN clean ELSE raw_code END AS actor, CASE penalty WHEN 'civil_penalty' THEN 'Civil penalty' WHEN 'ag_enforcement' THEN 'AG enforcement' ELSE penalty END AS penalty FROM c""")
def actors_reconciled(spark, d):
    """2.9.49, 2.9.51, 2.9.62: actors that agree with what was said, by words or by the alias table, and penalties in words."""
    part = table(spark, d, "part")
    alias = part.groupBy(F.lower("p_type").alias("term")).agg(F.concat(F.lit("coded "), F.min("p_size").cast("string")).alias("raw_code"))
    rows = part.select("p_partkey", F.expr(_RAW).alias("raw"), F.expr(_NAMED).alias("named"), F.expr(_CODE).alias("penalty"))
    rows = rows.withColumn("term", F.lower(F.trim("raw"))).join(alias, "term", "left")
    actor = B.reconciled_actor(F.col("raw"), F.col("named"), F.col("raw_code"), F.lit(None).cast("string"))
    return rows.select("p_partkey", actor.alias("actor"), B.penalty_label(F.col("penalty")).alias("penalty"))


@query("""WITH f AS (SELECT doc_id, 'numbers' AS agent, unnest(regexp_extract_all(coalesce(text, ''), '[0-9]+')) AS fact FROM documents UNION ALL SELECT doc_id, 'origin', source FROM documents WHERE source IS NOT NULL)
SELECT doc_id, agent, count(*) AS n, max(fact) AS most FROM f WHERE agent = 'origin' OR length(fact) > 1 GROUP BY 1, 2""")
def agent_facts(spark, d):
    """2.15.2-2.15.5: agents as plug-ins that read all passages in one pass, one of them with a hook that drops what is too short."""
    agents = Agents()
    agents.add("numbers", lambda text, _: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[0-9]+"), F.lit(0)), lambda fact, _: F.when(F.length(fact) > 1, fact))
    agents.add("origin", lambda _, context: F.array_compact(F.array(context)))
    found = agents.facts(table(spark, d, "documents"), "doc_id", "text", "source")
    return found.groupBy("doc_id", "agent").agg(F.count(F.lit(1)).alias("n"), F.max("fact").alias("most"))
