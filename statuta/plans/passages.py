"""Passages: text, date, number and score functions over whole tables (inventory 2.9-2.11)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import scores, text as T, vocabularies as V
from ..operators import vocabularies as W
from ..operators.steps import Steps
from ..registry import query
from ..sources.tables import facts, table, tier_of, tier_sql, versions, with_domain

CHROME = T.PAGE_CHROME
MARKERS = T.any_word(T.LEGAL_MARKERS)
#: Invented prose has no such words, so that some texts are led in by a clause.
_CLAUSES = "CASE doc_id % 5 WHEN 0 THEN 'Section 5. The provider of a high-risk SYSTEM shall, pursuant to a§b, disclose its training data; the penalty is provided in the statute. ' WHEN 1 THEN 'Skip to content | Bill search | Privacy policy | ' WHEN 2 THEN repeat('the obligation shall be enforced notwithstanding any regulation or statute; ', 40) || 'algorithmic ' ELSE '' END || text"
_UP, _LOW = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _hits(words) -> str:
    return "(" + " + ".join(f"CAST(contains(low, '{w}') AS INT)" for w in words) + ")"


_BOTH = lambda c: T.fold_sql(T.fold_sql(c), T.WIDE_FOLD)
_FOLDED = lambda c: f"trim(regexp_replace({_BOTH(c)}, '{T.WHITE}', ' ', 'g'))"
_LOOSE = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_QUALITY = (
    "CASE WHEN coalesce(length(text), 0) = 0 THEN 0.0 ELSE floor((greatest(0.0::DOUBLE, 1 - ((length(text) - length(replace(text, '�', ''))) / length(text)::DOUBLE) / 0.05::DOUBLE) * 0.6::DOUBLE "
    f"+ least(1.0::DOUBLE, (len(regexp_extract_all(lower(text), '{MARKERS}')) / length(text)::DOUBLE * 1000) / 5.0::DOUBLE) * 0.4::DOUBLE) * 10000 + 0.5) / 10000 END"
)


# What is known of each law (a source): topics, of which one is how its first passage begins, and two summaries.
_TOPICS = "array(min(lang) || '; Automated Decision Systems / ' || min(left(text, 9)), CASE WHEN count(*) % 2 = 0 THEN 'ai, Deepfakes' END)"
_SUMMARIES = ("CASE WHEN count(*) % 3 = 0 THEN 'The deployer shall AUDIT; transparency, and a notice of its notices' END", "CASE WHEN count(*) % 2 = 1 THEN 'Fines; the penalty is an injunction' END")
_LIST = lambda c, words: f"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '\\b[a-z]{{4,}}\\b'), lambda w: w IN ({', '.join(repr(w) for w in words)}))"


@query(f"""WITH c AS (SELECT source, {_TOPICS.replace('array(', 'list_value(')} AS topics, {_SUMMARIES[0]} AS reqs, {_SUMMARIES[1]} AS enf FROM documents GROUP BY 1),
l AS (SELECT source, list_distinct(list_concat(list_filter(list_transform(flatten(list_transform(list_filter(topics, lambda t: t IS NOT NULL), lambda t: regexp_split_to_array(t, '[;,/]'))), lambda t: lower({T.strip_sql('t')})), lambda t: length(t) >= 3),
  {_LIST('reqs', V.REQUIREMENT_WORDS)}, {_LIST('enf', V.ENFORCEMENT_WORDS)})) AS terms FROM c),
p AS (SELECT *, lower(text) AS low FROM (SELECT doc_id, source, {_CLAUSES} AS text FROM documents)),
n AS (SELECT doc_id, {_QUALITY} AS quality, length(text) // 4 AS n_tokens, sha256(text)[1:24] AS key, {_hits(CHROME)} AS chrome, len(list_filter(terms, lambda t: contains(low, t))) AS law,
      {_hits(V.KEYWORDS)} + len(list_filter(terms, lambda t: contains(low, t))) + CAST(regexp_matches(text, '(?i)\\b(?:a\\.?i\\.?)\\s+(?:system|model|tool|application|technology)|\\bautomat(?:ed|ic)\\s+(?:decision|system|process|tool)') AS INT) AS hits FROM p LEFT JOIN l USING (source))
SELECT doc_id, quality, n_tokens, key, law AS law_terms, CASE WHEN quality < 0.3 OR chrome >= 3 THEN 'reject' WHEN hits > 0 THEN 'accept' ELSE 'uncertain' END AS decision,
CASE WHEN quality < 0.3 THEN 0.9 WHEN chrome >= 3 THEN 0.95 WHEN hits > 0 THEN round(least(0.95, 0.7 + 0.05 * hits), 4) ELSE 0.5 END::DOUBLE AS confidence FROM n""")
def passage_triage(spark, d):
    """2.9.13, 2.9.17, 2.9.20, 2.9.22-2.9.24, 2.9.63: quality, site chrome, keywords and the terms of the passage's own law decide about it. All
    vocabularies are one automaton, which reads each text once; a law's terms count for its own passages."""
    docs = table(spark, d, "documents")
    context = docs.groupBy(F.col("source").alias("law")).agg(F.expr(_TOPICS).alias("topics"), *[F.expr(c).alias(k) for c, k in zip(_SUMMARIES, ("reqs", "enf"))])
    # one small row a law, read three times below
    laws_ = Steps(spark).written("laws", context.select("law", V.law_terms(F.col("topics"), F.col("reqs"), F.col("enf")).alias("terms")))
    own = laws_.select(F.explode("terms").alias("term")).distinct().select(F.lit("law").alias("kind"), F.lit(0).alias("place"), "term", F.lit("in").alias("rule"))
    terms = W.terms_of(spark, "chrome", CHROME).unionByName(W.terms_of(spark, "keyword", V.KEYWORDS)).unionByName(own)
    text = docs.select("doc_id", F.col("source").alias("law"), F.expr(_CLAUSES).alias("text"))
    ready = text.select("doc_id", "law", T.parse_quality(F.col("text"), MARKERS).alias("quality"), F.expr("CAST(length(text) DIV 4 AS BIGINT)").alias("n_tokens"), T.content_key(F.col("text")).alias("key"), V.key_pattern(F.col("text")).alias("pattern"), F.lower("text").alias("low"))
    found = W.with_hits(ready, "low", terms).join(laws_.withColumnRenamed("law", "l"), F.col("law").eqNullSafe(F.col("l")), "left")
    of_law = F.coalesce(F.size(F.array_intersect(W.of_kind("law"), "terms")), F.lit(0))
    counts = found.select("doc_id", "quality", "n_tokens", "key", of_law.cast("long").alias("law_terms"), F.size(W.of_kind("chrome")).alias("chrome"), (F.size(W.of_kind("keyword")) + of_law + F.col("pattern").cast("int")).alias("hits"))
    return counts.select("doc_id", "quality", "n_tokens", "key", "law_terms", T.cascade(F.col("quality"), F.col("chrome"), F.col("hits")).alias("t")).select("doc_id", "quality", "n_tokens", "key", "law_terms", "t.decision", "t.confidence")


# a quote from anywhere in the text: as it is, in capitals, with other signs, with parted words, with numbered lines, with hard spaces
_QUOTED = "substr(text, CAST(1 + (doc_id * 31) % greatest(length(text) - 60, 1) AS INT), 60)"
_SPAN = f"CASE doc_id % 6 WHEN 0 THEN {_QUOTED} WHEN 1 THEN translate({_QUOTED}, '{_UP}', '{_LOW}') WHEN 2 THEN replace({_QUOTED}, ' ', ' ; ') WHEN 3 THEN replace({_QUOTED}, 'en', concat('e-', chr(10), ' n')) WHEN 4 THEN replace({_QUOTED}, ' ', concat(chr(10), ' 12 ')) ELSE replace(replace({_QUOTED}, ' ', '\u202f'), '.', '\u2009.') END"


def _unprinted(c: str) -> str:
    text = _BOTH(c)
    for pattern, kept in ((T.HYPHEN_BREAK, r"\1\2"), (T.MARGIN_NUMBER, r"\1"), (T.SECTION_GLYPH, r"\1 \2"), ("[ \\t]{2,}", " ")):
        text = f"regexp_replace({text}, '{pattern}', '{kept}', 'g')"
    return text


@query(f"""SELECT doc_id, CASE WHEN length(q) = 0 THEN NULL WHEN contains(t, q) THEN 1 WHEN contains(lower(t), lower(q)) THEN 2 WHEN length(lq) >= 15 AND contains(lt, lq) THEN 3
WHEN length(bq) >= 25 AND contains(bt, bq) THEN 4 END AS tier FROM (SELECT *, {_LOOSE.format('t')} AS lt, {_LOOSE.format('q')} AS lq, {_LOOSE.format('ut')} AS bt, {_LOOSE.format('uq')} AS bq
FROM (SELECT doc_id, {_FOLDED('text')} AS t, {_FOLDED('span')} AS q, {_unprinted('text')} AS ut, {_unprinted('span')} AS uq FROM (SELECT doc_id, text, {_SPAN} AS span FROM documents)))""")
def span_verification(spark, d):
    """2.9.1-2.9.3, 2.9.5-2.9.7: a quoted span against its passage, in four tiers; spans are altered quotes."""
    docs = table(spark, d, "documents").withColumn("span", F.expr(_SPAN))
    return docs.select("doc_id", T.span_tier(F.col("text"), F.col("span")).alias("tier"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_TOKENS = f"list_distinct(list_filter(regexp_extract_all(lower({{}}), '[a-z0-9]+'), lambda t: length(t) >= 3 AND t NOT IN ({_STOP})))"


@query(f"""WITH p AS (SELECT doc_id, {_TOKENS.format('substr(text, 1, length(text) // 2)')} AS a, {_TOKENS.format('substr(text, length(text) // 2 + 1)')} AS b FROM documents),
u AS (SELECT *, len(list_distinct(list_concat(a, b))) AS n, list_intersect(a, b) AS shared FROM p)
SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE len(shared) / n END::DOUBLE AS similarity, array_to_string(list_sort(shared)[1:20], ' ') AS sample FROM u""")
def tracker_similarity(spark, d):
    """2.9.9, 2.9.10: token sets of a text's two halves, with a sorted sample of 20 shared ones."""
    p = table(spark, d, "documents").select("doc_id", T.tokens(F.expr("substr(text, 1, CAST(length(text) DIV 2 AS INT))")).alias("a"), T.tokens(F.expr("substr(text, CAST(length(text) DIV 2 AS INT) + 1)")).alias("b"))
    return p.select("doc_id", T.jaccard(F.col("a"), F.col("b")).alias("similarity"), F.array_join(F.slice(F.sort_array(F.array_intersect("a", "b")), 1, 20), " ").alias("sample"))


_REF = "CASE p_partkey % 7 WHEN 0 THEN 'Section ' || p_size WHEN 1 THEN '§ ' || p_size || '-1702(3)(a)' WHEN 2 THEN 'Article ' || p_brand WHEN 3 THEN p_type WHEN 4 THEN p_size || 'a.' || p_partkey % 9 WHEN 5 THEN 'at (3) ( b )' ELSE ' ' END"


@query(f"""SELECT p_partkey, ref, CASE WHEN trim(ref) = '' THEN 0.0 WHEN regexp_matches(ref, '{T.SUBDIVIDED}') OR regexp_matches(ref, '{T.NESTED}') THEN 1.0 WHEN contains(ref, '§') OR regexp_matches(ref, '{T.NUMBERED}') THEN 0.6
WHEN regexp_matches(ref, '{T.NAMED}') THEN 0.3 ELSE 0.2 END::DOUBLE AS specificity, TRY_CAST(nullif(regexp_replace(ref, '[^0-9]', '', 'g'), '') AS BIGINT) AS digits FROM (SELECT *, {_REF} AS ref FROM part)""")
def citations(spark, d):
    """2.9.47, 2.11.18: how specific a reference is, and its digits."""
    p = table(spark, d, "part").withColumn("ref", F.expr(_REF))
    return p.select("p_partkey", "ref", T.section_specificity(F.col("ref")).alias("specificity"), scores.digits(F.col("ref")).alias("digits"))


_CLAUSE = "CASE p_partkey % 7 WHEN 0 THEN 'a fine of $' || p_size || ',000.50 or 25,000 dollars' WHEN 1 THEN 'in ' || p_size || ' calendar days' WHEN 2 THEN 'after ' || p_size || '-hours' WHEN 3 THEN 'for ' || p_partkey % 4 || ' years and 7 months' WHEN 4 THEN p_size || ' DAYS, 24 hours' WHEN 5 THEN p_size * 100 || ' dollars' ELSE 'thirty days' END"
_ASKED = {"usd": "p_size * 1000 + 0.5", "days": "p_size", "hours": "24", "months": "24"}


def _grounding(unit: str, asked: str) -> str:
    lists = " || ".join(f"list_transform(regexp_extract_all(clause, '{p}', 1), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE) * {f})" for p, f in scores.UNITS[unit])
    return f"CASE WHEN len(list_filter({lists}, lambda x: x IS NOT NULL)) = 0 THEN 'unverifiable' WHEN len(list_filter({lists}, lambda x: abs(({asked})::DOUBLE - x) < 1e-6)) > 0 THEN 'grounded' ELSE 'mismatch' END AS {unit}"


@query(f"SELECT p_partkey, {', '.join(_grounding(u, a) for u, a in _ASKED.items())} FROM (SELECT *, {_CLAUSE} AS clause FROM part)")
def numeric_grounding(spark, d):
    """2.11.9, 2.11.10: whether a clause states the amount, days, hours or months that a fact claims."""
    p = table(spark, d, "part").withColumn("clause", F.expr(_CLAUSE))
    return p.select("p_partkey", *[scores.grounded(F.expr(a).cast("double"), F.col("clause"), u).alias(u) for u, a in _ASKED.items()])


_PARTS = "CASE WHEN l_returnflag <> 'N' THEN l_tax * 4 END AS similarity, floor(l_quantity / 10) / 5 * CASE WHEN l_quantity / 50 > 0.75::DOUBLE THEN 0.6::DOUBLE WHEN l_quantity / 50 > 0.5::DOUBLE THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS g, l_discount * 10 AS c, CASE WHEN l_returnflag <> 'A' OR l_linenumber = 1 THEN l_tax * 10 END AS x, l_linestatus = 'F' AS second"
_POINTS = "(CASE WHEN similarity >= 0.25::DOUBLE THEN 1.0 WHEN similarity >= 0.10::DOUBLE THEN 0.5::DOUBLE + (similarity - 0.10::DOUBLE) / 0.15::DOUBLE * 0.5::DOUBLE ELSE 0.3::DOUBLE END)"
_REST, _KNOWN = "0.35::DOUBLE * g + 0.15::DOUBLE * c", "0.5::DOUBLE * {0} + 0.35::DOUBLE * g + 0.15::DOUBLE * c".format(_POINTS)
_SCORE = f"""CASE WHEN similarity IS NULL THEN least(CASE WHEN x IS NULL THEN ({_REST}) / 0.5::DOUBLE ELSE ({_REST} + 0.1::DOUBLE * x) / 0.6::DOUBLE END, CASE WHEN second THEN 0.69::DOUBLE ELSE 0.49::DOUBLE END)
WHEN x IS NULL THEN {_KNOWN} ELSE 0.9::DOUBLE * ({_KNOWN}) + 0.1::DOUBLE * x END"""


@query(f"""WITH s AS (SELECT floor(({_SCORE}) * 10000 + 0.5) / 10000 AS score, floor(({re.sub(r'\bx\b', 'CAST(NULL AS DOUBLE)', _SCORE)}) * 10000 + 0.5) / 10000 AS before FROM (SELECT {_PARTS} FROM lineitem))
SELECT {tier_sql("score")} AS tier, count(*) AS n, min(score) AS lowest, max(score) AS highest, count(*) FILTER (WHERE {tier_sql("score")} <> {tier_sql("before")}) AS n_changed FROM s GROUP BY 1""")
def confidence_tiers(spark, d):
    """2.11.1, 2.11.2, 2.11.5, 2.11.7: facts scored from similarity, verified spans, citation and cross-validation, with the
    caps of facts that no tracker knows; and how many have another tier than before their cross-validation."""
    cross = F.when((F.col("l_returnflag") != "A") | (F.col("l_linenumber") == 1), F.col("l_tax") * 10)
    similarity = F.when(F.col("l_returnflag") != "N", F.col("l_tax") * 4)
    spans = scores.evidence(F.floor(F.col("l_quantity") / 10) / 5, F.col("l_quantity") / 50)
    score = lambda x: scores.rounded(scores.confidence(similarity, spans, F.col("l_discount") * 10, x, F.col("l_linestatus") == "F"))
    rows = table(spark, d, "lineitem").select(score(cross).alias("score"), score(F.lit(None).cast("double")).alias("before"))
    changed = F.count_if(tier_of(F.col("score")) != tier_of(F.col("before"))).alias("n_changed")
    return rows.groupBy(tier_of(F.col("score")).alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("lowest"), F.max("score").alias("highest"), changed)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, floor((g * 0.7::DOUBLE + c * 0.3::DOUBLE) * 10000 + 0.5) / 10000 AS source_grounding,
floor((CASE WHEN s IS NULL THEN t WHEN t > 0 THEN t * 0.6::DOUBLE + s * 0.4::DOUBLE ELSE s END) * 10000 + 0.5) / 10000 AS tracker_alignment, floor((v * 0.5::DOUBLE + m * 0.5::DOUBLE) * 10000 + 0.5) / 10000 AS schema_completeness
FROM (SELECT *, l_quantity / 50 AS g, l_discount * 10 AS c, l_tax * 10 AS t, CASE l_returnflag WHEN 'A' THEN 1.0::DOUBLE WHEN 'R' THEN 0.3::DOUBLE END AS s, CASE l_linestatus WHEN 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v, l_linenumber / 10 AS m FROM lineitem)""")
def score_dimensions(spark, d):
    """2.11.3: grounding, tracker alignment and completeness as separate scores."""
    second = F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "R", 0.3)
    valid = F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.0)
    parts = scores.dimensions(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10, valid, F.col("l_linenumber") / 10, second)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", parts.alias("p")).select("l_orderkey", "l_linenumber", "l_partkey", "p.*")


_RAW = "CASE version_id % 5 WHEN 0 THEN strftime(effective, '%Y-%m-%d') WHEN 1 THEN strftime(effective, '%m/%d/%Y') WHEN 2 THEN strftime(effective, '%d.%m.%Y') WHEN 3 THEN strftime(effective, '%Y%m%d') ELSE 'pending' END"


@query(with_domain(f"""r AS (SELECT version_id, {_RAW} AS raw, CASE WHEN version_id % 5 < 4 THEN CAST(effective AS DATE) END AS parsed FROM versions),
u AS (SELECT *, date_diff('day', DATE '1997-06-01', parsed) AS days FROM r)
SELECT version_id, raw, CAST(parsed AS VARCHAR) AS parsed, CASE WHEN days IS NULL THEN 'unknown' WHEN days <= 0 THEN 'now' WHEN days <= 180 THEN 'soon' ELSE 'future' END AS urgency,
regexp_full_match(raw, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AS is_iso, regexp_replace(raw, '[^0-9]', '', 'g') = coalesce(strftime(parsed, '%Y%m%d'), '') AS same_digits FROM u"""))
def deadlines(spark, d):
    """2.10.2-2.10.6: dates in four notations, the band of urgency, loose equality on digits."""
    shapes = [F.date_format("effective", f) for f in ("yyyy-MM-dd", "MM/dd/yyyy", "dd.MM.yyyy", "yyyyMMdd")]
    raw = F.lit("pending")
    for k, c in reversed(list(enumerate(shapes))):
        raw = F.when(F.col("version_id") % 5 == k, c).otherwise(raw)
    rows = versions(spark, d).select("version_id", raw.alias("raw")).withColumn("parsed", scores.date_of(F.col("raw")))
    same = F.regexp_replace("raw", "[^0-9]", "") == F.coalesce(F.date_format("parsed", "yyyyMMdd"), F.lit(""))
    return rows.select("version_id", "raw", F.col("parsed").cast("string").alias("parsed"), scores.urgency(F.col("parsed"), F.lit("1997-06-01").cast("date")).alias("urgency"), F.col("raw").rlike(r"^\d{4}-\d{2}-\d{2}$").alias("is_iso"), same.alias("same_digits"))


@query("""WITH h AS (SELECT event_id, value, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) / 3.6e9 AS hours FROM events)
SELECT event_id, CASE WHEN hours < 1 THEN 'just now' WHEN hours < 24 THEN CAST(floor(hours) AS BIGINT) || 'h ago' WHEN hours < 720 THEN CAST(floor(hours / 24) AS BIGINT) || 'd ago' ELSE CAST(floor(hours / 720) AS BIGINT) || 'mo ago' END AS age,
greatest(2048, CAST(floor(8192 * CASE WHEN value * 100 < 2000 THEN 0.5 WHEN value * 100 < 8000 THEN 0.75 ELSE 1.0 END) AS INT)) AS budget FROM h""")
def event_ages(spark, d):
    """2.10.7, 2.10.8, 2.11.22: how long ago, in words; a token budget scaled by length."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = e.agg(F.max("ts").alias("last"))  # one row
    hours = (F.unix_micros("last") - F.unix_micros("ts")) / 3.6e9
    return e.join(F.broadcast(last)).select("event_id", scores.age_label(hours).alias("age"), scores.token_budget(F.lit(8192), F.col("value") * 100).alias("budget"))


@query(with_domain("SELECT version_id, line, fact_type, floor(((CASE WHEN approved THEN score * 0.6::DOUBLE ELSE 0.0 END + quantity / 50 * 0.4::DOUBLE) / (CASE WHEN approved THEN 0.6::DOUBLE + 0.4::DOUBLE ELSE 0.4::DOUBLE END)) * 1000 + 0.5) / 1000 AS blended FROM facts"))
def blended_scores(spark, d):
    """2.11.6: a mean whose missing parts leave their weight to the others."""
    f = facts(spark, d)
    blended = scores.weighted_mean([(0.6, F.when(F.col("approved"), F.col("score"))), (0.4, F.col("quantity") / 50)])
    return f.select("version_id", "line", "fact_type", scores.rounded(blended, 3).alias("blended"))
