"""Facts that notes state in words, over whole tables (inventory 2.11.11, 2.11.12, 2.11.14-2.11.17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stated as S
from ..registry import query
from ..sources.tables import dealt, table

_NOTE = """CASE p_partkey % 8 WHEN 0 THEN 'The Attorney General may seek $' || p_size || ',000 per violation; a 60-day cure applies. No private right of action.'
WHEN 1 THEN 'Fines up to $' || p_size || ' million per day and $500; Class A felony' WHEN 2 THEN 'FTC rules, cure period of ' || p_size || ' days, private right of action' WHEN 3 THEN ''
WHEN 4 THEN 'No criminal penalties; $' || p_size || '.5k per occurrence by the Commissioner' WHEN 5 THEN 'Department of  Labor, $2 billion, 30 day notice, imprisonment' WHEN 6 THEN p_name ELSE 'enforced by the state attorney general' END"""


def _amounts(low: str) -> str:
    n, u = f"regexp_extract_all({low}, '{S.MONEY}', 1)", f"regexp_extract_all({low}, '{S.MONEY}', 2)"
    scale = f"CASE WHEN starts_with({u}[i], 'm') THEN 1e6 WHEN starts_with({u}[i], 'b') THEN 1e9 WHEN starts_with({u}[i], 't') OR {u}[i] = 'k' THEN 1e3 ELSE 1.0 END"
    return f"CAST(list_max(list_transform(range(1, len({n}) + 1), lambda i: floor(TRY_CAST(replace({n}[i], ',', '') AS DOUBLE) * {scale}))) AS BIGINT)"


@query(f"""WITH n AS (SELECT p_partkey, {_NOTE} AS note FROM part), l AS (SELECT *, lower(note) AS low FROM n),
f AS (SELECT p_partkey, {_amounts('low')} AS max_penalty, {S.shown_sql('low', S.PENALTY_PER)} AS penalty_per, {S.days_sql('low', *S.CURE)} AS cure_days, {S.shown_sql('low', S.BODIES)} AS body, {S.shown_sql('low', S.PRIVATE_RIGHT)} AS private_right, {S.shown_sql('low', S.CRIMINAL_PENALTY)} AS criminal, nullif(note[1:300], '') AS excerpt FROM l)
SELECT *, max_penalty IS NOT NULL OR body IS NOT NULL OR private_right IS NOT NULL AS covered FROM f""")
def enforcement_facts(spark, d):
    """2.11.14, 2.11.17: penalty, period, cure, enforcer and rights that a note states, and whether that suffices."""
    rows = dealt(table(spark, d, "part")).select("p_partkey", F.expr(_NOTE).alias("note"))
    return rows.select("p_partkey", S.enforcement_facts(F.col("note")).alias("f")).select("p_partkey", "f.*")


_NEEDS = """CASE p_partkey % 7 WHEN 0 THEN 'Developers and deployers with ' || p_size || ' or more full-time employees or 1,000 employees' WHEN 1 THEN 'Operators with annual revenue above $' || p_size || ' million; housing and lending'
WHEN 2 THEN 'Providers processing data of ' || p_size || ',000 consumers or 5 residents in healthcare' WHEN 3 THEN 'Applies only to government: state agencies, policing' WHEN 4 THEN 'Commercial services with $' || p_size || 'k in gross receipts, universities' WHEN 5 THEN '' ELSE p_name END"""
_REVENUE = f"""CASE WHEN a > 0 AND (b = 0 OR a <= b) THEN TRY_CAST(replace(regexp_extract(low, '{S.REVENUE_AFTER}', 1), ',', '') AS DOUBLE) * CASE regexp_extract(low, '{S.REVENUE_AFTER}', 2)[1:1] WHEN 'm' THEN 1e6 WHEN 'b' THEN 1e9 WHEN 't' THEN 1e3 WHEN 'k' THEN 1e3 ELSE 1 END
WHEN b > 0 THEN TRY_CAST(replace(regexp_extract(low, '{S.REVENUE_BEFORE}', 1), ',', '') AS DOUBLE) * CASE regexp_extract(low, '{S.REVENUE_BEFORE}', 2)[1:1] WHEN 'm' THEN 1e6 WHEN 'b' THEN 1e9 WHEN 't' THEN 1e3 WHEN 'k' THEN 1e3 ELSE 1 END END"""
_LEAST = lambda p: f"list_min(list_filter(list_transform(regexp_extract_all(low, '{p}', 1), lambda x: TRY_CAST(replace(x, ',', '') AS BIGINT)), lambda x: x > 0))"
_PLACE = lambda p: f"CASE WHEN regexp_matches(low, '{p}') THEN strpos(low, regexp_extract(low, '{p}', 0)) ELSE 0 END"


@query(f"""WITH l AS (SELECT p_partkey, lower({_NEEDS}) AS low FROM part), p AS (SELECT *, {_PLACE(S.REVENUE_AFTER)} AS a, {_PLACE(S.REVENUE_BEFORE)} AS b FROM l),
f AS (SELECT p_partkey, {S.all_shown_sql('low', S.ENTITIES)} AS kinds, {S.all_shown_sql('low', S.SECTORS)} AS sectors, {_LEAST(S.EMPLOYEES)} AS employees, CAST(floor({_REVENUE}) AS BIGINT) AS revenue, {_LEAST(S.CONSUMERS)} AS consumers, {S.shown_sql('low', S.GOVERNMENT_ONLY)} AS government_only FROM p)
SELECT *, kinds <> '' OR employees IS NOT NULL OR revenue IS NOT NULL OR consumers IS NOT NULL AS covered FROM f""")
def applicability_facts(spark, d):
    """2.11.15, 2.11.17: kinds and sectors covered, the least thresholds, and whether that suffices."""
    rows = dealt(table(spark, d, "part")).select("p_partkey", S.applicability_facts(F.expr(_NEEDS)).alias("f")).select("p_partkey", "f.*")
    return rows.withColumn("kinds", F.array_join("kinds", ",")).withColumn("sectors", F.array_join("sectors", ","))


_DATES = """CASE p_partkey % 6 WHEN 0 THEN 'Effective upon enactment; annual review' WHEN 1 THEN 'Takes effect on July ' || (p_size % 28 + 1) || ', 2026; 45 calendar days to respond' WHEN 2 THEN 'effective date: 2027-01-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR(2)), 2, '0')
WHEN 3 THEN 'Enforcement begins January 2028. Effective soon enough' WHEN 4 THEN 'Compliance deadline: 3/' || (p_size % 28 + 1) || '/27' ELSE p_name END"""
_BOTH = f"lower({_DATES} || ' ' || {_NOTE})"


@query(f"""WITH l AS (SELECT p_partkey, {_BOTH} AS low FROM part), f AS (SELECT p_partkey, CASE WHEN regexp_matches(low, '{S.UPON_ENACTMENT}') THEN 'upon_enactment' ELSE {S.day_sql('low', S.EFFECTIVE)} END AS effective, {S.day_sql('low', S.ENFORCED_FROM)} AS enforced_from,
{S.days_sql('low', S.RESPONSE_DAYS)} AS response_days, {S.days_sql('low', *S.CURE)} AS cure_days, CASE WHEN regexp_matches(low, '{S.YEARLY}') THEN 12 END AS assessment_months FROM l) SELECT *, effective IS NOT NULL AS covered FROM f""")
def timeline_facts(spark, d):
    """2.11.16, 2.11.17: effective and enforcement dates, periods to respond and to cure, from two notes."""
    rows = dealt(table(spark, d, "part")).select("p_partkey", S.timeline_facts(F.expr(_DATES), F.expr(_NOTE)).alias("f"))
    return rows.select("p_partkey", "f.*")


_KIND = "CASE p_partkey % 5 WHEN 0 THEN 'size' WHEN 1 THEN 'annual revenue' WHEN 2 THEN NULL WHEN 3 THEN ' ' ELSE 'Consumers' END"
_UNIT = "CASE p_partkey % 3 WHEN 0 THEN 'employees' WHEN 1 THEN 'USD' END"
_WHEN = "CASE p_partkey % 9 WHEN 0 THEN 'more than ' || p_size WHEN 1 THEN 'no fewer than 5, or more' WHEN 2 THEN 'up to a maximum of 9' WHEN 3 THEN 'Exceeding' WHEN 4 THEN 'in any sector' WHEN 5 THEN 'fewer than ' || p_size || ' records' ELSE NULL END"
_VALUE = "CASE p_partkey % 7 WHEN 0 THEN '$' || p_size || ' million' WHEN 1 THEN '25,000,' || lpad(CAST(p_size AS VARCHAR(3)), 3, '0') WHEN 2 THEN '10^' || p_size % 9 WHEN 3 THEN '1.5e3' WHEN 4 THEN NULL WHEN 5 THEN 'many' ELSE '-' || p_size || ' %' END"
_FLOPS = "CASE WHEN p_partkey % 11 = 0 THEN CAST(p_size AS DOUBLE) END"
_SECTOR = "CASE WHEN p_partkey % 13 = 0 THEN 'health' END"
_FACTOR = "CASE " + " ".join(f"WHEN contains(low, '{w}') THEN {f:.0f}::DOUBLE" for w, f in S.FACTORS.items()) + " ELSE 1.0::DOUBLE END"
_BARE = "CASE " + " ".join(f"WHEN contains(low, '{w}') THEN replace(low, '{w}', ' ')" for w in S.FACTORS) + " ELSE low END"
_CONTAINS = lambda c, cases, other: f"CASE {' '.join(f'''WHEN contains({c}, '{w}') THEN '{v}' ''' for w, v in cases.items())} ELSE {other} END"


@query(f"""WITH r AS (SELECT p_partkey, {_KIND} AS kind, {_UNIT} AS unit, {_WHEN} AS condition, {_VALUE} AS value, {_FLOPS} AS flops, {_SECTOR} AS sectors FROM part), l AS (SELECT *, lower(trim(value)) AS low, lower(coalesce(kind, '') || ' ' || coalesce(unit, '') || ' ' || coalesce(condition, '')) AS words FROM r),
b AS (SELECT *, {_BARE} AS bare, {_FACTOR} AS factor FROM l), v AS (SELECT *, coalesce(CASE WHEN regexp_matches(bare, '{S.CARET}') THEN pow(TRY_CAST(regexp_extract(bare, '{S.CARET}', 1) AS DOUBLE), TRY_CAST(regexp_extract(bare, '{S.CARET}', 2) AS DOUBLE)) ELSE TRY_CAST(regexp_extract(regexp_replace(bare, '[$,%]', '', 'g'), '{S.NUMBER}', 0) AS DOUBLE) * factor END, flops) AS amount FROM b)
SELECT p_partkey, CASE WHEN flops IS NOT NULL THEN 'compute' WHEN sectors IS NOT NULL THEN 'sector' ELSE {_CONTAINS('words', S.TRIGGERS, "nullif(trim(kind), '')")} END AS type, {_CONTAINS("lower(coalesce(condition, ''))", S.OPERATORS, "CASE WHEN amount IS NOT NULL OR coalesce(trim(value), '') <> '' THEN 'gte' ELSE 'any' END")} AS operator, amount AS value
FROM v WHERE amount IS NOT NULL OR coalesce(trim(value), '') <> '' OR flops IS NOT NULL OR sectors IS NOT NULL OR {_CONTAINS('words', S.TRIGGERS, "nullif(trim(kind), '')")} IS NOT NULL""")
def triggers(spark, d):
    """2.11.11, 2.11.12: thresholds as type, operator and number; what states nothing gives no trigger."""
    columns = [F.expr(e).alias(n) for n, e in (("kind", _KIND), ("unit", _UNIT), ("condition", _WHEN), ("value", _VALUE), ("flops", _FLOPS), ("sectors", _SECTOR))]
    rows = dealt(table(spark, d, "part")).select("p_partkey", *columns)
    found = rows.select("p_partkey", S.trigger(*map(F.col, ("kind", "unit", "condition", "value", "flops", "sectors"))).alias("t"))
    return found.filter("t IS NOT NULL").select("p_partkey", "t.*")
