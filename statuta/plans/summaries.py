"""Facts and laws in short (inventory 2.4.19, 2.9.61)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import stated as T, summaries as S
from ..registry import query
from ..sources.tables import table

# Thresholds of a brand's laws: what they count, how much, whom they spare, and whether anyone may sue.
_KIND = "CASE p_partkey % 4 WHEN 0 THEN 'size' WHEN 1 THEN 'annual revenue' WHEN 2 THEN 'consumers' END"
_UNIT = "CASE p_partkey % 4 WHEN 0 THEN 'employees' WHEN 1 THEN 'USD' WHEN 2 THEN 'consumers' END"
_VALUE = "CASE WHEN p_size % 5 = 0 THEN 'many' ELSE CAST(CAST(floor(p_retailprice) AS INT) AS {}) END"
_SPARED = "CASE p_size % 40 WHEN 0 THEN 'A ' || p_name || ' of a Small Business' WHEN 1 THEN p_name END"
_SUED = "CASE WHEN p_size % 48 = 3 THEN TRUE WHEN p_size % 9 = 4 THEN FALSE END"


def covered(facts: DataFrame, law: str) -> DataFrame:
    """A law's floors and its two questions. `facts`: kind, unit, condition, value, flops, exceptions, private_action. A floor is the least
    number of its kind; words in place of a number set none. What no fact says is null, not false."""
    t = T.trigger(F.col("kind"), F.col("unit"), F.col("condition"), F.col("value"), F.col("flops"), F.lit(None).cast("string"))
    rows = facts.select(F.col(law).alias(law), t.alias("t"), S.small_business(F.col("exceptions")).alias("small"), "private_action")
    least = lambda kind: F.min(F.when(F.col("t.type") == kind, F.col("t.value")))
    return rows.groupBy(law).agg(
        least("employee_count").cast("int").alias("min_employees"), least("revenue").alias("min_revenue"), least("consumer_count").cast("int").alias("consumer_count"),
        F.bool_or("small").alias("small_business_exempt"), F.bool_or("private_action").alias("private_right_of_action"),
    )


@query(f"""WITH r AS (SELECT p_brand AS law, {_UNIT} AS unit, CAST({_VALUE.format('VARCHAR')} AS VARCHAR) AS said, {_SPARED} AS spared, {_SUED} AS sued FROM part)
SELECT law, CAST(min(TRY_CAST(said AS DOUBLE)) FILTER (WHERE unit = 'employees') AS INT) AS min_employees, min(TRY_CAST(said AS DOUBLE)) FILTER (WHERE unit = 'USD') AS min_revenue, CAST(min(TRY_CAST(said AS DOUBLE)) FILTER (WHERE unit = 'consumers') AS INT) AS consumer_count,
CASE WHEN bool_or(coalesce(contains(lower(spared), 'small business'), FALSE)) THEN TRUE END AS small_business_exempt, bool_or(sued) AS private_right_of_action FROM r GROUP BY 1""")
def law_summaries(spark, d):
    """2.4.19: floors and three-valued answers of each law, in one aggregate."""
    p = table(spark, d, "part")
    facts = p.select(F.col("p_brand").alias("law"), F.expr(_KIND).alias("kind"), F.expr(_UNIT).alias("unit"), F.lit(None).cast("string").alias("condition"), F.expr(_VALUE.format("STRING")).alias("value"), F.lit(None).cast("double").alias("flops"), F.array(F.expr(_SPARED)).alias("exceptions"), F.expr(_SUED).alias("private_action"))
    return covered(facts, "law")


_FACT = "CASE p_partkey % 3 WHEN 0 THEN 'obligation' WHEN 1 THEN 'definition' ELSE 'enforcement' END"
_PAYLOAD = """'{"subject": "' || p_name || '", "action": "' || p_type || '", "section_reference": "' || p_size || '", "term": "' || p_name || '", "definition_text": "' || p_brand || '", "scope": "' || CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END || '", "enforcement": {"enforcing_body": "' || p_brand || '", "max_civil_penalty_usd": ' || p_size * 1000 || '}}'"""
_TITLE = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


@query(f"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN {_TITLE} || ' must ' || p_type || ' Enforced by ' || p_brand || CASE WHEN p_size > 0 THEN '. up to $' || format('{{:,}}', p_size * 1000) || ' penalty' ELSE '' END || '. [§ ' || p_size || '] (' || p_brand || ')'
WHEN 1 THEN '"' || p_name || '" means ' || p_brand || CASE WHEN p_size % 2 = 0 THEN ' Scope: ' || p_type || '.' ELSE '' END ELSE 'Enforced by ' || p_brand || '.' || CASE WHEN p_size > 0 THEN ' Max penalty: $' || format('{{:,}}', p_size * 1000) || '.' ELSE '' END END AS summary FROM part""")
def fact_summaries(spark, d):
    """2.9.61: facts in words by the template of their type; tests hold all templates against sentences worked out by hand."""
    return table(spark, d, "part").select("p_partkey", S.summary(F.expr(_FACT), F.expr(_PAYLOAD), F.col("p_brand")).alias("summary"))
