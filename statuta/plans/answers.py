"""Answers of models: repaired JSON, their kinds, and payloads in the serving form (inventory 2.9.12, 2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import payloads as P
from ..operators import answers as A
from ..registry import query
from ..sources.tables import table

_TWO = """'{"extractions": [{"a": "' || p_brand || '", "n": ' || p_size || '}, {"a": "' || p_type || '", "n": 2}'"""
#: Answers damaged in the ways that models do.
_ANSWER = f"""CASE p_partkey % 10 WHEN 0 THEN {_TWO} || ']}}' WHEN 1 THEN {_TWO} || ']}}{{"extra": 1}}' WHEN 2 THEN {_TWO} || ',]}}' WHEN 3 THEN '[{{"a": "' || p_brand || '", "n": ' || p_size || '}}, {{"a": "' || p_type || '", "n'
WHEN 4 THEN '{{"extractions": [{{"a": "' || p_brand || '", "n": ' || p_size || '}}, "{{\\\\"a\\\\": \\\\"' || p_type || '\\\\", \\\\"n\\\\": 2}}"]}}' WHEN 5 THEN replace({_TWO} || ']}}', '"a"', '" a "') WHEN 6 THEN replace({_TWO} || ']}}', p_brand, p_brand || chr(10) || '\\\\d' || chr(7))
WHEN 7 THEN '{{"extractions": [{{"a": "' || p_brand || ' cut o' WHEN 8 THEN 'no JSON: ' || p_name ELSE {_TWO} || ', {{"a": "' || repeat('and so on and so on until the very end of ' || p_partkey || '; ', 9) END"""
_FIRST = "CASE p_partkey % 10 WHEN 3 THEN '$[0]' ELSE '$.extractions[0]' END"


@query("""SELECT p_partkey, CASE p_partkey % 10 WHEN 6 THEN p_brand || chr(10) || '\\d' WHEN 7 THEN p_brand || ' cut o' WHEN 8 THEN NULL ELSE p_brand END AS first, CASE WHEN p_partkey % 10 IN (7, 8) THEN NULL ELSE p_size END AS n,
CASE p_partkey % 10 WHEN 1 THEN 'first_object_extraction' WHEN 2 THEN 'trailing_comma_strip' WHEN 3 THEN 'truncation_salvage' WHEN 4 THEN 'unescaped_strings' WHEN 5 THEN 'stripped_keys' WHEN 6 THEN 'control_char_strip,string_escape_repair' WHEN 7 THEN 'truncation_salvage' WHEN 9 THEN 'truncation_salvage' ELSE '' END AS repairs,
CASE p_partkey % 10 WHEN 3 THEN 2 WHEN 7 THEN 1 WHEN 9 THEN 3 END AS n_started, p_partkey % 10 = 9 AS looped FROM part""")
def answers_mended(spark, d):
    """2.9.12, 2.12.1-2.12.3: answers with loops cut and JSON repaired; the twin states what each damage should leave."""
    rows = table(spark, d, "part").select("p_partkey", F.expr(_ANSWER).alias("said"))
    found = A.mended(rows, "p_partkey", "said")
    field = lambda name: F.coalesce(F.get_json_object("answer", f"$.extractions[0].{name}"), F.get_json_object("answer", f"$[0].{name}"))
    return found.select("p_partkey", field("a").alias("first"), field("n").cast("int").alias("n"), F.array_join("repairs", ",").alias("repairs"), "n_started", "looped")


_J = lambda path: f"json_extract_string(p, '$.{path}')"
_SET = lambda path: f"coalesce({_J(path)}, '') <> ''"
_DUTY = """'{"subject": "' || CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'The Attorney General' WHEN 2 THEN ' ' ELSE p_brand END || '", "action": "' || CASE p_partkey % 4 WHEN 0 THEN 'impose a fine' WHEN 1 THEN p_type ELSE '' END || '"'
|| CASE p_partkey % 3 WHEN 0 THEN ', "enforcement": {"enforcing_body": "AG", "penalty_type": "civil", "private_right_of_action": true, "enforcement_text": "' || p_name || '"}' WHEN 1 THEN ', "enforcement": {"private_right_of_action": false}' ELSE '' END
|| CASE p_partkey % 7 WHEN 0 THEN ', "timeline": {"effective_date": "2026-01-0' || p_partkey % 9 || '", "sunset_date": "someday", "timeline_text": "' || p_name || '", "date_parse_status": {"effective_date": "parsed", "sunset_date": "unparsed"}}' WHEN 1 THEN ', "timeline": {"phase_in_period": "a year"}' ELSE '' END || '}'"""
_OWN = """'{"term": "' || CASE p_partkey % 3 WHEN 0 THEN p_brand ELSE '' END || '", "definition_text": "' || p_type || '"' || CASE p_partkey % 4 WHEN 0 THEN ', "actors": [{"actor_name": "' || p_brand || '", "actor_type": "provider"}, {"actor_name": "x"}]' WHEN 1 THEN ', "framework_refs": [{"framework_name": "F", "section_or_standard": "' || p_size || '"}]' ELSE ', "cross_references": ["a", "' || p_size || '"]' END || '}'"""
_LIMIT = """'{"threshold_type": ' || CASE p_partkey % 3 WHEN 0 THEN '"size"' ELSE 'null' END || ', "threshold_sub_type": "' || CASE p_partkey % 5 WHEN 0 THEN 'exemption' WHEN 1 THEN 'scope' ELSE '' END || '", "exceptions": ' || CASE p_partkey % 2 WHEN 0 THEN '[{"exception_type": "small", "description": "' || p_brand || '"}, {"description": "other"}]' ELSE '[]' END || '}'"""
_COURT = " OR ".join(f"contains(lower({_J('subject')}), '{w}')" for w in P.ENFORCERS)
_FINE = " OR ".join(f"contains(lower({_J('action')}), '{w}')" for w in P.PENALTY_VERBS)
_CORE = f"trim({_J('subject')}) <> '' AND trim({_J('action')}) <> ''"
_ENFORCED = " OR ".join(map(_SET, ("enforcement.enforcing_body", "enforcement.penalty_type", "enforcement.penalty_description")))
_DATED = " OR ".join(map(_SET, ("timeline.effective_date", "timeline.compliance_deadline", "timeline.sunset_date", "timeline.phase_in_period")))
_JOIN = lambda parts: f"nullif(concat_ws('; ', {', '.join(parts)}), '')"
_LED = lambda words, path: f"CASE WHEN {_SET(path)} THEN '{words}' || {_J(path)} END"
_PAIRS = lambda path, a, b, shape: f"(SELECT nullif(string_agg({shape.format(a=f'''json_extract_string(x, '$.{a}')''', b=f'''json_extract_string(x, '$.{b}')''')}, '; ' ORDER BY i), '') FROM (SELECT unnest(CAST(json_extract(p, '$.{path}') AS JSON[])) AS x, generate_subscripts(CAST(json_extract(p, '$.{path}') AS JSON[]), 1) AS i))"


@query(f"""WITH a AS (SELECT p_partkey, {_DUTY} AS p FROM part), b AS (SELECT p_partkey, {_OWN} AS p FROM part), c AS (SELECT p_partkey, {_LIMIT} AS p FROM part)
SELECT p_partkey, 'obligation' AS agent, CASE WHEN {_CORE} AND ({_ENFORCED}) AND ({_COURT}) AND ({_FINE}) THEN 'enforcement' WHEN NOT ({_CORE}) AND ({_ENFORCED}) THEN 'enforcement' WHEN NOT ({_CORE}) AND ({_DATED}) THEN 'timeline' ELSE 'obligation' END AS type FROM a
UNION ALL SELECT p_partkey, 'definition_actor', CASE WHEN trim({_J('term')}) <> '' AND trim({_J('definition_text')}) <> '' THEN 'definition' WHEN json_array_length(p, '$.actors') > 0 THEN 'actor_mapping' WHEN json_array_length(p, '$.framework_refs') > 0 THEN 'framework_ref' ELSE 'definition' END FROM b
UNION ALL SELECT p_partkey, 'threshold_exception', CASE WHEN {_J('threshold_sub_type')} = 'exemption' THEN 'exception' WHEN {_J('threshold_sub_type')} = 'scope' THEN 'threshold' WHEN NOT {_SET('threshold_type')} AND json_array_length(p, '$.exceptions') > 0 THEN 'exception' ELSE 'threshold' END FROM c""")
def payload_types(spark, d):
    """2.12.6: the kind of fact that a payload holds, by what is filled in it."""
    part = table(spark, d, "part")
    kinds = (("obligation", _DUTY, P.OBLIGATION, P.obligation_type), ("definition_actor", _OWN, P.DEFINITION, P.definition_type), ("threshold_exception", _LIMIT, P.THRESHOLD, P.threshold_type))
    found = [part.select("p_partkey", F.lit(agent).alias("agent"), of(F.from_json(F.expr(text), schema)).alias("type")) for agent, text, schema, of in kinds]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(f"""WITH a AS (SELECT p_partkey, {_DUTY} AS p FROM part), b AS (SELECT p_partkey, {_OWN} AS p FROM part), c AS (SELECT p_partkey, {_LIMIT} AS p FROM part),
x AS (SELECT p_partkey, {_JOIN([_LED('Effective: ', 'timeline.effective_date'), _LED('Deadline: ', 'timeline.compliance_deadline'), _LED('Sunset: ', 'timeline.sunset_date'), _LED('Phase-in: ', 'timeline.phase_in_period'), _LED('', 'timeline.timeline_text')])} AS timeline,
CASE WHEN {_J('timeline.date_parse_status.effective_date')} = 'parsed' THEN 'effective:' || {_J('timeline.effective_date')} ELSE '' END AS deadlines,
{_JOIN([_LED('Enforced by: ', 'enforcement.enforcing_body'), _LED('Penalty: ', 'enforcement.penalty_type'), _LED('', 'enforcement.penalty_description'), "CASE WHEN " + _J('enforcement.private_right_of_action') + " = 'true' THEN 'Private right of action: Yes' END", _LED('', 'enforcement.enforcement_text')])} AS enforcement FROM a),
y AS (SELECT p_partkey, {_PAIRS('actors', 'actor_name', 'actor_type', "{a} || CASE WHEN coalesce({b}, '') <> '' THEN ' (' || {b} || ')' ELSE '' END")} AS actors, {_PAIRS('framework_refs', 'framework_name', 'section_or_standard', "{a} || CASE WHEN coalesce({b}, '') <> '' THEN ' (' || {b} || ')' ELSE '' END")} AS frameworks,
nullif(array_to_string(CAST(json_extract(p, '$.cross_references') AS VARCHAR[]), '; '), '') AS cross_references FROM b),
z AS (SELECT p_partkey, {_PAIRS('exceptions', 'exception_type', 'description', "CASE WHEN coalesce({a}, '') <> '' THEN {a} || ': ' ELSE '' END || {b}")} AS exceptions FROM c) SELECT * FROM x JOIN y USING (p_partkey) JOIN z USING (p_partkey)""")
def adapted_payloads(spark, d):
    """2.12.8, 2.12.9, 2.10.5: nested payloads in the flat form of the serving side, by type."""
    p = table(spark, d, "part")
    read = p.select("p_partkey", F.from_json(F.expr(_DUTY), P.OBLIGATION).alias("o"), F.from_json(F.expr(_OWN), P.DEFINITION).alias("n"), F.from_json(F.expr(_LIMIT), P.THRESHOLD).alias("t"))
    rows = read.select("p_partkey", P.adapted("obligation", F.col("o")).alias("o"), P.adapted("definition", F.col("n")).alias("n"), P.adapted("threshold", F.col("t")).alias("t"))
    deadlines = F.array_join(F.transform("o.deadlines", lambda x: F.concat_ws(":", x["deadline_type"], x["deadline_date"])), ",")
    return rows.select("p_partkey", "o.timeline", deadlines.alias("deadlines"), "o.enforcement", "n.actors", F.col("n.framework_refs").alias("frameworks"), "n.cross_references", "t.exceptions")
