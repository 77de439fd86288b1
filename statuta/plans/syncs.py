"""Edits, syncs, guards and alerts over whole tables (inventory 2.1.29, 2.8.11-2.8.15, 2.9.11, 2.9.57, 2.11.18, 2.11.20, 2.13.3, 2.13.4,
2.13.8, 2.13.12, 2.13.13, 2.13.16, 2.14.2, 2.14.6, 2.14.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks as K, conflicts as X
from ..functions.rules import normal_date_sql
from ..functions.text import STOP_WORDS
from ..registry import query
from ..sources import sinks
from ..sources.tables import facts, laws, table, versions, with_domain

_WIDGET = "CASE p_partkey % 8 WHEN 0 THEN 'number' WHEN 1 THEN 'date' WHEN 2 THEN 'boolean' WHEN 3 THEN 'select' WHEN 4 THEN 'readonly' WHEN 5 THEN 'nested' WHEN 6 THEN 'text' ELSE 'number' END"
_VALUE = "CASE p_partkey % 8 WHEN 0 THEN CASE p_size % 3 WHEN 0 THEN p_size || '.0' WHEN 1 THEN p_size || '.5' ELSE 'many' END WHEN 1 THEN CASE p_size % 3 WHEN 0 THEN 'July ' || (p_size % 28 + 1) || ', 2026' WHEN 1 THEN '' ELSE 'soon' END WHEN 2 THEN CASE p_size % 4 WHEN 0 THEN ' YES ' WHEN 1 THEN '0' WHEN 2 THEN NULL ELSE 'perhaps' END WHEN 3 THEN CASE p_size % 2 WHEN 0 THEN 'civil' ELSE p_type END WHEN 7 THEN NULL ELSE p_name END"


@query(f"""WITH e AS (SELECT p_partkey, {_WIDGET} AS w, {_VALUE} AS v FROM part), n AS (SELECT *, coalesce(v, '') = '' AS empty, TRY_CAST(v AS DOUBLE) AS number, {normal_date_sql('trim(v)')} AS day, lower(trim(v)) AS low FROM e)
SELECT p_partkey, CASE WHEN w IN ('readonly', 'nested') THEN FALSE WHEN w IN ('number', 'date', 'boolean') AND empty THEN TRUE WHEN w = 'number' THEN number IS NOT NULL WHEN w = 'date' THEN day IS NOT NULL WHEN w = 'boolean' THEN low IN ('true', 'yes', '1', 'false', 'no', '0') ELSE TRUE END AS valid,
CASE WHEN w IN ('number', 'date', 'boolean') AND empty THEN NULL WHEN w = 'number' AND number IS NOT NULL THEN CASE WHEN number = floor(number) THEN CAST(CAST(number AS BIGINT) AS VARCHAR) ELSE CAST(number AS VARCHAR) END WHEN w = 'date' AND day IS NOT NULL THEN day WHEN w = 'boolean' AND low IN ('true', 'yes', '1') THEN 'true' WHEN w = 'boolean' AND low IN ('false', 'no', '0') THEN 'false' ELSE v END AS value,
CASE WHEN w = 'readonly' THEN 'system field' WHEN w = 'nested' THEN 'group of fields' WHEN empty THEN NULL WHEN w = 'number' AND number IS NULL THEN 'no number' WHEN w = 'date' AND day IS NULL THEN 'no date' WHEN w = 'boolean' AND low NOT IN ('true', 'yes', '1', 'false', 'no', '0') THEN 'neither yes nor no' WHEN w = 'select' AND v NOT IN ('civil', 'criminal') THEN 'not a standard value' END AS note FROM n""")
def edits_checked(spark, d):
    """2.8.12, 2.11.18: values of edits by the kind of their field, put into one form or refused with a reason."""
    rows = table(spark, d, "part").select("p_partkey", F.expr(_WIDGET).alias("w"), F.expr(_VALUE).alias("v"))
    choices = F.array(F.lit("civil"), F.lit("criminal"))
    return rows.select("p_partkey", K.edited_value(F.col("w"), F.col("v"), choices).alias("e")).select("p_partkey", "e.*")


_ACT = "CASE event_type WHEN 'view' THEN 'propose' WHEN 'click' THEN 'apply' WHEN 'purchase' THEN 'apply' WHEN 'error' THEN 'revert' ELSE 'propose' END"


@query(with_domain(f"""e AS (SELECT event_id, ts, user_id AS record, CASE WHEN value < 40 THEN 'days' ELSE 'amount' END AS path, value, {_ACT} AS act, balance, CASE WHEN event_id % 3 > 0 THEN CASE WHEN event_id % 3 = 1 THEN CAST(CAST(json_extract_string(props, '$.k') AS INT) % 25 AS VARCHAR) ELSE CAST(jurisdiction_id AS VARCHAR) END END AS token, CAST(jurisdiction_id AS VARCHAR) AS current FROM events JOIN laws ON user_id = law_id),
s AS (SELECT *, CASE WHEN act = 'propose' AND lead(event_id) OVER (PARTITION BY record, path, act ORDER BY ts, event_id) IS NOT NULL THEN 'superseded' WHEN act = 'propose' THEN 'pending' WHEN act = 'revert' THEN 'reverted' WHEN token <> current THEN 'stale' ELSE 'applied' END AS status FROM e),
o AS (SELECT record, path, arg_max(value, (ts, event_id)) AS value FROM s WHERE status = 'applied' GROUP BY 1, 2), c AS (SELECT record, status, count(*) AS n FROM s GROUP BY 1, 2)
SELECT record, max(n) FILTER (WHERE status = 'pending') AS pending, max(n) FILTER (WHERE status = 'superseded') AS superseded, max(n) FILTER (WHERE status = 'stale') AS stale, max(n) FILTER (WHERE status = 'reverted') AS reverted,
(SELECT value FROM o WHERE o.record = c.record AND path = 'amount') AS amount, (SELECT value FROM o WHERE o.record = c.record AND path = 'days') AS days FROM c GROUP BY 1"""))
def edit_lifecycle(spark, d):
    """2.8.11, 2.8.13: edits proposed, superseded by later proposals of their field, applied under no token or under the record's own
    (any other is stale, be it older or newer), or reverted; each field is the last one applied."""
    own = laws(spark, d).select(F.col("law_id").alias("record"), F.col("jurisdiction_id").cast("string").alias("current"))
    e = table(spark, d, "events").select("event_id", "ts", F.col("user_id").alias("record"), F.when(F.col("value") < 40, "days").otherwise("amount").alias("path"), "value", F.expr(_ACT).alias("act"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    token = F.when(F.col("event_id") % 3 == 1, (F.col("k") % 25).cast("string")).when(F.col("event_id") % 3 == 2, F.col("current"))
    e = e.join(own, "record").withColumn("token", token)
    # the last proposal of a field, by an aggregate: no record's edits are ordered
    latest = e.filter("act = 'propose'").groupBy("record", "path").agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("latest"))
    status = F.when(F.col("act") == "propose", F.when(F.col("event_id") == F.col("latest"), "pending").otherwise("superseded")).when(F.col("act") == "revert", "reverted").when(K.foreign_token(F.col("token"), F.col("current")), "stale").otherwise("applied")
    s = e.join(latest, ["record", "path"], "left").withColumn("status", status)
    last = lambda path: F.max(F.when((F.col("status") == "applied") & (F.col("path") == path), F.struct("ts", "event_id", "value")))["value"].alias(path)
    count = lambda x: F.nullif(F.count_if(F.col("status") == x), F.lit(0)).alias(x)
    return s.groupBy("record").agg(*map(count, ("pending", "superseded", "stale", "reverted")), last("amount"), last("days"))


@query(with_domain("""t AS (SELECT version_id, weight FROM versions WHERE effective < DATE '1997-01-01'), i AS (SELECT nullif(version_id % 9000, 7) AS version_id, weight * 2 AS weight, effective FROM versions WHERE status = 'O' OR effective < DATE '1995-01-01'),
o AS (SELECT version_id, arg_min(weight, (effective, weight)) AS oldest, arg_max(weight, (effective, weight)) AS newest FROM i GROUP BY 1),
a AS (SELECT 'first' AS kind, * FROM t UNION ALL SELECT 'first', version_id, oldest FROM o WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.version_id IS NOT DISTINCT FROM o.version_id) UNION ALL SELECT 'last', version_id, newest FROM o UNION ALL SELECT 'last', * FROM t WHERE NOT EXISTS (SELECT 1 FROM o WHERE t.version_id IS NOT DISTINCT FROM o.version_id))
SELECT kind, count(*) AS n, count(DISTINCT version_id) AS n_keys, count(*) FILTER (WHERE version_id IS NULL) AS n_null, CAST(sum(CAST(weight AS DECIMAL(18,4))) AS DOUBLE) AS weight FROM a GROUP BY 1"""))
def keyed_writes(spark, d):
    """2.1.29, 2.13.4: a target after a first-write and after a last-write sink of rows with repeated and null keys, in the order
    of their dates; a second write of the same rows changes nothing."""
    v = versions(spark, d)
    target = v.filter("effective < '1997-01-01'").select("version_id", "weight")
    incoming = v.filter("status = 'O' OR effective < '1995-01-01'").selectExpr("nullif(version_id % 9000, 7) AS version_id", "weight * 2 AS weight", "effective")
    twice = lambda sink: sink(sink(target, incoming, ["version_id"], ["effective", "weight"]), incoming, ["version_id"], ["effective", "weight"])
    both = twice(sinks.first_write).withColumn("kind", F.lit("first")).unionByName(twice(sinks.last_write).withColumn("kind", F.lit("last")))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("version_id").alias("n_keys"), F.count_if(F.col("version_id").isNull()).alias("n_null"), F.sum(F.col("weight").cast("decimal(18,4)")).cast("double").alias("weight"))


@query(with_domain("""b AS (SELECT s_suppkey AS agent_id, s_acctbal FROM supplier), x AS (SELECT f.agent_id, s_acctbal FROM facts f LEFT JOIN b USING (agent_id))
SELECT agent_id, CASE WHEN s_acctbal > 5000 THEN 'synced' WHEN s_acctbal > 0 THEN 'replayed' ELSE 'dead' END AS outcome, count(*) AS n FROM x GROUP BY ALL"""))
def dead_letters(spark, d):
    """2.13.3: facts whose agent the bridge does not know are put aside, and replayed when a later bridge knows more."""
    rows, agents = facts(spark, d).select("agent_id", "version_id", "line"), table(spark, d, "supplier").select(F.col("s_suppkey").alias("agent_id"), "s_acctbal")
    synced, aside = sinks.split_known(rows, agents.filter("s_acctbal > 5000"), ["agent_id"])
    replayed, dead = sinks.split_known(aside, agents.filter("s_acctbal > 0"), ["agent_id"])
    named = [r.withColumn("outcome", F.lit(n)) for r, n in ((synced, "synced"), (replayed, "replayed"), (dead, "dead"))]
    return named[0].unionByName(named[1]).unionByName(named[2]).groupBy("agent_id", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query(with_domain("""g AS (SELECT law_id FROM laws WHERE balance < 0), v AS (SELECT version_id, law_id FROM versions WHERE law_id NOT IN (SELECT law_id FROM g)), m AS (SELECT law_id, min(law_id) OVER (PARTITION BY jurisdiction_id, subject) AS new FROM laws)
SELECT 'laws' AS name, count(*) AS left_over, 0 AS moved FROM laws WHERE balance >= 0 UNION ALL SELECT 'versions', count(*), 0 FROM v UNION ALL SELECT 'facts', count(*), 0 FROM facts WHERE version_id IN (SELECT version_id FROM v)
UNION ALL SELECT 'merged', (SELECT count(DISTINCT new) FROM m), (SELECT count(*) FROM versions JOIN m USING (law_id) WHERE law_id <> new)"""))
def cascades(spark, d):
    """2.8.14, 2.8.15: laws deleted with all that hangs on them; duplicates merged, their versions moved to the one that stays."""
    t = {"laws": laws(spark, d), "versions": versions(spark, d), "facts": facts(spark, d)}
    left = sinks.without(t, "laws", t["laws"].filter("balance < 0").select("law_id"), [("laws", "law_id", "versions", "law_id"), ("versions", "version_id", "facts", "version_id")])
    first = t["laws"].groupBy("jurisdiction_id", "subject").agg(F.min("law_id").alias("new"))
    pairs = t["laws"].join(first, ["jurisdiction_id", "subject"]).filter("law_id <> new").select(F.col("law_id").alias("old"), "new")
    parents, moved = sinks.merged(t["laws"].select("law_id"), t["versions"].select("version_id", "law_id"), pairs, "law_id")
    counts = [rows.agg(F.count(F.lit(1)).alias("left_over")).select(F.lit(name).alias("name"), "left_over", F.lit(0).cast("long").alias("moved")) for name, rows in left.items()]
    changed = moved.join(t["versions"].select("version_id", F.col("law_id").alias("was")), "version_id").filter("law_id <> was").agg(F.count(F.lit(1)).alias("moved"))
    last = parents.agg(F.count(F.lit(1)).alias("left_over")).join(F.broadcast(changed)).select(F.lit("merged").alias("name"), "left_over", "moved")  # one row each
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(last)


_ACTORS = "CASE p_partkey % 6 WHEN 0 THEN 'developer' WHEN 1 THEN 'deployer' WHEN 2 THEN 'individual' WHEN 3 THEN '' WHEN 4 THEN 'processor' END"
_CODES = "CASE p_size % 7 WHEN 0 THEN 'G' WHEN 1 THEN 'F, D' WHEN 2 THEN 'A*' WHEN 3 THEN '' WHEN 4 THEN 'X' WHEN 5 THEN 'A' END"
_COVERED = "CASE trim(c) " + " ".join(f"WHEN '{k}' THEN {list(v)}" for k, v in K.SCOPES.items()) + " END"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_WORDS = f"list_distinct(list_filter(regexp_extract_all(lower({{}}), '[a-z0-9]+'), lambda t: length(t) >= 3 AND t NOT IN ({_STOP})))"
_LIKE = lambda a, b: f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))::DOUBLE END"
_NEEDS, _PENALTY = "CASE p_partkey % 3 WHEN 0 THEN 'annual report on ' || p_type WHEN 1 THEN p_name || ' ' || p_brand END", "CASE p_partkey % 4 WHEN 0 THEN 'fines for ' || p_name WHEN 1 THEN '' END"


@query(f"""WITH r AS (SELECT p_partkey, {_ACTORS} AS actor, {_CODES} AS codes, {_WORDS.format("p_name || ' ' || p_type || ' report'")} AS own, {_NEEDS} AS n, {_PENALTY} AS f FROM part),
a AS (SELECT *, list_distinct(flatten(list_filter(list_transform(string_split(codes, ','), lambda c: {_COVERED}), lambda x: x IS NOT NULL))) AS covered, {_WORDS.format("coalesce(n, '')")} AS nw, {_WORDS.format("coalesce(f, '')")} AS fw FROM r), s AS (SELECT *, {_LIKE('own', 'nw')} AS ns, {_LIKE('own', 'fw')} AS fs FROM a)
SELECT p_partkey, CASE WHEN coalesce(codes, '') = '' OR coalesce(actor, '') = '' OR coalesce(len(covered), 0) = 0 THEN 'tracker_silent' WHEN list_contains(covered, actor) THEN 'aligned' ELSE 'scope_mismatch' END AS alignment, floor(ns * 10000 + 0.5) / 10000 AS requirements, floor(fs * 10000 + 0.5) / 10000 AS enforcement,
floor(CASE WHEN coalesce(n, '') <> '' AND coalesce(f, '') <> '' THEN 0.6::DOUBLE * ns + 0.4::DOUBLE * fs WHEN coalesce(n, '') <> '' THEN ns WHEN coalesce(f, '') <> '' THEN fs END * 10000 + 0.5) / 10000 AS combined,
array_to_string(list_sort(list_distinct(list_concat(list_intersect(own, nw), list_intersect(own, fw))))[1:20], ' ') AS matched FROM s""")
def tracker_alignment(spark, d):
    """2.9.11, 2.11.20: a fact against its law in a tracker: whether its actor is in scope, and how alike their words are."""
    rows = table(spark, d, "part")
    like = K.tracker_likeness(F.array(F.col("p_name"), F.col("p_type"), F.lit("report")), F.expr(_NEEDS), F.expr(_PENALTY))
    found = rows.select("p_partkey", K.alignment(F.expr(_ACTORS), F.expr(_CODES)).alias("alignment"), like.alias("x"))
    return found.select("p_partkey", "alignment", "x.requirements", "x.enforcement", "x.combined", F.array_join("x.matched", " ").alias("matched"))


_LOOSE = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_CLAUSE = "CASE doc_id % 3 WHEN 0 THEN translate(substr(text, CAST(1 + (doc_id * 17) % greatest(length(text) - 40, 1) AS INT), 40), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN 1 THEN source || ' is nowhere quoted' ELSE '' END"
_HELD = lambda q: f"({_LOOSE.format(q)} <> '' AND contains({_LOOSE.format('text')}, {_LOOSE.format(q)}))"
_GAP = "CASE doc_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END"


@query(f"""WITH r AS (SELECT doc_id, text, {_CLAUSE} AS clause, [substr(text, 1, 30), source || '?', lang] AS actors, {_GAP} AS gap FROM documents)
SELECT doc_id, CASE WHEN {_HELD('clause')} THEN clause END AS clause, coalesce({_HELD('actors[1]')}, FALSE)::INT + coalesce({_HELD('actors[2]')}, FALSE)::INT + coalesce({_HELD('actors[3]')}, FALSE)::INT AS n_actors, coalesce(gap IN ('high', 'medium'), FALSE) AS gap_kept FROM r""")
def guards(spark, d):
    """2.14.2, 2.14.6, 2.14.7: clauses and actors that the passage does not hold go; of gaps, only weighty ones stay."""
    rows = table(spark, d, "documents").select("doc_id", "text", F.expr(_CLAUSE).alias("clause"), F.array(F.expr("substr(text, 1, 30)"), F.concat("source", F.lit("?")), F.col("lang")).alias("actors"), F.expr(_GAP).alias("gap"))
    held = F.size(F.filter("actors", lambda a: K.quoted_in(F.col("text"), a)))
    return rows.select("doc_id", K.guarded_clause(F.col("text"), F.col("clause")).alias("clause"), F.greatest(held, F.lit(0)).alias("n_actors"), F.coalesce(F.col("gap").isin("high", "medium"), F.lit(False)).alias("gap_kept"))


@query("""WITH m AS (SELECT max(ts) AS now FROM events), j AS (SELECT user_id AS job, max(ts) AS seen, arg_max(event_type, (ts, event_id)) AS last, count(*) AS attempts FROM events GROUP BY 1)
SELECT job, CASE WHEN last = 'purchase' THEN 'done' WHEN date_diff('second', seen, now) > 6 * 3600 THEN 'failed' ELSE 'running' END AS status, floor(date_diff('second', seen, now) / 3600.0 * 10 + 0.5) / 10 AS age_hours, CASE WHEN date_diff('second', seen, now) > 48 * 3600 THEN 'stale' ELSE 'fresh' END AS alert,
greatest(0.0::DOUBLE, least(CASE WHEN job % 5 = 0 THEN 90.0::DOUBLE ELSE pow(2.0::DOUBLE, attempts % 8) END, 60.0::DOUBLE) * (1 + 0.25::DOUBLE * (job % 3 - 1))) AS backoff FROM j, m""")
def job_recovery(spark, d, stale_hours: int = 6, fresh_hours: int = 48):
    """2.13.12, 2.13.13, 2.13.16: jobs that have not been heard of for hours are failed, old news raises an alert, and the wait before
    another attempt is capped and jittered."""
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))  # one row
    j = e.groupBy(F.col("user_id").alias("job")).agg(F.max(F.struct("ts", "event_id", "event_type")).alias("last"), F.count(F.lit(1)).alias("attempts"))
    age = F.unix_seconds(F.col("now").cast("timestamp")) - F.unix_seconds(F.col("last.ts").cast("timestamp"))
    status = F.when(F.col("last.event_type") == "purchase", "done").when(age > stale_hours * 3600, "failed").otherwise("running")
    wait = K.backoff_seconds(F.col("attempts") % 8, F.when(F.col("job") % 5 == 0, 90.0), F.col("job") % 3 - 1)
    return j.join(F.broadcast(now)).select("job", status.alias("status"), (F.floor(age / 3600 * 10 + 0.5) / 10).alias("age_hours"), F.when(age > fresh_hours * 3600, "stale").otherwise("fresh").alias("alert"), wait.alias("backoff"))


_SEVERITY = "CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'info' ELSE 'warning' END"


@query(f"""WITH e AS (SELECT user_id % 20 AS agent, event_type, value, {_SEVERITY} AS severity, date_trunc('hour', ts) AS hour FROM events), u AS (SELECT agent, severity, event_type, hour FROM e GROUP BY ALL)
SELECT agent, count(*) AS n, count(*) FILTER (WHERE severity = 'critical') AS failed, floor(count(*) FILTER (WHERE severity = 'critical') * 10000 / count(*)) / 10000 AS failure_rate, (SELECT count(*) FROM u WHERE u.agent = e.agent AND severity = 'warning') AS warnings, max(value) AS longest FROM e GROUP BY 1""")
def agent_health(spark, d):
    """2.13.8: each agent's runs, failures and warnings; a warning that repeats within an hour counts once."""
    e = table(spark, d, "events").select((F.col("user_id") % 20).alias("agent"), "event_type", "value", F.expr(_SEVERITY).alias("severity"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"))
    # counted by hour first, so that a repeated warning is one row before it is counted
    hours = e.groupBy("agent", "severity", "event_type", "hour").agg(F.count(F.lit(1)).alias("k"), F.max("value").alias("longest"))
    n, failed = F.sum("k"), F.coalesce(F.sum(F.when(F.col("severity") == "critical", F.col("k"))), F.lit(0))
    return hours.groupBy("agent").agg(n.alias("n"), failed.alias("failed"), (F.floor(failed * 10000 / n) / 10000).alias("failure_rate"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.max("longest").alias("longest"))


_KIND = "CASE p_partkey % 8 WHEN 0 THEN 'federal_preemption' WHEN 1 THEN ' Cross_State_Conflict ' WHEN 2 THEN 'first_amendment' WHEN 3 THEN 'other' WHEN 4 THEN 'unheard of' WHEN 5 THEN 'interstate_commerce' WHEN 6 THEN 'agency_jurisdiction' END"
_TOLD = "CASE p_size % 6 WHEN 0 THEN 'May conflict with 47 U.S.C. 230' WHEN 1 THEN 'This does not appear to conflict with anything' WHEN 2 THEN 'May conflict with the law of  West Virginia' WHEN 3 THEN 'A rule of Texas' WHEN 4 THEN p_name ELSE NULL END"
_CITES = "CASE p_partkey % 5 WHEN 0 THEN 'Dec 2025 Federal EO on AI' WHEN 1 THEN 'HIPAA' END"
_CLAUSES = "CASE p_partkey % 11 WHEN 0 THEN 'nothing in this act preempts' WHEN 1 THEN ' ' END"
_REFS = "CASE p_partkey % 3 WHEN 0 THEN 'Penal Code|5' WHEN 1 THEN 'Ohio Code|7' END"
_STATE = "CASE p_partkey % 7 WHEN 0 THEN 'tx' WHEN 1 THEN 'WV' WHEN 2 THEN 'CA' WHEN 3 THEN 'XX' END"
_CASES = lambda cases: " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in cases.items())
_HAY = "lower(concat_ws(' | ', coalesce(cites, ''), coalesce(told, ''), coalesce(replace(refs, '|', ' | '), '')))"
for _x in X.EXAMPLES:
    _HAY = f"replace({_HAY}, '{_x}', ' ')"
_OTHERS = " OR ".join(f"(own <> '{n}' AND regexp_matches(hay, '\\b{n}\\b'))" for n in X.NAMES.values())
_NEGATED = X.SELF_NEGATION.replace("'", "''")


@query(f"""WITH r AS (SELECT p_partkey, lower(trim(coalesce({_KIND}, ''))) AS kind, {_TOLD} AS told, {_CITES} AS cites, {_CLAUSES} AS clause, {_REFS} AS refs, {_STATE} AS state FROM part), h AS (SELECT *, CASE upper(trim(state)) {_CASES(X.NAMES)} END AS own, regexp_replace({_HAY}, '\\s+', ' ', 'g') AS hay FROM r),
c AS (SELECT *, CASE kind {_CASES({k: v for k, v in X.CONTEXTS.items() if v != 'unclassified'})} ELSE CASE WHEN refs IS NOT NULL AND coalesce(trim(clause), '') = '' AND coalesce(trim(cites), '') = '' THEN 'cross_law_reference' ELSE 'unclassified' END END AS context,
CASE WHEN coalesce(trim(clause), '') <> '' THEN NULL WHEN regexp_matches(lower(coalesce(told, '')), '{_NEGATED}') THEN 'self_negating_description' WHEN kind IN {X.ASSERTING} AND NOT (regexp_matches(hay, '{X.FEDERAL}') OR (own IS NOT NULL AND ({_OTHERS}))) THEN 'no_external_authority' END AS reason FROM h)
SELECT p_partkey, context, reason IS NULL AS credible, reason, context <> 'unclassified' AND reason IS NULL AS display FROM c""")
def legal_contexts(spark, d):
    """2.9.57: signals of conflict with other law by kind, whether they name what they rest on, and whether they are shown."""
    columns = [F.expr(e).alias(n) for n, e in (("kind", _KIND), ("told", _TOLD), ("cites", _CITES), ("clause", _CLAUSES), ("refs", _REFS), ("state", _STATE))]
    rows = table(spark, d, "part").select("p_partkey", *columns).withColumn("refs", F.split("refs", "[|]"))
    found = X.legal_context(*map(F.col, ("kind", "clause", "told", "cites", "refs", "state")))
    return rows.select("p_partkey", found.alias("x")).select("p_partkey", "x.*")
