"""What becomes of facts after extraction: staleness, progress, merges, checks, scores against a gold set, rate windows
(inventory 2.4, 2.13, 2.14)."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators.packing import passages
from ..registry import query
from ..sources.tables import facts, table, versions, with_domain
from ..streaming.breaker import CALLS_LEAST, IN_A_ROW, RATE_MOST


@query(with_domain("""SELECT version_id, line, part_id, agent_id, concat_ws(',', CASE WHEN model <> 'm1' THEN 'model' END, CASE WHEN model = 'm1' AND prompt <> 'p' || agent_id % 4 THEN 'prompt' END) AS why
FROM (SELECT *, CASE WHEN agent_id % 3 > 0 THEN 'm' || agent_id % 3 END AS model, CASE WHEN part_id % 5 > 0 THEN 'p' || part_id % 4 END AS prompt FROM facts) WHERE coalesce(model <> 'm1', FALSE) OR coalesce(model = 'm1' AND prompt <> 'p' || agent_id % 4, FALSE)"""))
def stale_facts(spark, d):
    """2.4.24: facts of another model, or of another prompt than their own agent's; an unknown model or prompt is not stale."""
    model = F.when(F.col("agent_id") % 3 > 0, F.concat(F.lit("m"), (F.col("agent_id") % 3).cast("string")))
    prompt = F.when(F.col("part_id") % 5 > 0, F.concat(F.lit("p"), (F.col("part_id") % 4).cast("string")))
    current = F.concat(F.lit("p"), (F.col("agent_id") % 4).cast("string"))
    other, worn = model != "m1", (model == "m1") & (prompt != current)
    rows = facts(spark, d).filter(F.coalesce(other, F.lit(False)) | F.coalesce(worn, F.lit(False)))
    return rows.select("version_id", "line", "part_id", "agent_id", F.concat_ws(",", F.when(other, "model"), F.when(worn, "prompt")).alias("why"))


# The weight of each step in the progress of the whole.
STEPS = {"discovery": 0.05, "fetch": 0.10, "extraction": 0.50, "review": 0.30, "sync": 0.05}


@query(with_domain(f"""s AS (SELECT 'discovery' AS step, count(*) AS total, count(*) AS done FROM laws UNION ALL SELECT 'fetch', count(*), count(*) FILTER (WHERE status <> 'P') FROM versions UNION ALL
SELECT 'extraction', (SELECT count(*) FROM versions), count(DISTINCT version_id) FROM facts UNION ALL SELECT 'review', count(*), count(*) FILTER (WHERE fact_type <> 'N') FROM facts UNION ALL SELECT 'sync', count(*) FILTER (WHERE approved), 0 FROM facts),
p AS (SELECT *, CASE WHEN total = 0 THEN 0.0::DOUBLE ELSE done / total * 100 END AS percent, CASE step {' '.join(f"WHEN '{k}' THEN {w}" for k, w in STEPS.items())} END::DOUBLE AS weight FROM s)
SELECT step, total, done, floor(percent * 10 + 0.5) / 10 AS percent, floor(percent * weight * 10000 + 0.5) / 10000 AS share FROM p"""))
def pipeline_progress(spark, d):
    """2.4.25: total, done and weighted share of each step; a step of nothing has done nothing."""
    from ..sources.tables import laws

    n, f, v = F.count(F.lit(1)), facts(spark, d), versions(spark, d)
    # facts and versions are each read once for their two counts
    per_fact = f.agg(n.alias("facts"), F.count_if(F.col("fact_type") != "N").alias("reviewed"), F.count_if("approved").alias("approved"), F.count_distinct("version_id").alias("extracted"))
    per_version = v.agg(n.alias("versions"), F.count_if(F.col("status") != "P").alias("fetched"))
    one = laws(spark, d).agg(n.alias("laws")).join(F.broadcast(per_version)).join(F.broadcast(per_fact))  # one row each
    pairs = {"discovery": ("laws", "laws"), "fetch": ("versions", "fetched"), "extraction": ("versions", "extracted"), "review": ("facts", "reviewed"), "sync": ("approved", None)}
    steps = [F.struct(F.lit(k).alias("step"), F.col(t).alias("total"), (F.col(x) if x else F.lit(0)).cast("long").alias("done"), F.lit(STEPS[k]).alias("weight")) for k, (t, x) in pairs.items()]
    rows = one.select(F.inline(F.array(*steps)))
    percent = F.when(F.col("total") == 0, 0.0).otherwise(F.col("done") / F.col("total") * 100)
    return rows.select("step", "total", "done", (F.floor(percent * 10 + 0.5) / 10).alias("percent"), (F.floor(percent * F.col("weight") * 10000 + 0.5) / 10000).alias("share"))


@query("""WITH j AS (SELECT event_id, user_id % 20 AS queue, CASE event_type WHEN 'view' THEN 'completed' WHEN 'click' THEN 'running' ELSE 'failed' END AS status, ts AS started, ts + INTERVAL (1 + event_id % 90) SECOND AS ended, event_id % 7 AS n FROM events),
r AS (SELECT *, (SELECT max(ts) FROM events) + INTERVAL 1 HOUR AS now FROM j WHERE n > 0 AND status <> 'failed'),
k AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY status = 'running' DESC, CASE WHEN status = 'running' THEN started ELSE ended END DESC, event_id DESC) AS place FROM r)
SELECT queue, event_id AS job, n * 60 / ((epoch_us(CASE WHEN status = 'running' THEN now ELSE ended END) - epoch_us(started)) / 1e6) AS per_minute FROM k WHERE place = 1""")
def extraction_rate(spark, d):
    """2.4.26: passages a minute by the latest running job, else by the latest completed one."""
    e = table(spark, d, "events").withColumn("started", F.unix_micros(F.col("ts").cast("timestamp")))
    last = e.agg((F.max("started") + 3_600_000_000).alias("now"))  # one row
    running, completed, n = F.col("event_type") == "click", F.col("event_type") == "view", F.col("event_id") % 7
    ended = F.col("started") + (1 + F.col("event_id") % 90) * 1_000_000
    jobs = e.filter((running | completed) & (n > 0)).select((F.col("user_id") % 20).alias("queue"), "event_id", running.alias("running"), "started", ended.alias("ended"), n.alias("n"))
    order = F.struct("running", F.when(F.col("running"), F.col("started")).otherwise(F.col("ended")).alias("at"), "event_id")
    top = jobs.groupBy("queue").agg(F.max_by(F.struct("event_id", "running", "started", "ended", "n"), order).alias("j")).join(F.broadcast(last))
    seconds = (F.when(F.col("j.running"), F.col("now")).otherwise(F.col("j.ended")) - F.col("j.started")) / 1e6
    return top.select("queue", F.col("j.event_id").alias("job"), (F.col("j.n") * 60 / seconds).alias("per_minute"))


#: Sources of an amount, the most trusted first.
SOURCES = ("first_tracker", "second_tracker", "bill", "facts")


@query(with_domain("""s AS (SELECT law_id, 1 AS rank, CAST(floor(balance) AS BIGINT) AS value FROM laws WHERE balance > 5000 UNION ALL SELECT law_id, 2, CAST(floor(balance / 10) AS BIGINT) * 10 FROM laws WHERE balance > 3000
UNION ALL SELECT law_id, 3, CAST(floor(max(weight)) AS BIGINT) FROM versions WHERE status = 'O' GROUP BY 1 UNION ALL SELECT law_id, 4, CAST(floor(max(amount)) AS BIGINT) FROM facts JOIN versions USING (version_id) WHERE fact_type = 'R' GROUP BY 1)
SELECT law_id, arg_min(value, rank) AS value, ['first_tracker', 'second_tracker', 'bill', 'facts'][min(rank)] AS source, count(DISTINCT value) > 1 AS conflict, count(*) AS n_sources FROM s GROUP BY 1"""))
def merged_penalties(spark, d):
    """2.4.33, 2.4.34: the value of the most trusted source that has one, where it is from, and whether sources disagree.
    Sources are stacked and folded once, whatever their number; the facts of a law give their largest amount."""
    from ..sources.tables import laws

    law, v = laws(spark, d), versions(spark, d)
    whole = lambda c: F.floor(c).cast("long").alias("value")
    found = [
        law.filter("balance > 5000").select("law_id", F.lit(1).alias("rank"), whole(F.col("balance"))),
        law.filter("balance > 3000").select("law_id", F.lit(2).alias("rank"), (F.floor(F.col("balance") / 10) * 10).cast("long").alias("value")),
        v.filter("status = 'O'").groupBy("law_id").agg(whole(F.max("weight"))).select("law_id", F.lit(3).alias("rank"), "value"),
        facts(spark, d).filter("fact_type = 'R'").join(v, "version_id").groupBy("law_id").agg(whole(F.max("amount"))).select("law_id", F.lit(4).alias("rank"), "value"),
    ]
    stacked = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
    source = F.element_at(F.array(*map(F.lit, SOURCES)), F.min("rank"))
    return stacked.groupBy("law_id").agg(F.min_by("value", "rank").alias("value"), source.alias("source"), (F.count_distinct("value") > 1).alias("conflict"), F.count(F.lit(1)).alias("n_sources"))


@query(with_domain("""k AS (SELECT DISTINCT law_id, part_id FROM facts JOIN versions USING (version_id) WHERE approved),
n AS (SELECT DISTINCT law_id, part_id, CASE fact_type WHEN 'A' THEN 'express' WHEN 'R' THEN 'implied' ELSE 'unclear' END AS kind FROM facts JOIN versions USING (version_id) WHERE NOT approved)
SELECT law_id, kind, count(*) AS n_new FROM n WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.law_id = n.law_id AND k.part_id = n.part_id) GROUP BY 1, 2"""))
def new_conflicts(spark, d):
    """2.4.18: conflicts not listed yet: an anti join of distinct pairs keeps a rerun from adding them again."""
    rows = facts(spark, d).join(versions(spark, d), "version_id")
    listed = rows.filter("approved").select("law_id", "part_id").distinct()
    kind = F.when(F.col("fact_type") == "A", "express").when(F.col("fact_type") == "R", "implied").otherwise("unclear")
    new = rows.filter("NOT approved").select("law_id", "part_id", kind.alias("kind")).distinct().join(listed, ["law_id", "part_id"], "left_anti")
    return new.groupBy("law_id", "kind").agg(F.count(F.lit(1)).alias("n_new"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '9' WHEN 2 THEN 'x' ELSE CAST(l_linenumber - 1 AS VARCHAR) END AS said, l_discount * 10 AS score FROM lineitem),
i AS (SELECT *, try_cast(said AS INT) AS place, count(*) OVER (PARTITION BY l_orderkey) AS n FROM r), c AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, place) AS same FROM i)
SELECT CASE WHEN place IS NULL THEN 'no_index' WHEN place >= n THEN 'out_of_range' WHEN same > 1 THEN 'ambiguous' WHEN score >= 0.5 THEN 'confirmed' ELSE 'disputed' END AS verdict, count(*) AS n FROM c GROUP BY 1""")
def checks_attributed(spark, d):
    """2.14.1: results of a check count only for the item they name without doubt; all others fail closed."""
    said = F.expr("CASE l_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '9' WHEN 2 THEN 'x' ELSE CAST(l_linenumber - 1 AS STRING) END")
    rows = table(spark, d, "lineitem").select("l_orderkey", said.try_cast("int").alias("at"), (F.col("l_discount") * 10).alias("score"))
    item = Window.partitionBy("l_orderkey")
    counted = rows.withColumn("n", F.count(F.lit(1)).over(item)).withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("l_orderkey", "at")))
    verdict = F.when(F.col("at").isNull(), "no_index").when(F.col("at") >= F.col("n"), "out_of_range").when(F.col("same") > 1, "ambiguous").when(F.col("score") >= 0.5, "confirmed").otherwise("disputed")
    return counted.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH x AS (SELECT doc_id, source, unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '[0-9]+'))) AS number FROM documents), i AS (SELECT source, number, min(doc_id) AS place FROM x GROUP BY 1, 2),
r AS (SELECT doc_id, source, CAST(doc_id % 60 AS VARCHAR) AS number FROM documents) SELECT r.doc_id, number, place, CASE WHEN place IS NULL THEN 'missing' WHEN place = r.doc_id THEN 'own' ELSE 'found' END AS outcome FROM r LEFT JOIN i USING (source, number)""")
def citations_verified(spark, d):
    """2.14.3, 2.14.4: an index of the numbers in each document's passages, and references looked up in it."""
    docs = table(spark, d, "documents")
    numbers = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[0-9]+"), F.lit(0)))
    index = docs.select("doc_id", "source", F.explode(numbers).alias("number")).groupBy("source", "number").agg(F.min("doc_id").alias("place"))
    refs = docs.select("doc_id", "source", (F.col("doc_id") % 60).cast("string").alias("number")).join(index, ["source", "number"], "left")
    outcome = F.when(F.col("place").isNull(), "missing").when(F.col("place") == F.col("doc_id"), "own").otherwise("found")
    return refs.select("doc_id", "number", "place", outcome.alias("outcome"))


@query(with_domain("""e AS (SELECT version_id, CASE status WHEN 'F' THEN 'A' WHEN 'O' THEN ' n ' END AS fact_type, CAST(version_id % 50 + 1 AS INT) AS quantity, TRUE AS approved FROM versions WHERE weight > 100000),
m AS (SELECT e.version_id, f.line, f.part_id, f.amount, e.fact_type AS et, f.fact_type AS ft, e.quantity AS eq, CAST(f.quantity AS INT) AS fq, e.approved AS ea, f.approved AS fa, f.version_id IS NULL AS none FROM e LEFT JOIN facts f USING (version_id)),
s AS (SELECT *, (lower(trim(et)) = lower(trim(ft)))::INT AS a, (eq = fq)::INT AS b, (ea = fa)::INT AS c, row_number() OVER (PARTITION BY version_id ORDER BY coalesce((lower(trim(et)) = lower(trim(ft)))::INT, 0) + coalesce((eq = fq)::INT, 0) + coalesce((ea = fa)::INT, 0) DESC, line, part_id, amount) AS place FROM m),
t AS (SELECT unnest([{'f': 'fact_type', 'tp': a, 'want': et IS NOT NULL, 'got': ft IS NOT NULL}, {'f': 'quantity', 'tp': b, 'want': eq IS NOT NULL, 'got': fq IS NOT NULL}, {'f': 'approved', 'tp': c, 'want': TRUE, 'got': fa IS NOT NULL}], recursive := true), none FROM s WHERE place = 1)
SELECT f AS field, count(*) FILTER (WHERE tp = 1) AS tp, count(*) FILTER (WHERE got AND coalesce(tp, 0) = 0) AS fp, count(*) FILTER (WHERE want AND coalesce(tp, 0) = 0) AS fn, count(*) FILTER (WHERE none) AS missed FROM t GROUP BY 1"""))
def gold_scores(spark, d):
    """2.14.10-2.14.12: each expected fact against the version's closest one, by the number of equal fields; strings are equal
    but for case and outer blanks. One aggregate picks the closest, so no version's facts are ordered."""
    expected = versions(spark, d).filter("weight > 100000").select("version_id", F.expr("CASE status WHEN 'F' THEN 'A' WHEN 'O' THEN ' n ' END").alias("et"), F.expr("CAST(version_id % 50 + 1 AS INT)").alias("eq"), F.lit(True).alias("ea"))
    got = facts(spark, d).select("version_id", "line", "part_id", "amount", F.col("fact_type").alias("ft"), F.col("quantity").cast("int").alias("fq"), F.col("approved").alias("fa"))
    plain = lambda c: F.lower(F.trim(c))
    same = {"fact_type": (plain("et") == plain("ft"), "et", "ft"), "quantity": (F.col("eq") == F.col("fq"), "eq", "fq"), "approved": (F.col("ea") == F.col("fa"), "ea", "fa")}
    hits = sum((F.coalesce(s.cast("int"), F.lit(0)) for s, *_ in same.values()), F.lit(0))
    marks = F.array(*[F.struct(F.lit(k).alias("field"), F.coalesce(s, F.lit(False)).alias("hit"), F.col(e).isNotNull().alias("want"), F.col(g).isNotNull().alias("got")) for k, (s, e, g) in same.items()])
    closest = expected.join(got, "version_id", "left").groupBy("version_id").agg(F.min_by(F.struct(marks.alias("m"), F.col("fa").isNull().alias("none")), F.struct(-hits, "line", "part_id", "amount")).alias("x"))
    rows = closest.select("x.none", F.inline("x.m"))
    return rows.groupBy("field").agg(F.count_if("hit").alias("tp"), F.count_if(F.col("got") & ~F.col("hit")).alias("fp"), F.count_if(F.col("want") & ~F.col("hit")).alias("fn"), F.count_if("none").alias("missed"))


@query("""WITH s AS (SELECT event_type, epoch_us(ts) // 1000000 AS second, count(*) AS k FROM events GROUP BY 1, 2), w AS (SELECT *, sum(k) OVER (PARTITION BY event_type ORDER BY second RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS rpm FROM s)
SELECT event_type, CAST(sum(k) AS BIGINT) AS total, CAST(max(rpm) AS BIGINT) AS peak, count(*) FILTER (WHERE rpm >= 2) AS busy_seconds FROM w GROUP BY 1""")
def request_rates(spark, d, seconds: int = 60):
    """2.13.5, 2.13.6: requests in the minute up to each busy second, by kind; counted by second first. Windows run within an hour
    of a kind, and the tail of the hour before is copied in, so that one busy kind is spread over many tasks."""
    second = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("second")
    k = table(spark, d, "events").groupBy("event_type", second).agg(F.count(F.lit(1)).alias("k")).withColumn("hour", F.floor(F.col("second") / 3600))
    hours = F.when(F.col("second") % 3600 > 3600 - seconds, F.array(F.col("hour"), F.col("hour") + 1)).otherwise(F.array("hour"))
    spread = k.withColumn("in_hour", F.explode(hours))
    near = Window.partitionBy("event_type", "in_hour").orderBy("second").rangeBetween(1 - seconds, 0)
    own = spread.withColumn("rpm", F.sum("k").over(near)).filter("in_hour = hour")
    return own.groupBy("event_type").agg(F.sum("k").alias("total"), F.max("rpm").alias("peak"), F.count_if(F.col("rpm") >= 2).alias("busy_seconds"))


@query("""WITH o AS (SELECT user_id % 500 AS loop, event_id, ts, event_type IN ('view', 'error') AS failed, row_number() OVER w AS n, count(*) FILTER (WHERE event_type NOT IN ('view', 'error')) OVER w AS island FROM events WINDOW w AS (PARTITION BY user_id % 500 ORDER BY ts, event_id)),
f AS (SELECT *, count(*) FILTER (WHERE failed) OVER (PARTITION BY loop ORDER BY ts, event_id) AS failures, count(*) FILTER (WHERE failed) OVER (PARTITION BY loop, island ORDER BY ts, event_id) AS in_a_row FROM o),
t AS (SELECT *, CASE WHEN in_a_row >= 3 THEN 'consecutive' WHEN n >= 10 AND failures / n > 0.8::DOUBLE THEN 'rate' END AS reason FROM f WHERE failed)
SELECT loop, event_id, reason, n AS calls, failures FROM t WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY loop ORDER BY ts, event_id) = 1""")
def breaker_trips(spark, d):
    """2.13.7: where a loop's circuit breaker opens first: after failures in a row, or at a high share of failures."""
    loop = (F.col("user_id") % 500).alias("loop")
    rows = table(spark, d, "events").select(loop, "event_id", "ts", F.col("event_type").isin("view", "error").alias("failed"))
    w = Window.partitionBy("loop").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.select("*", F.count(F.lit(1)).over(w).alias("calls"), F.count_if("failed").over(w).alias("failures"), F.count_if(~F.col("failed")).over(w).alias("island"))
    run = Window.partitionBy("loop", "island").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    tripped = counted.withColumn("in_a_row", F.count_if("failed").over(run)).filter("failed")
    reason = F.when(F.col("in_a_row") >= IN_A_ROW, "consecutive").when((F.col("calls") >= CALLS_LEAST) & (F.col("failures") / F.col("calls") > RATE_MOST), "rate")
    found = tripped.withColumn("reason", reason).filter("reason IS NOT NULL")
    first = found.groupBy("loop").agg(F.min(F.struct("ts", "event_id", "reason", "calls", "failures")).alias("x"))
    return first.select("loop", "x.event_id", "x.reason", "x.calls", "x.failures")


@query("""WITH g AS (SELECT user_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 86400000000 AS new FROM events), s AS (SELECT *, count(*) FILTER (WHERE new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, epoch_us(min(ts)) AS began, epoch_us(max(ts)) + 86400000000 AS closes, count(*) AS n FROM s GROUP BY user_id, session""")
def sessions(spark, d, gap: str = "1 day"):
    """2.13.17: sessions of a user, closed by a day of silence."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.unix_micros("w.start").alias("began"), F.unix_micros("w.end").alias("closes"), "n")


@query()
def passage_chunks(spark, d):
    """2.5.7, 2.9.16: documents as passages of about 3000 characters; a fold, which tests compare with a plain loop."""
    p = passages(table(spark, d, "documents"))
    return p.select("doc_id", "ordinal", "label", F.length("passage").alias("n_chars"), F.sha2("passage", 256).alias("passage_sha256"))
