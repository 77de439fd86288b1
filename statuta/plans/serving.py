"""Serving queries: filters, joins, pages, counts (inventory 2.2, 2.3, 2.6, and the grouped counts of 2.4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..registry import query
from ..sources.tables import TIERS, exact, facts, jurisdictions, laws, mean, table, versions, with_domain

AS_OF = "1997-06-01"
_AVG = "CAST(sum(CAST({0} AS DECIMAL(18,4))) AS DOUBLE) / count(*)"


def served(spark, d) -> DataFrame:
    """fact -> version -> law -> jurisdiction. Facts and versions meet in a shuffle; the other sides are left to Spark,
    which broadcasts them while they are small."""
    return facts(spark, d).join(versions(spark, d), "version_id").join(laws(spark, d), "law_id").join(jurisdictions(spark, d), "jurisdiction_id")


_SERVED = "facts JOIN versions USING (version_id) JOIN laws USING (law_id) JOIN jurisdictions USING (jurisdiction_id)"


def tiers_from(lowest: str) -> list[str]:
    """Tiers at or above a floor; an unknown floor means all."""
    return list(TIERS[: TIERS.index(lowest) + 1]) if lowest in TIERS else list(TIERS)


@query(with_domain(f"SELECT region_name, jurisdiction, subject, fact_type, status, json_extract_string('{{\"modality\": \"' || modality || '\"}}', '$.modality') AS modality, count(*) AS n_facts, {_AVG.format('score')} AS mean_score FROM {_SERVED} WHERE approved GROUP BY ALL"))
def matrix_cells(spark, d):
    """2.4.1, 2.2.2, 2.2.7, 2.3.1: approved facts by six keys, one of them a JSON path."""
    modality = F.get_json_object(F.to_json(F.struct("modality")), "$.modality")
    cells = served(spark, d).filter("approved").withColumn("modality", modality)
    return cells.groupBy("region_name", "jurisdiction", "subject", "fact_type", "status", "modality").agg(F.count(F.lit(1)).alias("n_facts"), mean("score").alias("mean_score"))


@query(with_domain(f"SELECT version_id, line, title, jurisdiction, subject, modality, tier, score, amount, CAST(effective AS VARCHAR)[1:10] AS effective FROM {_SERVED} WHERE approved AND status = 'O' AND (fact_date IS NULL OR fact_date > TIMESTAMP '{AS_OF}')"))
def active_obligations(spark, d, as_of: str = AS_OF):
    """2.2.1, 2.2.3, 2.8.1, 2.8.2: the serving view of what is in force at a given date."""
    rows = served(spark, d).filter(F.col("approved") & (F.col("status") == "O") & (F.col("fact_date").isNull() | (F.col("fact_date") > F.lit(as_of).cast("timestamp"))))
    return rows.select("version_id", "line", "title", "jurisdiction", "subject", "modality", "tier", "score", "amount", F.date_format("effective", "yyyy-MM-dd").alias("effective"))


def obligations(spark, d, jurisdiction=None, subject=None, modality=None, min_tier=None) -> DataFrame:
    """Conjunctive filters, each of which may be left out."""
    asked = [(jurisdiction, lambda v: F.col("jurisdiction") == v), (subject, lambda v: F.col("subject").ilike(f"%{v}%")), (modality, lambda v: F.col("modality") == v), (min_tier, lambda v: F.col("tier").isin(tiers_from(v)))]
    return reduce(lambda df, f: df.filter(f), [f(v) for v, f in asked if v is not None], served(spark, d))


@query(with_domain(f"f AS (SELECT version_id, line, tier, score, amount, title FROM {_SERVED} WHERE lower(subject) LIKE '%build%' AND tier IN ('A', 'B')) SELECT *, (SELECT count(*) FROM f) AS n_found, (SELECT CAST(greatest(1, ceil(count(*) / 25.0)) AS BIGINT) FROM f) AS n_pages FROM f ORDER BY score DESC, version_id, line, amount, title LIMIT 25 OFFSET 50"))
def obligations_page(spark, d, page: int = 3, per_page: int = 25):
    """2.2.4, 2.2.5, 2.6.1, 2.6.2: one page of a filtered list, best first, with totals."""
    found = obligations(spark, d, subject="build", min_tier="B").select("version_id", "line", "tier", "score", "amount", "title")
    total = found.agg(F.count(F.lit(1)).alias("n_found")).withColumn("n_pages", F.greatest(F.lit(1), F.ceil(F.col("n_found") / per_page)).cast("long"))
    rows = found.orderBy(F.col("score").desc(), "version_id", "line", "amount", "title").offset((page - 1) * per_page).limit(per_page)
    return rows.join(F.broadcast(total))  # one row


@query("""SELECT json_extract_string(props, '$.k') AS k, count(*) AS n, count(*) FILTER (WHERE json_extract(props, '$.absent') IS NOT NULL) AS n_absent, count(*) FILTER (WHERE try_cast(json_extract_string(props, '$.k') AS INT) > 50) AS n_large,
count(*) FILTER (WHERE CAST(json_extract_string('{"truncated": ' || (value > 50) || '}', '$.truncated') AS BOOLEAN)) AS n_truncated FROM events GROUP BY 1""")
def json_paths(spark, d):
    """2.2.7-2.2.9: JSON paths as keys, existence, typed predicates and flags."""
    cut = F.get_json_object(F.concat(F.lit('{"truncated": '), (F.col("value") > 50).cast("string"), F.lit("}")), "$.truncated").cast("boolean")
    k = F.get_json_object("props", "$.k")
    has = F.array_contains(F.json_object_keys("props"), "absent")
    return table(spark, d, "events").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_if(has).alias("n_absent"), F.count_if(F.expr("try_cast(get_json_object(props, '$.k') AS INT) > 50")).alias("n_large"), F.count_if(cut).alias("n_truncated"))


@query(with_domain("SELECT law_id, title, subject, CASE WHEN lower(title) LIKE '%77%' THEN 1 ELSE 2 END AS rank FROM laws WHERE lower(title) LIKE '%77%' OR lower(subject) LIKE '%machin%'"))
def law_search(spark, d, title: str = "77", subject: str = "machin"):
    """2.2.11, 2.2.12: a term in one of several fields, with the rank of the field that matched."""
    by_title, by_subject = F.col("title").ilike(f"%{title}%"), F.col("subject").ilike(f"%{subject}%")
    return laws(spark, d).filter(by_title | by_subject).select("law_id", "title", "subject", F.when(by_title, 1).otherwise(2).alias("rank"))


@query("SELECT doc_id, CASE WHEN source IN (SELECT source FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 2) THEN 'excluded' WHEN length(text) < 150 THEN 'short' ELSE 'kept' END AS outcome FROM documents")
def passage_selection(spark, d, least: int = 150, n_excluded: int = 2):
    """2.2.13-2.2.15: passages of flagged sources go (a left join with a list of fixed length), short ones are marked."""
    docs = table(spark, d, "documents")
    flagged = docs.groupBy("source").count().orderBy(F.col("count").desc(), "source").limit(n_excluded).select("source", F.lit(True).alias("flagged"))
    outcome = F.when(F.col("flagged"), "excluded").when(F.length("text") < least, "short").otherwise("kept")
    return docs.select("doc_id", "source", "text").join(F.broadcast(flagged), "source", "left").select("doc_id", outcome.alias("outcome"))


@query(with_domain("SELECT admission, tier, count(*) AS n, count(*) FILTER (WHERE admission = 'admitted' AND eligible) AS n_publish FROM (SELECT tier, CASE WHEN quantity > 40 OR tier <> 'D' THEN 'admitted' ELSE 'needs_review' END AS admission, tier IN ('A', 'B') AND fact_type <> 'R' AS eligible FROM facts) GROUP BY 1, 2"))
def admission_summary(spark, d):
    """2.2.6, 2.2.16, 2.2.17, 2.4.28, 2.14.8: a fact with a verified span or a tier above D is admitted."""
    spans = F.array(F.struct((F.col("quantity") > 40).alias("verified")))
    rows = facts(spark, d).select("tier", F.when(F.exists(spans, lambda s: s["verified"]) | (F.col("tier") != "D"), "admitted").otherwise("needs_review").alias("admission"), (F.col("tier").isin(tiers_from("B")) & (F.col("fact_type") != "R")).alias("eligible"))
    return rows.groupBy("admission", "tier").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("admission") == "admitted") & F.col("eligible")).alias("n_publish"))


@query(with_domain("v AS (SELECT law_id, count(*) AS n_versions FROM versions GROUP BY 1), f AS (SELECT law_id, count(*) AS n_facts, count(DISTINCT fact_type) > 2 AS all_types FROM facts JOIN versions USING (version_id) GROUP BY 1) SELECT law_id, title, coalesce(n_versions, 0) AS n_versions, coalesce(n_facts, 0) AS n_facts, coalesce(all_types, false) AS all_types FROM laws LEFT JOIN v USING (law_id) LEFT JOIN f USING (law_id)"))
def law_counts(spark, d):
    """2.3.2-2.3.4: left joins with counts, each side aggregated before it joins so that none multiplies the other."""
    v = versions(spark, d)
    per_law = v.groupBy("law_id").agg(F.count(F.lit(1)).alias("n_versions"))
    per_fact = facts(spark, d).join(v, "version_id").groupBy("law_id").agg(F.count(F.lit(1)).alias("n_facts"), (F.count_distinct("fact_type") > 2).alias("all_types"))
    out = laws(spark, d).join(per_law, "law_id", "left").join(per_fact, "law_id", "left")
    return out.select("law_id", "title", *[F.coalesce(c, F.lit(z)).alias(c) for c, z in (("n_versions", 0), ("n_facts", 0), ("all_types", False))])


@query(with_domain("SELECT law_id, 'no_version' AS gap FROM laws WHERE law_id NOT IN (SELECT law_id FROM versions WHERE law_id IS NOT NULL) UNION ALL SELECT law_id, 'open_only' FROM laws WHERE law_id IN (SELECT law_id FROM versions WHERE status = 'O') AND law_id NOT IN (SELECT law_id FROM versions WHERE status <> 'O' AND law_id IS NOT NULL)"))
def law_gaps(spark, d):
    """2.3.5-2.3.9, 2.7.2: anti and semi joins; a null key on the right takes nothing away."""
    v, own = versions(spark, d), laws(spark, d).select("law_id")
    none = own.join(v, "law_id", "left_anti").withColumn("gap", F.lit("no_version"))
    still = own.join(v.filter("status = 'O'"), "law_id", "left_semi").join(v.filter("status <> 'O'"), "law_id", "left_anti").withColumn("gap", F.lit("open_only"))
    return none.unionByName(still)


@query(with_domain("b AS (SELECT s_suppkey AS agent_id, s_nationkey AS target FROM supplier WHERE s_acctbal > 1000) SELECT CASE WHEN target IS NULL THEN 'skipped' WHEN fact_type = 'R' THEN 'excluded' ELSE 'synced' END AS outcome, agent_id, count(*) AS n, max(target) AS target FROM facts LEFT JOIN b USING (agent_id) GROUP BY 1, 2"))
def bridge_split(spark, d):
    """2.3.10, 2.3.20: facts split by a bridge that does not know every key; `dead_letters` replays what it misses."""
    bridge = table(spark, d, "supplier").filter("s_acctbal > 1000").select(F.col("s_suppkey").alias("agent_id"), F.col("s_nationkey").alias("target"))
    outcome = F.when(F.col("target").isNull(), "skipped").when(F.col("fact_type") == "R", "excluded").otherwise("synced")
    return facts(spark, d).join(bridge, "agent_id", "left").groupBy(outcome.alias("outcome"), "agent_id").agg(F.count(F.lit(1)).alias("n"), F.max("target").alias("target"))


@query(with_domain("SELECT tier, fact_type, approved, count(*) AS n FROM facts GROUP BY 1, 2, 3"))
def tier_counts(spark, d):
    """2.4.2, 2.4.27: facts by tier, type and status."""
    return facts(spark, d).groupBy("tier", "fact_type", "approved").agg(F.count(F.lit(1)).alias("n"))


@query(with_domain("b AS (SELECT i AS bucket, i / 10.0 AS lo, (i + 1) / 10.0 AS hi FROM range(10) t(i)) SELECT bucket, count(score) AS n FROM b LEFT JOIN facts ON score >= lo AND score < hi GROUP BY 1"))
def score_histogram(spark, d):
    """2.4.3: ten half-open buckets; a score of 1 is in none. Counted by score first, so the range join is tiny."""
    scores = facts(spark, d).groupBy("score").agg(F.count(F.lit(1)).alias("k"))
    buckets = spark.range(10).select(F.col("id").alias("bucket"), (F.col("id") / 10.0).alias("lo"), ((F.col("id") + 1) / 10.0).alias("hi"))
    held = scores.join(F.broadcast(buckets), (F.col("score") >= F.col("lo")) & (F.col("score") < F.col("hi")))
    return buckets.join(held.groupBy("bucket").agg(F.sum("k").alias("k")), "bucket", "left").select("bucket", F.coalesce("k", F.lit(0)).alias("n"))


@query(with_domain("SELECT agent_id, count(*) FILTER (WHERE tier = 'A') AS a, count(*) FILTER (WHERE tier = 'B') AS b, count(*) FILTER (WHERE tier = 'C') AS c, count(*) FILTER (WHERE tier = 'D') AS d, " + _AVG.format("score") + " AS mean_score FROM facts GROUP BY 1"))
def model_comparison(spark, d):
    """2.4.4: tiers side by side for each producer."""
    counts = [F.count_if(F.col("tier") == t).alias(t.lower()) for t in TIERS]
    return facts(spark, d).groupBy("agent_id").agg(*counts, mean("score").alias("mean_score"))


@query(with_domain(f"SELECT jurisdiction, count(*) AS n, {_AVG.format('score')} AS mean_score, count(DISTINCT version_id) AS n_versions, count(DISTINCT law_id) AS n_laws, coalesce(CAST(sum(CAST(amount AS DECIMAL(18,4))) AS DOUBLE), 0) AS amount FROM {_SERVED} GROUP BY 1"))
def jurisdiction_summary(spark, d):
    """2.4.5-2.4.8: counts, means and distinct counts for each jurisdiction."""
    return served(spark, d).groupBy("jurisdiction").agg(F.count(F.lit(1)).alias("n"), mean("score").alias("mean_score"), F.count_distinct("version_id").alias("n_versions"), F.count_distinct("law_id").alias("n_laws"), F.coalesce(F.sum(exact("amount")).cast("double"), F.lit(0.0)).alias("amount"))


@query("SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, max(value) AS longest, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY 1")
def latency(spark, d, shares=(0.5, 0.95), cells: int = 1000):
    """2.4.9, 2.13.9: exact percentiles over the last 24 hours of the log. Values are counted first and laid into cells of equal
    width; only the cells that hold a wanted rank are ordered, so no type's values are held together."""
    from pyspark.sql import Window

    events = table(spark, d, "events")
    last = events.agg((F.max("ts") - F.expr("INTERVAL 24 HOURS")).alias("since"))  # one row
    recent = events.join(F.broadcast(last), F.col("ts") >= F.col("since"))
    spans = recent.groupBy("event_type").agg(F.min("value").alias("least"), F.max("value").alias("longest"), F.count("value").alias("known"), F.count(F.lit(1)).alias("n"))
    counts = recent.filter("value IS NOT NULL").groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("k")).join(spans, "event_type")
    cell = F.when(F.col("least") == F.col("longest"), 0).otherwise(F.least(F.floor((F.col("value") - F.col("least")) / (F.col("longest") - F.col("least")) * cells), F.lit(cells - 1)))
    counts = counts.withColumn("cell", cell)
    before = Window.partitionBy("event_type").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("event_type", "cell", "known").agg(F.sum("k").alias("size")).withColumn("ahead", F.coalesce(F.sum("size").over(before), F.lit(0)))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor((F.col("known") - 1) * p), F.ceil((F.col("known") - 1) * p)) for p in shares])))
    wanted = sums.filter(F.exists(ranks, lambda r: (r >= F.col("ahead")) & (r < F.col("ahead") + F.col("size")))).select("event_type", "cell", "ahead")
    upto = F.sum("k").over(Window.partitionBy("event_type", "cell").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counts.join(wanted, ["event_type", "cell"]).withColumn("upto", F.col("ahead") + upto)
    at = lambda rank: F.max(F.when((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("k")), F.col("value")))
    exact_rank = lambda p: (F.col("known") - 1) * p
    names = [f"p{int(p * 100)}" for p in shares]
    found = placed.groupBy("event_type").agg(*[at(F.floor(exact_rank(p))).alias(n + "_lo") for n, p in zip(names, shares)], *[at(F.ceil(exact_rank(p))).alias(n + "_hi") for n, p in zip(names, shares)])
    between = lambda n, p: F.col(n + "_lo") + (F.col(n + "_hi") - F.col(n + "_lo")) * (exact_rank(p) - F.floor(exact_rank(p)))
    return spans.join(found, "event_type", "left").select("event_type", *[between(n, p).alias(n) for n, p in zip(names, shares)], "longest", "n")


@query(with_domain("SELECT law_id, version_id, status, weight, row_number() OVER (PARTITION BY CASE status WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END ORDER BY weight, version_id) AS place FROM versions QUALIFY place <= 20"))
def review_queue(spark, d, limit: int = 20):
    """2.5.9, 2.6.3: lowest scores first within bands of priority; only `limit` rows of a band leave their task."""
    from pyspark.sql import Window

    band = F.when(F.col("status") == "P", 1).when(F.col("status") == "O", 2).otherwise(3)
    place = F.row_number().over(Window.partitionBy(band).orderBy("weight", "version_id"))
    return versions(spark, d).withColumn("place", place).filter(F.col("place") <= limit).select("law_id", "version_id", "status", "weight", "place")


@query("SELECT event_id, CAST(ts AS VARCHAR) AS at, event_type FROM events WHERE event_type IN ('error', 'signup') ORDER BY ts DESC, event_id LIMIT 50 OFFSET 100")
def event_page(spark, d, offset: int = 100, limit: int = 50):
    """2.6.4-2.6.6: a page of the log, latest first, filtered by type."""
    rows = table(spark, d, "events").filter(F.col("event_type").isin("error", "signup")).orderBy(F.col("ts").desc_nulls_last(), "event_id").offset(offset).limit(limit)
    return rows.select("event_id", F.col("ts").cast("string").alias("at"), "event_type")


@query(with_domain("p AS (SELECT law_id, title FROM laws ORDER BY title, law_id LIMIT 30 OFFSET 30) SELECT law_id, title, count(version_id) AS n_versions, max(weight) AS top FROM p LEFT JOIN versions USING (law_id) GROUP BY 1, 2"))
def law_page(spark, d, offset: int = 30, limit: int = 30):
    """2.6.8: the page first, `limit` rows whatever the data; the versions are cut down to its laws before they are joined and counted."""
    page = laws(spark, d).select("law_id", "title").orderBy("title", "law_id").offset(offset).limit(limit)
    own = versions(spark, d).select("law_id", "version_id", "weight").join(F.broadcast(page.select("law_id")), "law_id", "left_semi")
    return page.join(own, "law_id", "left").groupBy("law_id", "title").agg(F.count("version_id").alias("n_versions"), F.max("weight").alias("top"))


@query(with_domain("l AS (SELECT lower(title) AS k, law_id FROM laws WHERE balance >= 0), r AS (SELECT lower(c_name) AS k, c_custkey AS other FROM customer WHERE c_mktsegment <> 'BUILDING') SELECT CASE WHEN law_id IS NULL THEN 'only_right' WHEN other IS NULL THEN 'only_left' ELSE 'matched' END AS presence, count(*) AS n FROM l FULL JOIN r USING (k) GROUP BY 1"))
def tracker_presence(spark, d):
    """2.7.3: two trackers matched by normalised title; what each has alone."""
    left = laws(spark, d).filter("balance >= 0").select(F.lower("title").alias("k"), "law_id")
    right = table(spark, d, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.lower("c_name").alias("k"), F.col("c_custkey").alias("other"))
    presence = F.when(F.col("law_id").isNull(), "only_right").when(F.col("other").isNull(), "only_left").otherwise("matched")
    return left.join(right, "k", "full").groupBy(presence.alias("presence")).agg(F.count(F.lit(1)).alias("n"))
