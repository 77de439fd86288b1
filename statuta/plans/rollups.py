"""Rollups, windows, sets, versions and dependencies (inventory 2.4, 2.5, 2.7, 2.8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..registry import query
from ..sources.tables import exact, facts, laws, mean, table, versions, with_domain

_MEAN = "CAST(sum(CAST({0} AS DECIMAL(18,4))) AS DOUBLE) / count({0})"
_BY_LAW = "facts JOIN versions USING (version_id)"
DEPTH = 5


@query(with_domain(f"""SELECT law_id, bool_or(approved) AS any_approved, max(amount) FILTER (WHERE amount > 0) AS top_penalty, min(quantity) FILTER (WHERE quantity > 5) AS least_days,
array_to_string(list_sort(list(DISTINCT fact_type)), ',') AS types, count(*) AS n, count(DISTINCT amount) > 1 AS several_amounts, array_to_string(list_sort(list(DISTINCT part_id))[1:100], ',') AS sample FROM {_BY_LAW} GROUP BY 1"""))
def law_rollup(spark, d):
    """2.4.15-2.4.17, 2.4.33, 2.12.11: flags, extremes and unions for each law; arrays are sorted."""
    rows = facts(spark, d).join(versions(spark, d), "version_id")
    first = lambda *by: F.row_number().over(Window.partitionBy("law_id", *by).orderBy("part_id"))
    # the first 100 of each of 64 cells, and the first 100 of those: no law's parts are ordered in one task
    parts = rows.select("law_id", "part_id").distinct().withColumn("cell", F.pmod(F.xxhash64("part_id"), F.lit(64))).withColumn("place", first("cell")).filter("place <= 100")
    parts = parts.drop("place").withColumn("place", first()).filter("place <= 100")
    sample = parts.groupBy("law_id").agg(F.array_join(F.sort_array(F.collect_list("part_id")), ",").alias("sample"))
    flags = rows.groupBy("law_id").agg(
        F.bool_or("approved").alias("any_approved"), F.max(F.when(F.col("amount") > 0, F.col("amount"))).alias("top_penalty"), F.min(F.when(F.col("quantity") > 5, F.col("quantity"))).alias("least_days"),
        F.array_join(F.sort_array(F.collect_set("fact_type")), ",").alias("types"), F.count(F.lit(1)).alias("n"), F.coalesce(F.min("amount") < F.max("amount"), F.lit(False)).alias("several_amounts"),
    )
    return flags.join(sample, "law_id")


@query(with_domain(f"""SELECT law_id, fact_type, agent_id, count(*) AS members, {_MEAN.format('score')} AS mean_score, CAST(min(fact_date) AS VARCHAR)[1:10] AS earliest, arg_min(part_id, (fact_date, part_id)) AS first_part FROM {_BY_LAW} GROUP BY 1, 2, 3"""))
def concepts(spark, d):
    """2.4.20, 2.4.13: facts of a law grouped into concepts by type and actor, with their mean, earliest deadline and first member."""
    rows = facts(spark, d).join(versions(spark, d), "version_id")
    first = F.min(F.struct("fact_date", "part_id"))
    return rows.groupBy("law_id", "fact_type", "agent_id").agg(F.count(F.lit(1)).alias("members"), mean("score").alias("mean_score"), F.date_format(F.min("fact_date"), "yyyy-MM-dd").alias("earliest"), first["part_id"].alias("first_part"))


@query(with_domain("""t AS (SELECT version_id, list(DISTINCT fact_type) AS got FROM facts GROUP BY 1)
SELECT version_id, coalesce(len(got), 0) AS n_types, array_to_string(list_sort(list_filter(['A', 'N', 'R'], lambda x: NOT list_contains(coalesce(got, []), x))), ',') AS missing,
round(100.0 * coalesce(len(got), 0) / 3, 1)::DOUBLE AS percent FROM versions LEFT JOIN t USING (version_id)"""))
def coverage(spark, d):
    """2.4.11, 2.4.22, 2.4.23, 2.6.7: which expected types a version lacks, the least covered first."""
    got = facts(spark, d).groupBy("version_id").agg(F.collect_set("fact_type").alias("got"))
    have = F.coalesce("got", F.array().cast("array<string>"))
    rows = versions(spark, d).select("version_id").join(got, "version_id", "left")
    expected = F.array(*map(F.lit, "ANR"))
    return rows.select("version_id", F.size(have).cast("long").alias("n_types"), F.array_join(F.array_except(expected, have), ",").alias("missing"), F.round(100.0 * F.size(have) / 3, 1).alias("percent")).orderBy("percent", "version_id")


@query("""WITH s AS (SELECT doc_id, quality = 1 AS truth, length(text) > 200 AS said, lang FROM documents JOIN labels USING (doc_id)),
c AS (SELECT lang, count(*) FILTER (WHERE truth AND said) AS tp, count(*) FILTER (WHERE NOT truth AND said) AS fp, count(*) FILTER (WHERE truth AND NOT said) AS fn FROM s GROUP BY 1)
SELECT lang, tp, fp, fn, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END::DOUBLE AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END::DOUBLE AS recall, CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END::DOUBLE AS f1,
(SELECT avg(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END)::DOUBLE FROM c) AS macro_f1 FROM c""")
def evaluation(spark, d):
    """2.4.31: precision, recall and F1 by field, with zero for an empty denominator, and the mean of F1 over fields."""
    rows = table(spark, d, "documents").select("doc_id", "lang", (F.length("text") > 200).alias("said")).join(table(spark, d, "labels"), "doc_id")
    truth, said = F.col("quality") == 1, F.col("said")
    c = rows.groupBy("lang").agg(F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"), F.count_if(truth & ~said).alias("fn"))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    each = c.select("lang", "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))
    return each.join(F.broadcast(each.agg(F.avg("f1").alias("macro_f1"))))  # one row


@query(with_domain("""o AS (SELECT version_id FROM versions WHERE status = 'O' UNION ALL SELECT version_id FROM versions WHERE weight > 200000)
SELECT CASE WHEN n IS NULL THEN 'residual' WHEN n > 1 THEN 'double' ELSE 'once' END AS outcome, count(*) AS n_versions FROM versions LEFT JOIN (SELECT version_id, count(*) AS n FROM o GROUP BY 1) USING (version_id) GROUP BY 1"""))
def ledger(spark, d):
    """2.4.29: every selected row belongs into exactly one outcome; what is in none, or in two."""
    v = versions(spark, d)
    n = v.filter("status = 'O'").select("version_id").unionByName(v.filter("weight > 200000").select("version_id")).groupBy("version_id").agg(F.count(F.lit(1)).alias("n"))
    outcome = F.when(F.col("n").isNull(), "residual").when(F.col("n") > 1, "double").otherwise("once")
    return v.join(n, "version_id", "left").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n_versions"))


@query("""WITH g AS (SELECT *, count(*) OVER w AS copies, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity DESC, l_partkey, l_extendedprice, l_shipdate) AS place FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber))
SELECT l_orderkey, l_linenumber, l_partkey AS kept_part, copies - 1 AS agreeing FROM g WHERE place = 1 AND copies > 1""")
def duplicate_facts(spark, d):
    """2.4.35, 2.4.36, 2.5.1-2.5.3, 2.5.6: groups of equal key, their preferred member, and how many agree with it."""
    key = Window.partitionBy("l_orderkey", "l_linenumber")
    place = F.row_number().over(key.orderBy(F.col("l_quantity").desc(), "l_partkey", "l_extendedprice", "l_shipdate"))
    rows = table(spark, d, "lineitem").withColumn("copies", F.count(F.lit(1)).over(key)).withColumn("place", place)
    return rows.filter("place = 1 AND copies > 1").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("kept_part"), (F.col("copies") - 1).alias("agreeing"))


@query("""SELECT conv_id, turn, sum(length(text) + 4) OVER p <= 400 OR row_number() OVER p = 1 AS fits, lag(role) OVER p AS before, lead(role) OVER p AS after,
array_to_string(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), ' ') AS around, (row_number() OVER p - 1) // 3 AS chunk
FROM conversations WINDOW p AS (PARTITION BY conv_id ORDER BY turn)""")
def passage_windows(spark, d):
    """2.5.5, 2.5.8, 2.8.7: neighbours of a passage, a running budget of characters, chunks of three."""
    p = Window.partitionBy("conv_id").orderBy("turn")
    upto, near = p.rowsBetween(Window.unboundedPreceding, 0), p.rowsBetween(-1, 1)
    rows = table(spark, d, "conversations").withColumn("place", F.row_number().over(p))
    fits = (F.sum(F.length("text") + 4).over(upto) <= 400) | (F.col("place") == 1)
    return rows.select("conv_id", "turn", fits.alias("fits"), F.lag("role").over(p).alias("before"), F.lead("role").over(p).alias("after"), F.array_join(F.collect_list("role").over(near), " ").alias("around"), F.floor((F.col("place") - 1) / 3).alias("chunk"))


@query(with_domain("""h AS (SELECT law_id, version_id, effective, status, row_number() OVER (PARTITION BY law_id ORDER BY effective DESC, version_id DESC) AS back, count(*) OVER (PARTITION BY law_id) AS n,
lag(version_id) OVER (PARTITION BY law_id ORDER BY effective, version_id) AS predecessor FROM versions) SELECT law_id, version_id AS head, status, n AS n_versions, predecessor FROM h WHERE back = 1"""))
def version_heads(spark, d):
    """2.8.8, 2.5.4: the version of each law that no other one follows; one aggregate, without ordering a law's versions."""
    v = versions(spark, d)
    keyed = F.struct("effective", "version_id", "status")
    top = v.groupBy("law_id").agg(F.max(keyed).alias("top"), F.count(F.lit(1)).alias("n"))
    earlier = v.join(top.select("law_id", F.col("top.version_id").alias("head")), "law_id").filter("version_id <> head").groupBy("law_id").agg(F.max(keyed)["version_id"].alias("predecessor"))
    return top.join(earlier, "law_id", "left").select("law_id", F.col("top.version_id").alias("head"), F.col("top.status").alias("status"), F.col("n").alias("n_versions"), "predecessor")


def edges(spark, d) -> DataFrame:
    """parent, child: parts supplied together, larger key below the smaller half of it; valid, distinct, no self loops."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("child"))
    found = p.withColumn("parent", F.expr("child DIV 3")).filter("parent <> child")
    known = p.select(F.col("child").alias("parent"))
    return found.join(known, "parent", "left_semi").dropDuplicates(["parent", "child"])


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT p_partkey // 3 AS parent, p_partkey AS child FROM part WHERE p_partkey // 3 <> p_partkey AND p_partkey // 3 IN (SELECT p_partkey FROM part)),
t AS (SELECT child AS root, child AS node, 0 AS depth FROM e UNION ALL SELECT root, e.child, depth + 1 FROM t JOIN e ON e.parent = t.node WHERE depth < {DEPTH})
SELECT root, depth, count(*) AS n, sum(node)::BIGINT AS nodes FROM t GROUP BY 1, 2""")
def dependency_tree(spark, d, depth: int = DEPTH):
    """2.8.5, 2.8.6, 2.7.1: a walk of bounded depth from every child of a checked edge, one join a level; there are at most
    ten levels, and as a node has one parent, at most so many rows a node."""
    e = edges(spark, d)
    level = e.select(F.col("child").alias("root"), F.col("child").alias("node"), F.lit(0).alias("depth"))
    found = level
    for k in range(1, min(depth, 10) + 1):
        level = level.join(e, level["node"] == e["parent"]).select("root", F.col("child").alias("node"), F.lit(k).alias("depth"))
        found = found.unionByName(level)
    return found.groupBy("root", "depth").agg(F.count(F.lit(1)).alias("n"), F.sum("node").alias("nodes"))


# The statuses that may follow each status; those without any end a law's course.
NEXT = {
    "introduced": ("pending", "passed_one_chamber", "enacted", "active", "dead", "vetoed", "withdrawn"),
    "pending": ("passed_one_chamber", "enacted", "active", "dead", "vetoed", "withdrawn"),
    "passed_one_chamber": ("enacted", "active", "future_effective", "dead", "vetoed", "withdrawn"),
    "enacted": ("active", "future_effective", "repealed", "stayed"),
    "future_effective": ("active", "repealed", "stayed"),
    "active": ("repealed", "stayed"),
    "repealed": (),
    "stayed": ("active", "repealed"),
    "vetoed": (),
    "dead": ("introduced", "pending"),
    "withdrawn": ("introduced", "pending"),
}
_STATUSES = list(NEXT)
#: Two trackers tell a status, the first one where it tells any.
_TOLD = "coalesce(CASE WHEN p_partkey % 3 > 0 THEN ({0})[p_size % 11 + 1] END, CASE WHEN p_partkey % 5 > 0 THEN ({0})[p_partkey % 11 + 1] END)"


@query(f"""WITH s AS (SELECT p_partkey, ({_STATUSES})[p_partkey * 7 % 11 + 1] AS status, {_TOLD.format(_STATUSES)} AS told FROM part), n(status, told) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, then in NEXT.items() for b in then)})
SELECT p_partkey, status, told, CASE WHEN told IS NULL OR told = status THEN 'unchanged' WHEN (status, told) IN (SELECT (status, told) FROM n) THEN 'changed' ELSE 'refused' END AS outcome FROM s""")
def transitions(spark, d):
    """2.8.10: what two trackers tell of a law's status, the first before the second, and whether the automaton allows the change."""
    names = F.array(*map(F.lit, _STATUSES))
    place = lambda e: F.element_at(names, F.expr(e).cast("int"))
    told = F.coalesce(F.when(F.expr("p_partkey % 3 > 0"), place("p_size % 11 + 1")), F.when(F.expr("p_partkey % 5 > 0"), place("p_partkey % 11 + 1")))
    rows = table(spark, d, "part").select("p_partkey", place("p_partkey * 7 % 11 + 1").alias("status"), told.alias("told"))
    allowed = F.create_map(*[x for a, then in NEXT.items() for x in (F.lit(a), F.array(*map(F.lit, then)).cast("array<string>"))])
    outcome = F.when(F.col("told").isNull() | (F.col("told") == F.col("status")), "unchanged").when(F.array_contains(allowed[F.col("status")], F.col("told")), "changed").otherwise("refused")
    return rows.select("p_partkey", "status", "told", outcome.alias("outcome"))


@query(with_domain("""v AS (SELECT law_id, count(*) AS n, bool_or(status = 'O') AS open, max((effective, version_id, status)) AS head FROM versions GROUP BY 1), m AS (SELECT law_id, modality, count(*) AS k FROM versions GROUP BY 1, 2), l AS (SELECT law_id, string_agg('{"modality":"' || modality || '","n":' || k || '}', ',' ORDER BY modality) AS items FROM m GROUP BY 1),
c AS (SELECT *, [CASE WHEN n IS NULL THEN 'no_version' END, CASE WHEN open IS NOT TRUE THEN 'not_open' END, CASE WHEN balance < 0 THEN 'negative' END] AS g FROM laws LEFT JOIN v USING (law_id) LEFT JOIN l USING (law_id))
SELECT law_id, '{"title":"' || title || '","n_versions":' || coalesce(n, 0) || CASE WHEN n IS NULL THEN '' ELSE ',"head":{"version_id":' || head[2] || ',"status":"' || head[3] || '"}' END || ',"modalities":[' || coalesce(items, '') || '],"gaps":[' || array_to_string(list_transform(list_filter(g, lambda x: x IS NOT NULL), lambda x: '"' || x || '"'), ',') || '],"provenance":{"source":"versions","key":' || law_id || '}}' AS card,
array_to_string(list_filter(g, lambda x: x IS NOT NULL), ',') AS gaps FROM c"""))
def law_cards(spark, d):
    """2.8.16, 2.8.18, 2.12.10: a nested JSON document for each law, with its head, its modalities, where it comes from, and tags for
    what it lacks. Versions are counted by modality first, of which there are few, so no card holds all of a law's versions."""
    v = versions(spark, d)
    head = F.max(F.struct("effective", "version_id", "status"))
    own = v.groupBy("law_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("status") == "O").alias("open"), head.alias("h"))
    kinds = v.groupBy("law_id", "modality").agg(F.count(F.lit(1)).alias("n")).groupBy("law_id").agg(F.sort_array(F.collect_list(F.struct("modality", "n"))).alias("modalities"))
    rows = laws(spark, d).join(own, "law_id", "left").join(kinds, "law_id", "left")
    gaps = F.array_compact(F.array(F.when(F.col("n").isNull(), "no_version"), F.when(~F.coalesce("open", F.lit(False)), "not_open"), F.when(F.col("balance") < 0, "negative")))
    latest = F.when(F.col("n").isNotNull(), F.struct(F.col("h.version_id").alias("version_id"), F.col("h.status").alias("status")))
    origin = F.struct(F.lit("versions").alias("source"), F.col("law_id").alias("key"))
    none = F.array().cast(kinds.schema["modalities"].dataType)
    card = F.to_json(F.struct("title", F.coalesce("n", F.lit(0)).alias("n_versions"), latest.alias("head"), F.coalesce("modalities", none).alias("modalities"), gaps.alias("gaps"), origin.alias("provenance")))
    return rows.select("law_id", card.alias("card"), F.array_join(gaps, ",").alias("gaps"))


@query("""WITH f AS (SELECT sha256(coalesce(text, '')) AS key, doc_id FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY key) AS worked_on, count(*) OVER (PARTITION BY key) AS shared_by FROM f""")
def work_by_content(spark, d):
    """2.7.5: work is done once for each content and fanned out; counted before the join, so copies do not meet."""
    rows = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))
    once = rows.groupBy("key").agg(F.min("doc_id").alias("worked_on"), F.count(F.lit(1)).alias("shared_by"))
    return rows.join(once, "key").select("doc_id", "worked_on", "shared_by")


@query(with_domain(f"""SELECT modality, coalesce(sum(CAST(weight AS DECIMAL(18,4)))::DOUBLE, 0) AS weight, {_MEAN.format('weight')} AS mean_weight, coalesce(max(version_id) FILTER (WHERE version_id < 1000000), 0) AS high_water,
count(*) FILTER (WHERE status = 'P') AS pending, CASE WHEN count(*) FILTER (WHERE status = 'P') * 20 > count(*) THEN 'lagging' ELSE 'healthy' END AS alert,
CASE WHEN modality LIKE '5%' THEN 'export_snapshot' WHEN count(DISTINCT status) > 2 AND modality LIKE '1%' THEN 'event_queue' WHEN count(*) > 100000 THEN 'api_pull' ELSE 'direct_db' END AS advice FROM versions GROUP BY 1"""))
def sync_health(spark, d):
    """2.4.14, 2.4.30, 2.11.23: totals, high-water marks, alerts by threshold, and how to sync: a snapshot where the target is
    out of reach, a queue for several consumers, a pull above 100,000 rows."""
    reachable, several = ~F.col("modality").startswith("5"), F.col("modality").startswith("1") & (F.count_distinct("status") > 2)
    pending, n = F.count_if(F.col("status") == "P"), F.count(F.lit(1))
    return versions(spark, d).groupBy("modality").agg(
        F.coalesce(F.sum(exact("weight")).cast("double"), F.lit(0.0)).alias("weight"), mean("weight").alias("mean_weight"), F.coalesce(F.max(F.when(F.col("version_id") < 1_000_000, F.col("version_id"))), F.lit(0)).alias("high_water"),
        pending.alias("pending"), F.when(pending * 20 > n, "lagging").otherwise("healthy").alias("alert"),
        F.when(~reachable, "export_snapshot").when(several, "event_queue").when(n > 100_000, "api_pull").otherwise("direct_db").alias("advice"),
    )
