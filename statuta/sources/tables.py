"""Readers, and the test tables as the domain's tables.

nation + region: jurisdictions; customer: laws (document families); orders: versions of a law; lineitem: facts taken from a
version; documents: passages; events: the pipeline's log; conversations: dependency edges from turn to turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TIERS = ("A", "B", "C", "D")
#: Lowest score of tiers A, B and C: fixed values.
TIER_FLOORS = (0.85, 0.70, 0.50)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Narrow rows of few, small files dealt to all cores, for work that takes long for each: a file of a few MB is one task otherwise."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)


def exact(c: Column | str) -> Column:
    """As a decimal, so that sums do not hang on the order of rows."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,4)")


def mean(c: Column | str) -> Column:
    return F.sum(exact(c)).cast("double") / F.count(exact(c))


def tier_of(score: Column) -> Column:
    a, b, c = TIER_FLOORS
    return F.when(score >= a, "A").when(score >= b, "B").when(score >= c, "C").otherwise("D")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """version_id, fact_type, approved, score, tier, amount, quantity, fact_date; the score is a discount scaled to 0-1."""
    score = F.floor(F.col("l_discount") * 100 + 0.5) / 10
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("fact_type"), (F.col("l_linestatus") == "F").alias("approved"), score.alias("score"), tier_of(score).alias("tier"),
        F.col("l_extendedprice").alias("amount"), F.col("l_quantity").alias("quantity"), F.col("l_shipdate").alias("fact_date"), F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("agent_id"),
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("law_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("weight"), F.col("o_orderdate").alias("effective"), F.col("o_orderpriority").alias("modality"))


def laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("law_id"), F.col("c_name").alias("title"), F.col("c_nationkey").alias("jurisdiction_id"), F.col("c_mktsegment").alias("subject"), F.col("c_acctbal").alias("balance"))


def jurisdictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").alias("jurisdiction_id"), F.col("n_name").alias("jurisdiction"), F.col("r_name").alias("region_name"))


def tier_sql(score: str) -> str:
    a, b, c = TIER_FLOORS
    return f"CASE WHEN {score} >= {a} THEN 'A' WHEN {score} >= {b} THEN 'B' WHEN {score} >= {c} THEN 'C' ELSE 'D' END"


#: The same as DuckDB views, for `WITH` clauses of the oracle.
SQL = f"""
facts AS (SELECT *, {tier_sql("score")} AS tier FROM
  (SELECT l_orderkey AS version_id, l_linenumber AS line, l_returnflag AS fact_type, l_linestatus = 'F' AS approved, floor(l_discount * 100 + 0.5) / 10 AS score,
          l_extendedprice AS amount, l_quantity AS quantity, l_shipdate AS fact_date, l_partkey AS part_id, l_suppkey AS agent_id FROM lineitem)),
versions AS (SELECT o_orderkey AS version_id, o_custkey AS law_id, o_orderstatus AS status, o_totalprice AS weight, o_orderdate AS effective, o_orderpriority AS modality FROM orders),
laws AS (SELECT c_custkey AS law_id, c_name AS title, c_nationkey AS jurisdiction_id, c_mktsegment AS subject, c_acctbal AS balance FROM customer),
jurisdictions AS (SELECT n_nationkey AS jurisdiction_id, n_name AS jurisdiction, r_name AS region_name FROM nation JOIN region ON n_regionkey = r_regionkey)
"""


def with_domain(sql: str) -> str:
    """`sql`, a SELECT or a list of CTEs ending in one, over the domain's tables."""
    return f"WITH {SQL.strip()}\n{sql}" if sql.lstrip().upper().startswith("SELECT") else f"WITH {SQL.strip()},\n{sql}"
