"""Verification of facts against their passages, again only where something changed (inventory 2.14.5).

A stamp holds what a pass found about a fact, under a fingerprint of the fact, of its passage's content key, of its law's sections and
of the version of the rules. The next pass compares fingerprints, which needs no text, keeps the stamps that still hold, and sends the other facts
alone through all checks, in one plan: the quote, the number, the section cited. Passages are stored in BUCKETS folders, and only
those of changed facts are read; where nothing changed, no text is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.checks import quoted_in
from ..functions.citations import plain_citation
from ..functions.text import content_key, strip
from .matching import answered
from .steps import Steps

#: To be raised whenever a check below changes: all stamps are then made anew.
RULES = 1
BUCKETS = 32
CHECKS = ("quote_found", "number_found", "section", "section_how")


def bucket_of(passage: Column) -> Column:
    return F.pmod(F.xxhash64(passage), F.lit(BUCKETS)).cast("int")


def store_passages(passages: DataFrame, path: str) -> None:
    """passage_id, law, path, text, as a table in buckets with each text's content key, so that later passes need not read texts to
    see whether they are the same."""
    rows = passages.select("passage_id", "law", "path", "text", content_key(F.coalesce("text", F.lit("")), 64).alias("key"), bucket_of(F.col("passage_id")).alias("bucket"))
    rows.write.partitionBy("bucket").parquet(path)


def fingerprints(facts: DataFrame, stored: DataFrame) -> DataFrame:
    """`facts` (fact_id, passage_id, quote, number, cited) with law, bucket and fingerprint."""
    # a law's sections count as one: their paths and places, by a sum that does not hang on their order
    laws = stored.groupBy(F.col("law").alias("_law")).agg(F.sum(F.xxhash64("passage_id", "path").cast("decimal(20,0)")).alias("_sections"))
    of = stored.select(F.col("passage_id").alias("_p"), F.col("law"), "key", "bucket")
    rows = facts.join(of, facts["passage_id"] == F.col("_p"), "left").drop("_p").join(laws, F.col("law").eqNullSafe(F.col("_law")), "left").drop("_law")
    said = F.to_json(F.struct("passage_id", "quote", "number", "cited", "key", F.col("_sections").cast("string").alias("sections"), F.lit(RULES).alias("rules")))
    return rows.withColumn("fingerprint", F.sha2(said, 256)).drop("key", "_sections")


def checked(facts: DataFrame, passages: DataFrame, sections: DataFrame) -> DataFrame:
    """All checks of the given facts: `passages` holds their texts, `sections` (block, place, path) all sections."""
    texts = passages.select(F.col("passage_id").alias("_p"), "text")
    rows = facts.join(texts, facts["passage_id"] == F.col("_p"), "left").drop("_p")
    number = F.nullif(strip(F.coalesce("number", F.lit(""))), F.lit(""))
    whole = F.array_contains(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[0-9]+"), F.lit(0)), number)
    rows = rows.select("fact_id", "law", "fingerprint", quoted_in(F.coalesce("text", F.lit("")), F.col("quote")).alias("quote_found"), F.when(number.isNotNull(), F.coalesce(whole, F.lit(False))).alias("number_found"), F.coalesce(plain_citation(F.col("cited")), F.lit("")).alias("_ref"))
    asked = rows.select(F.col("law").alias("block"), F.col("_ref").alias("ref"))
    found = answered(asked, sections.join(asked.select("block").distinct(), "block", "left_semi")).select(F.col("block").alias("_b"), F.col("ref").alias("_r"), F.col("place").alias("section"), F.col("how").alias("section_how"))
    return rows.join(found, (F.col("law") == F.col("_b")) & (F.col("_ref") == F.col("_r")), "left").select("fact_id", "fingerprint", *CHECKS)


def verification_pass(spark: SparkSession, facts: DataFrame, path: str, stamps: DataFrame | None = None) -> tuple[DataFrame, int]:
    """(a stamp for each fact, how many of them are new). `stamps` are those of the last pass; facts that are gone lose theirs.
    The result is written by the caller, once."""
    stored, steps = spark.read.parquet(path), Steps(spark)
    now = fingerprints(facts, stored)
    if stamps is None:
        changed, kept = now, None
    else:
        old = stamps.select("fact_id", "fingerprint", *CHECKS)
        kept = old.join(now.select("fact_id", "fingerprint"), ["fact_id", "fingerprint"], "left_semi")
        changed = now.join(old.select("fact_id", "fingerprint"), ["fact_id", "fingerprint"], "left_anti")
    changed = steps.written("changed", changed)
    n = changed.count()
    if kept is not None and n == 0:
        return kept, 0
    # at most BUCKETS numbers; a partition filter, so other folders are not opened
    buckets = [r.bucket for r in changed.select("bucket").distinct().collect() if r.bucket is not None]
    texts = stored.filter(F.col("bucket").isin(buckets)).select("passage_id", "text")
    sections = stored.select(F.col("law").alias("block"), F.col("passage_id").alias("place"), plain_citation(F.coalesce("path", F.lit(""))).alias("path"))
    new = checked(changed, texts, sections)
    return (new if kept is None else kept.unionByName(new)), n
