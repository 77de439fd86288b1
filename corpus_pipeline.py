"""A corpus from raw documents to token ids: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statuta.llm import exact_dedup, mixing, near_copies, sp_transducer, toxicity
from statuta.llm.common import made_so_far, new_folder, removed, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sp_transducer.encoded(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: The classifier and the transducer cannot be said in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written before the next one reads it; then what the stage left behind is removed, so that only
    the last of these tables stays, which the result is read from."""
    docs, began = table(spark, sf_dir, "documents"), made_so_far()
    for _, stage in STAGES[:-1]:
        found, path = stage(spark, docs, sf_dir), new_folder(spark)
        found.write.parquet(path)
        docs = spark.read.parquet(path)
        removed(spark, began, kept=path)
    return STAGES[-1][1](spark, docs, sf_dir)
