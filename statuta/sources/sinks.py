"""Keyed sinks without a transactional table: what a target becomes, as a DataFrame, and versions of it on disk (inventory 2.1.25,
2.1.28, 2.1.29, 2.8.14, 2.8.15, 2.13.3, 2.13.4)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows of a batch: a fixed value.
BATCH = 500


def _lacking(rows: DataFrame, others: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose keys no other row has; null keys are equal to each other."""
    theirs = others.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    return rows.join(theirs, reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), "left_anti")


def _one_each(rows: DataFrame, keys: Sequence[str], order: Sequence[str], pick: Callable) -> DataFrame:
    """One row a key, by `order` and then by all columns, so that the same rows give the same row."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(*keys).agg(pick(whole, F.struct(*order, whole)).alias("__row")).select("__row.*").select(*rows.columns)


def first_write(target: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The target with those incoming rows whose keys it lacks, of each key the first by `order`: on conflict, nothing happens.
    Null is a key like any other. Writing twice changes nothing. `order` may name columns that the target does not have."""
    return target.unionByName(_lacking(_one_each(incoming, keys, order, F.min_by), target, keys).select(*target.columns))


def last_write(target: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The target with incoming rows in place of those with equal keys, of each key the last by `order`. Null is a key like any
    other. Writing twice changes nothing."""
    newest = _one_each(incoming, keys, order, F.max_by)
    return _lacking(target, newest, keys).unionByName(newest.select(*target.columns))


def without(tables: dict[str, DataFrame], root: str, gone: DataFrame, links: Sequence[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """All tables without the rows of `root` in `gone` and what hangs on them. links: (parent, parent's key, child, child's
    column), parents first; one anti join a link."""
    out, lost = dict(tables), {root: tables[root].join(gone, gone.columns, "left_semi")}
    out[root] = tables[root].join(gone, gone.columns, "left_anti")
    for parent, key, child, column in links:
        if parent in lost:
            ids = lost[parent].select(F.col(key).alias(column)).distinct()
            lost[child] = out[child].join(ids, column, "left_semi")
            out[child] = out[child].join(ids, column, "left_anti")
    return out


def merged(parents: DataFrame, children: DataFrame, preferred: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Duplicates (`preferred`: old, new) taken together: children point to the preferred parent, the other parents go."""
    moved = children.join(preferred.withColumnRenamed("old", key), key, "left").withColumn(key, F.coalesce("new", key)).select(*children.columns)
    return parents.join(preferred.select(F.col("old").alias(key)), key, "left_anti"), moved


def split_known(rows: DataFrame, known: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with a partner, rows without one: the dead letters)."""
    partners = known.select(*keys).distinct()
    return rows.join(partners, list(keys), "left_semi"), rows.join(partners, list(keys), "left_anti")


def write_version(table: DataFrame, path: str, run: str) -> str:
    """A table as a version of its own; readers take the version that they are told, so a lost job leaves the others whole."""
    out = f"{path}/run={run}"
    table.write.mode("errorifexists").parquet(out)
    return out


def copy_tables(spark: SparkSession, read: Callable[[str], DataFrame], write: Callable[[str, DataFrame], None], order: Sequence[str], batch: int = BATCH) -> None:
    """Tables in the order of their references, parents first, each with a `batch_no`: rows are dealt by hash into batches of about
    `batch`, which a writer without bulk loads sends one by one, each from the task that holds it."""
    for name in order:
        rows = read(name)
        n = max(1, -(-rows.count() // batch))
        write(name, rows.withColumn("batch_no", F.pmod(F.xxhash64(*rows.columns), F.lit(n))))
