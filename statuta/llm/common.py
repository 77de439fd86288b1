"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder for intermediate tables. Where none is set, a local folder serves a local master, as in
    tests; on a cluster that would be one machine's disk, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="statuta-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders that `written` has made in this process and nobody has removed yet.
_made: list[str] = []


def new_folder(spark: SparkSession) -> str:
    _made.append(f"{shared_folder(spark)}/{uuid.uuid4().hex}")
    return _made[-1]


def made_so_far() -> int:
    return len(_made)


def removed(spark: SparkSession, since: int, kept: str | None = None) -> None:
    """Removes the folders made since `since`, except `kept`: for use once what was read from them is written."""
    for path in [p for p in _made[since:] if p != kept]:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _made.remove(path)


def written(df: DataFrame) -> DataFrame:
    """`df` as a table written to the shared folder: lineage ends here and lost executors cost nothing."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one run, written to the shared folder. `dropped` removes those that nothing reads any more;
    tables of other runs in the same process are not touched."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def written(self, name: str, df: DataFrame) -> DataFrame:
        self.paths[name] = path = f"{shared_folder(self.spark)}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def dropped(self, *names: str) -> None:
        for name in names:
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def exactly(df: DataFrame, *names: str) -> DataFrame:
    """The columns of these names, of whatever else the table holds: "Text" beside "text" is no clash, and "Text" alone
    stands for it, as it does in Spark."""
    at = {c.lower(): i for i, c in enumerate(df.columns)} | {c: i for i, c in enumerate(df.columns)}
    plain = df.toDF(*[f"__{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"__{at[c] if c in at else at[c.lower()]}").alias(c) for c in names])


def packed(docs: DataFrame) -> Column:
    """A document's columns in one, `doc`, so that none clashes with columns that an operator adds."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")


def bounded_broadcast(df: DataFrame) -> DataFrame:
    """Marks a table whose row count is fixed by parameters (shards, cells, languages), never by the data."""
    return F.broadcast(df)


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def words_of(c: Column) -> Column:
    """The words of a text, in order; a null text has none."""
    bare = F.trim(F.coalesce(c, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE, -1))


def numbered(df: DataFrame, within: list[str], cell: str, order: list[Column], cells: int, name: str, size: str | None = None) -> DataFrame:
    """Adds `name`: 0, 1, 2, ... within each value of `within`, by `cell` (0 to cells-1) and then `order`; or, with
    `size`, the sum of the sizes ahead.

    A window over `within` alone would put a whole group into one task. Here each (within, cell) is numbered by
    itself and moved up by the rows of the cells before it. `within` must take a fixed number of values; the table of
    offsets has at most that number times `cells` rows.
    """
    keys, value = [*within, cell], F.col(size) if size else F.lit(1).cast("long")
    counts = df.groupBy(*keys).agg(F.sum(value).alias("__n"))
    before = Window.partitionBy(*(within or [F.lit(0)])).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    upto = F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("__upto", upto).join(bounded_broadcast(offsets), keys).withColumn(name, F.col("__before") + F.col("__upto") - value).drop("__before", "__upto")
