"""An append-only log of JSON lines that a task may write twice and that shows each row once (inventory 2.1.27).

A data source writer with a commit in two steps: each task writes a file of its own attempt, and only when all tasks are done the
driver names the files that count in a manifest, which appears by a rename. Readers read the files that manifests name. What lost or
repeated attempts, or a failed job, leave behind is named by none, so nobody sees it.

    warnings.write.format("append_log").mode("append").save(path)
    read_log(spark, path)

Paths are any that pyarrow opens (a shared mount, s3, hdfs); rows become one JSON object each.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "append_log"
ATTEMPTS, MANIFESTS = "attempts", "manifests"
#: Characters of a raw answer that a warning keeps: a fixed value.
RAW_MOST = 500


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def plain(value):
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    return str(value) if isinstance(value, Decimal) else value


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int


class LogWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[Row]) -> Written:
        """One file of this attempt; none for an empty partition."""
        where, root = place(self.path)
        name, rows, out = f"{uuid.uuid4().hex}.jsonl", 0, None
        for row in iterator:
            if out is None:
                where.create_dir(f"{root}/{ATTEMPTS}", recursive=True)
                out = where.open_output_stream(f"{root}/{ATTEMPTS}/{name}")
            out.write((json.dumps(plain(row), ensure_ascii=False) + "\n").encode("utf-8", "replace"))
            rows += 1
        if out is None:
            return Written(None, 0)
        out.close()
        return Written(name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        files = [{"name": m.name, "rows": m.rows} for m in messages if m and m.name]
        where, root = place(self.path)
        where.create_dir(f"{root}/{MANIFESTS}", recursive=True)
        name = uuid.uuid4().hex
        with where.open_output_stream(f"{root}/{MANIFESTS}/.{name}") as out:
            out.write(json.dumps({"files": files}).encode())
        where.move(f"{root}/{MANIFESTS}/.{name}", f"{root}/{MANIFESTS}/{name}.json")

    def abort(self, messages: list[Written | None]) -> None:
        """Files of a failed job are named by no manifest; those that it told of go at once."""
        where, root = place(self.path)
        for m in messages:
            if m and m.name:
                where.delete_file(f"{root}/{ATTEMPTS}/{m.name}")


class AppendLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> LogWriter:
        if overwrite:
            raise ValueError("a log is only appended to")
        return LogWriter(self.options["path"])


def append(rows: DataFrame, path: str) -> None:
    rows.sparkSession.dataSource.register(AppendLog)
    rows.write.format(NAME).mode("append").save(path)


def committed(path: str) -> list[str]:
    """The files that count, by all manifests: names, not rows, so few against the log."""
    where, root = place(path)
    if where.get_file_info(f"{root}/{MANIFESTS}").type == fs.FileType.NotFound:
        return []
    found = []
    for info in where.get_file_info(fs.FileSelector(f"{root}/{MANIFESTS}")):
        if info.base_name.endswith(".json"):
            with where.open_input_stream(info.path) as f:
                found += [x["name"] for x in json.loads(f.read())["files"]]
    return sorted(found)


def read_log(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    files = [f"{path.rstrip('/')}/{ATTEMPTS}/{name}" for name in committed(path)]
    return spark.read.schema(schema).json(files) if files else spark.createDataFrame([], schema)


def warning_rows(rows: DataFrame) -> DataFrame:
    """timestamp, record_id, warning_type, details, raw_response (its beginning) for the log."""
    return rows.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"), "record_id", "warning_type", "details", F.substring("raw_response", 1, RAW_MOST).alias("raw_response"))
