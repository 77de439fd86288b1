"""Exports that say what run made them and that they are no advice (inventory 2.1.21, 2.1.23)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

DISCLAIMER = "# DISCLAIMER: Informational only. Extracted by machine; verify against current official text."
BILL_FIELDS = ("id", "agent_name", "model_id", "input_tokens", "output_tokens", "truncated", "review_status", "jurisdiction", "law", "title", "payload_json", "created_at")


def run_line(started: datetime, kind: str) -> str:
    return f"# RUN: {started:%Y-%m-%d %H:%M:%S} UTC | type={kind}"


def _plain(name: str) -> Column:
    if name in ("input_tokens", "output_tokens"):
        return F.coalesce(name, F.lit(0))
    if name == "created_at":
        return F.coalesce(F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
    return F.col(name) if name in ("id", "truncated") else F.coalesce(F.col(name).cast("string"), F.lit(""))


def bill_rows(extractions: DataFrame, versions: DataFrame, laws: DataFrame, jurisdictions: DataFrame) -> DataFrame:
    """What was taken from whole bills, as an export has it: with jurisdiction, citation and title; texts that are null become
    empty, counts that are null 0. A row whose version, law or jurisdiction is unknown is left out."""
    origin = versions.join(laws, "law_id").join(jurisdictions, "jurisdiction_id").select("version_id", "jurisdiction", "law", "title")
    return extractions.join(origin, "version_id").select(*[_plain(c).alias(c) for c in BILL_FIELDS])


def export_bills(rows: DataFrame, path: str, started: datetime, kind: str, order: Sequence[str] = ("jurisdiction", "id")) -> None:
    """`head`: run, disclaimer and names of columns; `rows`: CSV parts in `order`. Parts read after the head, in the order of their
    names, are one CSV file, which no task has to hold. Nothing is written for no rows."""
    if rows.isEmpty():
        return
    lines = [run_line(started, kind), DISCLAIMER, ",".join(rows.columns)]
    rows.orderBy(*order).write.mode("errorifexists").csv(f"{path}/rows", escape='"', emptyValue="", nullValue="")
    rows.sparkSession.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/head")
