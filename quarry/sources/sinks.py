"""Sinks: reports as text, rows as JSON lines, tables as CSV whose columns are all text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_reports(reports: DataFrame, path: str) -> None:
    """One folder ticket_id=... for each report, its lines in order. reports: ticket_id, report."""
    reports.select("ticket_id", "report").write.mode("overwrite").partitionBy("ticket_id").text(path)


def report_lines(reports: DataFrame) -> DataFrame:
    """file (of the form KEY-triage.md), line_no (from 1) and line of each report, for a table that holds many."""
    rows = reports.select(F.concat(F.col("ticket_id").cast("string"), F.lit("-triage.md")).alias("file"), F.posexplode(F.split("report", "\n", -1)).alias("at", "line"))
    return rows.select("file", (F.col("at") + 1).alias("line_no"), "line")


def csv_rows(df: DataFrame) -> DataFrame:
    """line: each row as a line of CSV, every column as text."""
    return df.select(F.to_csv(F.struct(*[F.col(c).cast("string").alias(c) for c in df.columns])).alias("line"))


def from_csv_rows(lines: DataFrame, columns: list[str]) -> DataFrame:
    """What csv_rows made: every column text, nothing inferred."""
    made = F.from_csv("line", ", ".join(f"`{c}` string" for c in columns))
    return lines.select(made.alias("r")).select("r.*")


def response_rows(df: DataFrame) -> DataFrame:
    """body: each row as one JSON object."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("body"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV in UTF-8; every column is written as text, so nothing that looks like a time or a date changes."""
    df.select([F.col(c).cast("string").alias(c) for c in df.columns]).write.mode("overwrite").csv(path, header=True, encoding="UTF-8")


def read_csv(spark, path: str, columns: list[str]) -> DataFrame:
    """What write_csv wrote: every column text, nothing inferred."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).csv(path, header=True, encoding="UTF-8", enforceSchema=True)
