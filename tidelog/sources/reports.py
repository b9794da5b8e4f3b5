"""Files of reports: JSON lines in and out, CSV out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Columns of a report row.
COLUMNS = ["suite", "case", "scenario", "stage", "backend", "trial", "seconds", "commit_seconds", "us", "peak_rss"]
ROWS = "suite string, case string, scenario string, stage string, backend string, trial int, seconds double, commit_seconds double, us double, peak_rss double"


def read_lines(spark: SparkSession, path: str, schema: str = ROWS) -> DataFrame:
    """JSON lines; a line that is no JSON is an error. The schema is given, so nothing is read twice."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").option("header", "true").csv(path)
