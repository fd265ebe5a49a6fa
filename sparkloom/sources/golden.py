"""Golden sets and baselines of the evaluation as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CASES = "id string, question string, expectedChunkIds array<string>, expectedUrls array<string>, unanswerable boolean"


def write_cases(cases: DataFrame, path: str) -> None:
    cases.write.mode("overwrite").json(path)


def read_cases(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Cases of JSON lines, or of files that are one array each; fields that are missing are null."""
    return spark.read.schema(CASES).option("multiLine", array).json(path)


def write_baseline(report: DataFrame, path: str) -> None:
    """The one row of an evaluation."""
    report.write.mode("overwrite").json(path)


def read_baseline(spark: SparkSession, path: str) -> dict[str, float]:
    """Metrics of a saved evaluation, one row; empty where nothing is saved in the folder."""
    row = spark.read.option("multiLine", False).json(path).first()
    return {k: float(v) for k, v in row.asDict().items() if v is not None} if row else {}
