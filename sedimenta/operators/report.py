"""Findings of checks put together: one shape, counts, and which rows may be loaded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECOVERABLE = ("RULE_VIOLATION", "RULE_NULL_OPERAND", "DB_NOT_NULL", "DB_LENGTH", "DB_ENUM", "DB_NUMERIC_RANGE", "DB_NUMERIC_SCALE", "DB_INTEGER_RANGE", "DB_FOREIGN_KEY", "DB_UNIQUE")


def combined(findings: dict[str, DataFrame]) -> DataFrame:
    """layer, row_key, code of findings (row_key, code) by layer."""
    parts = [df.select(F.lit(layer).alias("layer"), F.col("row_key").cast("string").alias("row_key"), "code") for layer, df in findings.items()]
    return reduce(DataFrame.union, parts)


def summary(findings: DataFrame) -> DataFrame:
    """layer, code, findings, rows, blocking."""
    by_row = findings.groupBy("layer", "code", "row_key").agg(F.count(F.lit(1)).alias("n"))
    out = by_row.groupBy("layer", "code").agg(F.sum("n").alias("findings"), F.count(F.lit(1)).alias("rows"))
    return out.withColumn("blocking", ~F.col("code").isin(*RECOVERABLE))


def loadable(rows: DataFrame, key: str, findings: DataFrame) -> DataFrame:
    """Rows without any finding."""
    return rows.join(findings.select(F.col("row_key").alias("_k")).distinct(), F.col(key).cast("string") == F.col("_k"), "left_anti")
