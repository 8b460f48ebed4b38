"""Readers of tables and of files whose rows are alike: delimited text and JSON lines. Others are in ``files``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def delimited(spark: SparkSession, path: str, sep: str = ",", quote: str = '"', escape: str = '"', header: bool = True, schema=None) -> DataFrame:
    """Raw cells of a delimited file, all text, quotes and line ends within quotes kept; a malformed row fails."""
    reader = spark.read.options(sep=sep, quote=quote, escape=escape, header=header, multiLine=True, mode="FAILFAST", inferSchema=False)
    return (reader.schema(schema) if schema else reader).csv(path)


def json_lines(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """One record a line; a malformed one fails."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)
