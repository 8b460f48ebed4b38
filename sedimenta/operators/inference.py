"""What a table's cells and a column's text suggest about structure and type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.normalize import primitive

SUMMARY_WORDS = ("total", "subtotal", "grand total", "summary")


def width_histogram(cells: DataFrame) -> DataFrame:
    """width, rows: how many rows have so many cells."""
    by_row = cells.groupBy("row_index").agg(F.count(F.lit(1)).alias("width"))
    return by_row.groupBy("width").agg(F.count(F.lit(1)).alias("rows"))


def modal_width(cells: DataFrame) -> DataFrame:
    """The most frequent width, the larger of equals, and how many rows are of another."""
    widths = width_histogram(cells)
    best = F.max_by("width", F.struct("rows", "width")).alias("width")
    return widths.agg(best, F.sum("rows").alias("all_rows"), F.max("rows").alias("most")).select("width", (F.col("all_rows") - F.col("most")).alias("ragged_rows"))


def row_role(first_cell: Column) -> Column:
    """summary, empty or data, by the first cell."""
    low = F.lower(F.trim(first_cell))
    return F.when(low.isin(*SUMMARY_WORDS), "summary").when(F.coalesce(low, F.lit("")) == "", "empty").otherwise("data")


def type_votes(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, kind, votes, non_null: how many values of a text column look like each kind; one pass."""
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields])
    rows = df.select(F.inline(entries)).where("v is not null").groupBy("field", primitive(F.col("v")).alias("kind")).agg(F.count(F.lit(1)).alias("votes"))
    return rows.withColumn("non_null", F.sum("votes").over(Window.partitionBy("field")))


def resolved_types(votes: DataFrame) -> DataFrame:
    """field, kind, status: resolved with 95 % of the values, a lead of 10 % and 20 values, else ambiguous or insufficient."""
    order = Window.partitionBy("field").orderBy(F.desc("votes"), "kind")
    ranked = votes.withColumn("place", F.row_number().over(order)).withColumn("next", F.coalesce(F.lead("votes").over(order), F.lit(0)))
    best = ranked.where("place = 1")
    enough = (F.col("votes") * 100 >= F.col("non_null") * 95) & ((F.col("votes") - F.col("next")) * 10 >= F.col("non_null"))
    status = F.when((F.col("kind") != "string") & (F.col("non_null") < 20), "insufficient").when(enough, "resolved").otherwise("ambiguous")
    return best.select("field", "kind", "votes", "non_null", status.alias("status"))


def footer_matches(cells: DataFrame, footer_row: int, columns: list[int]) -> DataFrame:
    """column_index, total, footer, verified: whether the footer's cell is the sum of the cells above it."""
    number = F.col("value").try_cast("decimal(28,6)")
    by = cells.where(F.col("column_index").isin(*columns)).groupBy("column_index")
    sums = by.agg(F.sum(F.when(F.col("row_index") < footer_row, number)).alias("total"), F.max(F.when(F.col("row_index") == footer_row, number)).alias("footer"))
    return sums.withColumn("verified", F.col("total").eqNullSafe(F.col("footer")))
