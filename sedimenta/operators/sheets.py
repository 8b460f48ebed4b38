"""Bounded samples of long sources with what they cover, and regions of a sheet that holds several tables.

Both work over places from 0, split into ranges: what comes before a range is a sum over ranges, what comes before a row within
its range a sum over that range's rows. No holder, however long, is one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.normalize import primitive
from sedimenta.sources.shared import written

#: Rows of a range.
SPAN = 4096
# What the first cell of a row that sums up says.
TOTALS = ("total", "totals", "sum", "итого", "всего")


def _ranges(df: DataFrame, within: list[str], order: str, text: str, span: int) -> DataFrame:
    """For each holder and range its rows and bytes, and those of the ranges before and after it."""
    sizes = df.groupBy(*within, F.floor(F.col(order) / span).alias("_range")).agg(F.count(F.lit(1)).alias("_rows"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long").alias("_bytes"))
    up = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*within).orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
    sums = {f"_{c}_{side}": F.coalesce(F.sum(f"_{c}").over(w), F.lit(0)) for c in ("rows", "bytes") for side, w in (("before", up), ("after", down))}
    return written(sizes.withColumns(sums))


def structural_sample(df: DataFrame, within: str, order: str, text: str, head: int, tail: int, head_bytes: int, tail_bytes: int, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """Two frames: the sample (the columns of ``df`` and ``part``, head or tail) and what it covers of each holder.

    The head is the longest beginning of at most ``head`` rows and ``head_bytes`` bytes of text, the tail the longest end of at
    most ``tail`` rows and ``tail_bytes`` that is not in the head. ``order`` numbers a holder's rows, without repeats. A null
    text has no bytes. Covered: rows and bytes seen and kept, head_rows, tail_rows, and reasons for what is left out, in
    order: sample_items if the head or the tail has all the rows it may have, sample_bytes if a next row would not fit.
    """
    ranges = _ranges(df, [within], order, text, span)
    near = ranges.where(((F.col("_rows_before") < head) & (F.col("_bytes_before") <= head_bytes)) | ((F.col("_rows_after") < tail) & (F.col("_bytes_after") <= tail_bytes)))
    met = df.withColumn("_range", F.floor(F.col(order) / span)).join(near.drop("_rows", "_bytes"), [within, "_range"])
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    up, down = Window.partitionBy(within, "_range").orderBy(order), Window.partitionBy(within, "_range").orderBy(F.desc(order))
    to_here = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumns({"_up": F.row_number().over(up), "_down": F.row_number().over(down), "_above": F.sum(size).over(to_here(up)), "_below": F.sum(size).over(to_here(down))})
    in_head = (F.col("_rows_before") + F.col("_up") <= head) & (F.col("_bytes_before") + F.col("_above") <= head_bytes)
    in_tail = (F.col("_rows_after") + F.col("_down") <= tail) & (F.col("_bytes_after") + F.col("_below") <= tail_bytes)
    part = F.when(in_head, "head").when(in_tail, "tail")
    sample = met.withColumn("part", part).where("part is not null").select(*df.columns, "part")
    seen = ranges.groupBy(within).agg(F.sum("_rows").alias("rows_seen"), F.sum("_bytes").alias("bytes_seen"))
    count = lambda name: F.count_if(F.col("part") == name)
    kept = sample.groupBy(within).agg(F.sum(size).alias("bytes_kept"), count("head").alias("head_rows"), count("tail").alias("tail_rows"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = seen.join(kept, within, "left").withColumns({c: n(F.col(c)) for c in ("bytes_kept", "head_rows", "tail_rows")}).withColumn("rows_kept", F.col("head_rows") + F.col("tail_rows"))
    left_out = F.col("rows_kept") < F.col("rows_seen")
    short = (F.col("head_rows") < head) | (F.col("tail_rows") < tail)
    reasons = F.array_compact(F.array(F.when(left_out & ((F.col("head_rows") == head) | (F.col("tail_rows") == tail)), "sample_items"), F.when(left_out & short, "sample_bytes")))
    return sample, out.select(within, "rows_seen", "bytes_seen", "rows_kept", "bytes_kept", "head_rows", "tail_rows", reasons.alias("reasons"))


def running_count(df: DataFrame, order: str, flag: Column, name: str, span: int = SPAN) -> DataFrame:
    """``name``: how many rows up to each one, in the order of ``order``, have the flag."""
    flagged = df.withColumn("_flag", F.coalesce(flag, F.lit(False)).cast("long")).withColumn("_range", F.floor(F.col(order) / span))
    sums = flagged.groupBy("_range").agg(F.sum("_flag").alias("_own"))
    # a row for each range of rows: the only window over all of them
    before = sums.withColumn("_before", F.coalesce(F.sum("_own").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_own")
    within = F.sum("_flag").over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return flagged.join(before, "_range").withColumn(name, F.col("_before") + within).drop("_flag", "_range", "_before")


def sheet_rows(df: DataFrame, cells: str = "cells") -> DataFrame:
    """Rows of a sheet (row_index from 0 without gaps, cells) with the kinds of their cells and what a row may be by itself."""
    filled = lambda x: F.coalesce(F.trim(x), F.lit("")) != ""
    kinds = F.transform(cells, lambda x: F.when(~filled(x), "empty").otherwise(primitive(x)))
    out = df.withColumn("kinds", F.coalesce(kinds, F.array().cast("array<string>")))
    some = F.filter("kinds", lambda k: k != "empty")
    first = F.lower(F.trim(F.get(F.filter(cells, filled), F.lit(0))))
    return out.withColumns({"blank": F.size(some) == 0, "words": (F.size(some) > 1) & F.forall(some, lambda k: k == "string"), "sums": F.coalesce(first.isin(*TOTALS), F.lit(False))})


def row_roles(df: DataFrame, cells: str = "cells") -> DataFrame:
    """row_index, cells, kinds, region (from 1; 0 before any), role: header, repeated_header, body, summary, footer, blank or loose.

    A header has words only, begins the sheet or follows a blank row, and is followed by a row of other kinds. It begins a
    region. A row of the same cells further down repeats it; a row that begins with a word for a total is a summary, and
    the footer if nothing but blank rows follows in its region. Rows before any header are loose.
    """
    rows = written(sheet_rows(df, cells))
    beside = lambda step, names: rows.select((F.col("row_index") + step).alias("row_index"), *[F.col(a).alias(b) for a, b in names])
    met = rows.join(beside(1, [("blank", "_blank_before")]), "row_index", "left").join(beside(-1, [("kinds", "_kinds_after"), ("blank", "_blank_after")]), "row_index", "left")
    header = F.col("words") & F.coalesce("_blank_before", F.lit(True)) & F.coalesce(~F.col("_blank_after") & (F.col("_kinds_after") != F.col("kinds")), F.lit(False)) & ~F.col("sums")
    placed = running_count(met.withColumn("_header", header), "row_index", F.col("_header"), "region")
    placed = written(placed.drop("_blank_before", "_kinds_after", "_blank_after"))
    heads = placed.where("_header").select("region", F.col(cells).alias("_head"))
    ends = placed.where(~F.col("blank")).groupBy("region").agg(F.max("row_index").alias("_end"))
    out = placed.join(heads, "region", "left").join(ends, "region", "left")
    role = F.when(F.col("blank"), "blank").when(F.col("_header"), "header").when(F.col("region") == 0, "loose").when(F.col(cells) == F.col("_head"), "repeated_header")
    role = role.when(F.col("sums") & (F.col("row_index") == F.col("_end")), "footer").when(F.col("sums"), "summary").otherwise("body")
    return out.select("row_index", cells, "kinds", "region", role.alias("role"))


def table_regions(roles: DataFrame, cells: str = "cells") -> DataFrame:
    """One row for each region of :func:`row_roles`: region, header (cells), first and last row, columns, body rows, repeated
    headers, segments (stretches of body rows of one signature of kinds), footer row, and of the footer's numbers the columns
    whose sum over the body they are, and those they are not.

    Sums are of decimals; body cells that are no number count nothing. Summaries within a region are not summed.
    """
    at = lambda role: F.col("role") == role
    body = roles.where(at("body")).select("region", "row_index", "kinds")
    before = roles.where(at("body")).select("region", (F.col("row_index") + 1).alias("row_index"), F.col("kinds").alias("_before"))
    breaks = body.join(before, ["region", "row_index"], "left").groupBy("region").agg(F.count_if(F.col("_before").isNull() | (F.col("_before") != F.col("kinds"))).alias("segments"))
    whole = roles.where("region > 0 and role <> 'blank'").groupBy("region").agg(
        F.max(F.when(at("header"), F.col(cells))).alias("header"), F.min("row_index").alias("first"), F.max("row_index").alias("last"), F.max(F.when(at("header"), F.size(cells))).alias("columns"),
        F.count_if(at("body")).alias("body_rows"), F.count_if(at("repeated_header")).alias("repeated"), F.max(F.when(at("footer"), F.col("row_index"))).alias("footer_row"),
    )
    number = lambda df: df.select("region", F.posexplode(cells).alias("column", "_x")).withColumn("_x", F.trim("_x").try_cast("decimal(38,6)")).where("_x is not null")
    sums = number(roles.where(at("body"))).groupBy("region", "column").agg(F.try_sum("_x").alias("_sum"))
    told = number(roles.where(at("footer"))).join(sums, ["region", "column"], "left").groupBy("region").agg(
        F.array_sort(F.collect_list(F.when(F.col("_x") == F.col("_sum"), F.col("column")))).alias("sums_right"), F.array_sort(F.collect_list(F.when(~F.col("_x").eqNullSafe(F.col("_sum")), F.col("column")))).alias("sums_wrong"),
    )
    out = whole.join(breaks, "region", "left").join(told, "region", "left")
    none = F.array().cast("array<int>")
    return out.select("region", "header", "first", "last", "columns", "body_rows", "repeated", F.coalesce("segments", F.lit(0).cast("long")).alias("segments"), "footer_row", F.coalesce("sums_right", none).alias("sums_right"), F.coalesce("sums_wrong", none).alias("sums_wrong"))
