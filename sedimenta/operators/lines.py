"""Lines of text as records: log grammars, key-value pairs, grouping, templates, tables of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a log line with a time and level looks like, and what stands for variable parts in templates.
STAMPED = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2})\s+(DEBUG|INFO|WARN|ERROR)\s+(.*)$"
PLACEHOLDERS = ((r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}", "<time>"), (r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<uuid>"), (r"\d+\.\d+", "<decimal>"), (r"\d+", "<number>"))


def lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, line_no (from 0), line of every text; blank lines count."""
    return df.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line"))


def key_values(c: Column, most: int = 64) -> Column:
    """map of key=value tokens, ``most`` of them; a value may be quoted, and a key that repeats has its first value."""
    found = F.slice(F.regexp_extract_all(c, F.lit(r'([A-Za-z_][A-Za-z0-9_.-]*)=("[^"]*"|\S+)'), F.lit(0)), 1, most)
    pair = lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.regexp_replace(x, r'^[^=]*="?|"$', "").alias("value"))
    pairs = F.transform(found, pair)
    keys = F.transform(pairs, lambda x: x["key"])
    return F.map_from_entries(F.filter(pairs, lambda x, i: F.array_position(keys, x["key"]) == i + 1))


def key_value(c: Column) -> Column:
    """struct(key, value) around the first colon, else the first equals sign, both trimmed; null if a side is empty or
    the key is over 128 letters."""
    at = F.when(F.instr(c, ":") > 0, F.instr(c, ":")).when(F.instr(c, "=") > 0, F.instr(c, "="))
    key, value = F.trim(c.substr(F.lit(1), at - 1)), F.trim(c.substr(at + 1, F.length(c)))
    return F.when((key != "") & (value != "") & (F.length(key) <= 128), F.struct(key.alias("key"), value.alias("value")))


def fixed_groups(df: DataFrame, n: int, order: str = "line_no") -> DataFrame:
    """group_no of n lines each, from the line number."""
    return df.withColumn("group_no", F.floor(F.col(order) / n))


def incomplete_groups(df: DataFrame, n: int, within: str = "id", order: str = "line_no") -> DataFrame:
    """within, lines, fault of holders whose last group of n lines is not whole."""
    by = df.groupBy(within).agg(F.count(F.lit(1)).alias("lines"))
    return by.where(F.col("lines") % n != 0).select(within, "lines", F.lit("incomplete_group").alias("fault"))


def blank_line_groups(df: DataFrame, within: str = "id", order: str = "line_no") -> DataFrame:
    """Lines that are not blank, with the group_no of their run; runs are parted by blank lines."""
    blank = F.trim("line") == ""
    w = Window.partitionBy(within).orderBy(order)
    marked = df.withColumn("_blanks", F.sum(blank.cast("int")).over(w)).where(~blank)
    return marked.withColumn("group_no", F.dense_rank().over(Window.partitionBy(within).orderBy("_blanks")) - 1).drop("_blanks")


def islands(df: DataFrame, keep: Column, within: str = "id", order: str = "line_no") -> DataFrame:
    """within, first, last, n of each contiguous run of rows that ``keep``."""
    run = F.col(order) - F.row_number().over(Window.partitionBy(within).orderBy(order))
    return df.where(keep).withColumn("_run", run).groupBy(within, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).drop("_run")


def events(df: DataFrame, within: str = "id", order: str = "line_no") -> DataFrame:
    """event_no: a line of a known form opens an event; others continue the open one; lines before any are event 0."""
    opens = F.col("line").rlike(STAMPED)
    return df.withColumn("event_no", F.sum(opens.cast("int")).over(Window.partitionBy(within).orderBy(order)))


def template(c: Column) -> Column:
    """The line with times, ids and numbers replaced by typed placeholders."""
    for pattern, name in PLACEHOLDERS:
        c = F.regexp_replace(c, pattern, name)
    return c


def templates(df: DataFrame, least: int = 2) -> DataFrame:
    """template, n of templates that occur ``least`` times; partial counts before the shuffle."""
    return df.groupBy(template(F.col("line")).alias("template")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def to_cells(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """row key, column_index, value: a table as sparse cells; a null has no cell."""
    cells = F.filter(F.array(*[F.struct(F.lit(i).alias("column_index"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)]), lambda x: x["value"].isNotNull())
    return df.select(F.col(key).alias("row_key"), F.inline(cells))


def from_cells(cells: DataFrame, columns: list[str]) -> DataFrame:
    """A wide table of cells; the pivot's values are given, so there is no pass to find them."""
    wide = cells.groupBy("row_key").pivot("column_index", list(range(len(columns)))).agg(F.first("value"))
    return wide.select("row_key", *[F.col(str(i)).alias(c) for i, c in enumerate(columns)])


def markdown_blocks(df: DataFrame, within: str = "id", order: str = "line_no") -> DataFrame:
    """within, block_no, kind, first, last, text of runs of lines: heading, list, code (between fences, these
    included), paragraph or blank. A heading is a block of its own; other runs last as long as their kind does."""
    w = Window.partitionBy(within).orderBy(order)
    fence = F.col("line").rlike(r"^\s{0,3}```")
    fences = F.sum(fence.cast("int")).over(w)
    kind = (
        F.when(fence | (fences % 2 == 1), "code")
        .when(F.trim("line") == "", "blank")
        .when(F.col("line").rlike(r"^#{1,6}\s"), "heading")
        .when(F.col("line").rlike(r"^\s*([-*+]|\d+[.)])\s"), "list")
        .otherwise("paragraph")
    )
    # a fence that closes ends its run: code runs are told apart by the number of opened fences
    run = F.when(kind == "code", F.floor((fences + 1) / 2)).otherwise(-1)
    marked = df.withColumn("kind", kind).withColumn("_run", run)
    starts = (F.col("kind") != F.lag("kind").over(w)) | (F.col("_run") != F.lag("_run").over(w)) | (F.col("kind") == "heading")
    numbered = marked.withColumn("block_no", F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(w) - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), "\n")
    return numbered.groupBy(within, "block_no", "kind").agg(F.min(order).alias("first"), F.max(order).alias("last"), text.alias("text"))
