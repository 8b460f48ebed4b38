"""What a source holds, whatever its form, as one shape of values; and what can be said of it as a whole."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.functions import text as X
from sedimenta.plans.parse import LogPlan, TabularPlan, TreePlan

# Forms of a line of an access log; after it, referrer and agent.
ACCESS = r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "([A-Z]+) (\S+) ([^"]*)" ([0-9]{3}) ([0-9]+|-)(?: "([^"]*)" "([^"]*)")?$'
LEVELLED = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,6})?(?:Z|[+-]\d{2}:?\d{2})?)\s+\[?(TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|CRITICAL|FATAL)\]?:?\s+(.*)$"
PAIRS = r"^(?:\S+=(?:\"[^\"]*\"|\S+)\s*)+$"


def recognised_line(line: Column) -> Column:
    """struct(grammar, time, level, message, status) of a log line: levelled, access or pairs; null grammar if none."""
    part = lambda p, i: F.nullif(F.regexp_extract(line, p, i), F.lit(""))
    is_level, is_access, is_pairs = line.rlike(LEVELLED), line.rlike(ACCESS), line.rlike(PAIRS)
    return F.struct(
        F.when(is_level, "levelled").when(is_access, "access").when(is_pairs, "pairs").alias("grammar"), F.when(is_level, part(LEVELLED, 1)).when(is_access, part(ACCESS, 4)).alias("time"),
        F.when(is_level, part(LEVELLED, 2)).alias("level"), F.when(is_level, part(LEVELLED, 3)).when(is_access, part(ACCESS, 6)).alias("message"), F.when(~is_level & is_access, part(ACCESS, 8)).try_cast("int").alias("status"),
    )


def log_events(rows: DataFrame, within: str = "id", order: str = "line_no") -> DataFrame:
    """within, event_no, first, lines, and what the first line says: a recognised line opens an event, others join it; lines
    before the first are event 0."""
    w = Window.partitionBy(within).orderBy(order)
    marked = rows.withColumn("r", recognised_line(F.col("line"))).withColumn("event_no", F.sum(F.col("r.grammar").isNotNull().cast("int")).over(w))
    said = F.min_by("r", order)
    return marked.groupBy(within, "event_no").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("lines"), said.alias("r")).select(within, "event_no", "first", "lines", "r.*")


def values_of(lines: DataFrame | None = None, cells: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """source, kind (line, cell or node), ref, value of all that a source holds."""
    parts = []
    if lines is not None:
        parts.append(lines.select(F.col("id").cast("string").alias("source"), F.lit("line").alias("kind"), F.concat(F.lit("line:"), "line_no").alias("ref"), F.col("line").alias("value")))
    if cells is not None:
        parts.append(cells.select(F.col("key").cast("string"), F.lit("cell"), F.concat(F.lit("cell:"), "row_index", F.lit(":"), "column_index"), "value"))
    if nodes is not None:
        parts.append(nodes.where("value is not null").select(F.col("key").cast("string"), F.lit("node"), F.concat(F.lit("node:"), "path"), "value"))
    return reduce(DataFrame.union, parts)


def texts_of(values: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks (source, ref, value, covers: refs) and, of the values, those that no block covers, so that nothing is said twice."""
    covered = blocks.select(F.col("source").alias("_s"), F.explode("covers").alias("_r")).distinct()
    rest = values.join(covered, (F.col("source") == F.col("_s")) & (F.col("ref") == F.col("_r")), "left_anti")
    return blocks.select("source", F.lit("block").alias("kind"), "ref", "value").union(rest.select("source", "kind", "ref", "value"))


def classified_sources(values: DataFrame) -> DataFrame:
    """source, class, findings: the highest class that any value of a source raises it to, and how many spans do."""
    spans = X.all_spans(F.col("value"))
    by = values.select("source", X.class_rank(spans).alias("_rank"), F.size(spans).alias("_n")).groupBy("source")
    out = by.agg(F.max("_rank").alias("_rank"), F.sum(F.greatest("_n", F.lit(0))).alias("findings"))
    return out.select("source", F.element_at(F.array(*map(F.lit, X.CLASSES)), F.col("_rank") + 1).alias("class"), "findings")


def scanned(text: str | None) -> tuple[int, int]:
    """Depth and items of a JSON text as a scan of its bytes tells them, without a parse: items are brackets that open, strings,
    names among them, and other values. All bytes at once: which are within strings follows from the parity of the quotes
    before them, quotes after an odd number of backslashes aside."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass") if text else b"", np.uint8)
    if not len(b):
        return 0, 0
    place = np.arange(len(b))
    other = np.maximum.accumulate(np.where(b != 92, place, -1))  # the last byte up to here that is no backslash
    quote = b == 34
    quote[1:] &= (place[:-1] - other[:-1]) % 2 == 0
    inside = np.cumsum(quote) % 2 == 1  # from the opening quote up to the closing one
    opens, closes = quote & inside, quote & ~inside
    plain = ~inside & ~closes
    up, down = plain & ((b == 91) | (b == 123)), plain & ((b == 93) | (b == 125))
    value = plain & ~up & ~down & (b > 32) & (b != 44) & (b != 58)
    begins = value.copy()
    begins[1:] &= ~value[:-1]
    depth = np.cumsum(up.astype(np.int64) - down)
    return max(0, int(depth.max())), int(up.sum() + opens.sum() + begins.sum())


@F.pandas_udf(T.StructType([T.StructField("depth", T.LongType()), T.StructField("items", T.LongType())]))
def json_scan(texts: pd.Series) -> pd.DataFrame:
    """:func:`scanned` of a batch; a null text has neither depth nor items."""
    return pd.DataFrame([scanned(t) for t in texts], columns=["depth", "items"])


def json_bounds(df: DataFrame, key: str, text: str, deep: int = 32, many: int = 10_000) -> DataFrame:
    """key, depth, items, fault of JSON texts: too_deep, too_many, or malformed. Texts beyond a bound are never parsed, so one
    deeper than any parser takes is told as what it is. A null text is not judged."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("_t")).where("_t is not null").withColumn("_s", json_scan("_t"))
    beyond = F.when(F.col("_s.depth") > deep, "too_deep").when(F.col("_s.items") > many, "too_many")
    rows = rows.withColumn("_f", beyond).withColumn("_bad", F.when(F.col("_f").isNull(), F.try_parse_json("_t").isNull()).otherwise(F.lit(False)))
    return rows.select("key", "_s.depth", "_s.items", F.coalesce("_f", F.when(F.col("_bad"), "malformed")).alias("fault"))


def json_strings(nodes: DataFrame) -> DataFrame:
    """key, path, text of every string and every name in JSON documents."""
    said = nodes.where("kind = 'string'").select("key", "path", F.col("value").alias("text"))
    return said.union(nodes.where("name is not null").select("key", "path", F.col("name").alias("text")))


def labels(cells: DataFrame, header_row: int, most: int = 8) -> DataFrame:
    """column_index, labels: the distinct labels that the sources' headers give a column, sorted, ``most`` of them."""
    return cells.where(F.col("row_index") == header_row).groupBy("column_index").agg(F.slice(F.array_sort(F.collect_set(F.trim("value"))), 1, most).alias("labels"))


def missing_refs(required: DataFrame, seen: DataFrame) -> DataFrame:
    """Required refs that were not seen, each once."""
    return required.select("ref").subtract(seen.select("ref"))


def identity_supported(profile: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """entity, supported: whether all declared key fields of an entity are there in full and unique by an exact count."""
    rows = [(e, f) for e, fields in keys.items() for f in fields]
    declared = profile.sparkSession.createDataFrame(rows, "entity string, key_field string")
    fine = F.coalesce((F.col("null_count") == 0) & F.col("exact") & (F.col("distinct_count") == F.col("non_null_count")), F.lit(False))
    return declared.join(profile, F.col("key_field") == F.col("field"), "left").groupBy("entity").agg(F.bool_and(fine).alias("supported"))


def plan_faults(plan: TabularPlan | TreePlan | LogPlan) -> list[str]:
    """Why a parse plan is not one that can be run; empty if it is."""
    out = []
    if isinstance(plan, TabularPlan):
        if plan.data_end is not None and plan.data_end < plan.data_start:
            out.append("the range ends before it starts")
        if set(plan.required) - plan.columns.keys():
            out.append("a required field has no column")
        if len(set(plan.columns.values())) < len(plan.columns) or min(plan.columns.values(), default=0) < 0:
            out.append("columns repeat or are negative")
    elif isinstance(plan, TreePlan):
        if any("[" in path for path, _ in plan.fields.values()):
            out.append("a field's path goes through an item")
        if plan.record_path and any(path == plan.record_path for path, _ in plan.children.values()):
            out.append("a child is its parent")
    else:
        if plan.grouping not in ("one_line", "fixed_lines", "blank_line") or plan.n < 1:
            out.append("no such grouping")
        if plan.grouping == "one_line" and any(at for at, *_ in plan.fields.values()):
            out.append("a field is beyond the record's lines")
    return out
