"""Parse plans: declarative readings of cells, JSON, log lines and document blocks, compiled to DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.operators import lines as L

DELIMITERS = {"whitespace": r"\s+", "tab": "\t", "comma": ",", "pipe": r"\|", "colon": ":", "equals": "="}


@dataclass(frozen=True)
class TabularPlan:
    """Rows data_start .. data_end of a table of cells; columns by index; repeated headers are dropped."""

    columns: dict[str, int]
    data_start: int
    data_end: int | None = None
    repeated_headers: tuple[int, ...] = ()
    required: tuple[str, ...] = ()


@dataclass(frozen=True)
class TreePlan:
    """Records at an array path (or the root) of JSON; fields by path and type; child entities at nested arrays."""

    fields: dict[str, tuple[str, str]]
    record_path: str | None = None
    children: dict[str, tuple[str, dict[str, tuple[str, str]]]] = field(default_factory=dict)


@dataclass(frozen=True)
class LogPlan:
    """Records of one line, n lines, or runs between blank lines; fields by (line of the record, token, delimiter)."""

    fields: dict[str, tuple[int, int, str]]
    grouping: str = "one_line"
    n: int = 1


def tabular(cells: DataFrame, plan: TabularPlan) -> DataFrame:
    """row_index and the fields of ``cells`` (row_index, column_index, value). A missing required cell is an error."""
    row = F.col("row_index")
    kept = cells.where((row >= plan.data_start) & (row <= plan.data_end if plan.data_end is not None else F.lit(True)) & ~row.isin(*plan.repeated_headers))
    indexes = sorted(set(plan.columns.values()))
    wide = kept.groupBy("row_index").pivot("column_index", indexes).agg(F.first("value"))

    def cell(name: str, index: int):
        value = F.col(str(index))
        if name in plan.required:
            value = F.when(value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit(f"row without {name}: "), row.cast("string"))).cast("string"))
        return value.alias(name)

    return wide.select("row_index", *[cell(n, i) for n, i in plan.columns.items()])


def _values(variant, fields: dict[str, tuple[str, str]]):
    return [F.try_variant_get(variant, path, kind).alias(name) for name, (path, kind) in fields.items()]


def tree_faults(docs: DataFrame, id_col: str, json_col: str, plan: TreePlan, required: list[str]) -> DataFrame:
    """id, ordinal, field, fault of records that a plan cannot read as it says: a required field that is not there (absent) or of
    another type (type), a record path that leads to no array (no_records), and text that is no JSON (malformed). An
    explicit null is there."""
    roots = docs.select(F.col(id_col).alias("id"), F.col(json_col).alias("_t"), F.try_parse_json(json_col).alias("v")).where("_t is not null")
    whole = lambda field, fault: [F.lit(None).cast("int").alias("ordinal"), F.lit(field).alias("field"), F.lit(fault).alias("fault")]
    out = roots.where("v is null").select("id", *whole(None, "malformed"))
    records = roots.where("v is not null").withColumn("ordinal", F.lit(0))
    if plan.record_path:
        items = roots.where("v is not null").withColumn("_items", F.try_variant_get("v", plan.record_path, "array<variant>"))
        out = out.union(items.where("_items is null").select("id", *whole(plan.record_path, "no_records")))
        records = items.select("id", F.posexplode("_items").alias("ordinal", "v"))
    found = []
    for name in required:
        path, kind = plan.fields[name]
        own = F.try_variant_get("v", path, "variant")
        fault = F.when(own.isNull(), "absent").when(~F.is_variant_null(own) & F.try_variant_get("v", path, kind).isNull(), "type")
        found.append(F.struct(F.lit(name).alias("field"), fault.alias("fault")))
    return out.union(records.select("id", "ordinal", F.inline(F.filter(F.array(*found), lambda x: x["fault"].isNotNull()))))


def tree(docs: DataFrame, id_col: str, json_col: str, plan: TreePlan) -> dict[str, DataFrame]:
    """"record": id, ordinal and fields of each record; and for each child entity: id, ordinal, child_ordinal and fields.

    An absent or empty array has no rows. JSON is parsed once into a variant; paths are read from it.
    """
    roots = docs.select(F.col(id_col).alias("id"), F.try_parse_json(json_col).alias("v")).where("v is not null")
    if plan.record_path:
        items = F.try_variant_get("v", plan.record_path, "array<variant>")
        records = roots.select("id", F.posexplode(items).alias("ordinal", "v"))
    else:
        records = roots.withColumn("ordinal", F.lit(0))
    out = {"record": records.select("id", "ordinal", *_values(F.col("v"), plan.fields))}
    for name, (path, fields) in plan.children.items():
        items = F.try_variant_get("v", path, "array<variant>")
        child = records.select("id", "ordinal", F.posexplode(items).alias("child_ordinal", "c"))
        out[name] = child.select("id", "ordinal", "child_ordinal", *_values(F.col("c"), fields))
    return out


def log(rows: DataFrame, plan: LogPlan) -> DataFrame:
    """id, record_no, the fields, and the record's lines joined; ``rows``: id, line_no, line."""
    if plan.grouping == "blank_line":
        grouped = L.blank_line_groups(rows)
    else:
        grouped = L.fixed_groups(rows, plan.n if plan.grouping == "fixed_lines" else 1)
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    records = grouped.groupBy("id", F.col("group_no").cast("long").alias("record_no")).agg(ordered.alias("l"))
    token = lambda line, index, mark: F.get(F.split(F.trim(line) if mark == "whitespace" else line, DELIMITERS[mark]), F.lit(index))
    fields = [token(F.get("l", F.lit(at))["line"], index, mark).alias(name) for name, (at, index, mark) in plan.fields.items()]
    return records.select("id", "record_no", *fields, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def key_value_blocks(blocks: DataFrame, keys: dict[str, str]) -> DataFrame:
    """id and a field for each of ``keys`` (field: key as written) from blocks of "key: value"; ``blocks``: id, line."""
    pair = L.key_value(F.col("line"))
    found = blocks.select("id", pair.alias("kv")).where("kv is not null")
    picked = [F.max(F.when(F.col("kv.key") == key, F.col("kv.value"))).alias(name) for name, key in keys.items()]
    return found.groupBy("id").agg(*picked)


def sections(blocks: DataFrame, heading, within: str = "id", order: str = "line_no") -> DataFrame:
    """section_no: a heading opens a section; blocks before the first are section 0."""
    return blocks.withColumn("section_no", F.sum(heading.cast("int")).over(Window.partitionBy(within).orderBy(order)))


def provenance_differences(actual: DataFrame, replayed: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, fault of rows that one side lacks or whose values differ, nulls being equal to nulls."""
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    mark = lambda df: df.withColumn("_there", F.lit(True))
    both = mark(actual).alias("a").join(mark(replayed).alias("b"), on, "full_outer")
    differ = F.lit(False)
    for v in values:
        differ = differ | ~F.col(f"a.{v}").eqNullSafe(F.col(f"b.{v}"))
    fault = F.when(F.col("a._there").isNull(), "missing").when(F.col("b._there").isNull(), "unexpected").when(differ, "changed")
    return both.select(*[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys], fault.alias("fault")).where("fault is not null")
