"""Constraints of a target table, checked as semi-joins, anti-joins and expressions before anything is written."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.forms import FAMILIES
from sedimenta.sources.shared import written


def _all(terms) -> Column:
    return reduce(lambda a, b: a & b, terms)


def _any(terms) -> Column:
    return reduce(lambda a, b: a | b, terms)


def foreign_key_missing(children: DataFrame, columns: list[str], parents: DataFrame, parent_columns: list[str], incoming: DataFrame | None = None, full: bool = False) -> DataFrame:
    """Rows of ``children`` whose key is in neither the stored nor the incoming parents, with a code.

    A null in any component skips the check, unless ``full``: then a key that is null in part is a violation.
    """
    keys = parents.select(*parent_columns)
    if incoming is not None:
        keys = keys.union(incoming.select(*parent_columns))
    whole = _all(F.col(c).isNotNull() for c in columns)
    on = _all(F.col(f"c.{a}") == F.col(f"p.{b}") for a, b in zip(columns, parent_columns, strict=True))
    missing = children.where(whole).alias("c").join(keys.distinct().alias("p"), on, "left_anti").withColumn("code", F.lit("DB_FOREIGN_KEY"))
    if full:
        part = children.where(~whole & _any(F.col(c).isNotNull() for c in columns)).withColumn("code", F.lit("DB_FOREIGN_KEY_PARTIAL"))
        missing = missing.union(part)
    return missing


def unique_conflict(incoming: DataFrame, stored: DataFrame, key: list[str], nulls_equal: bool = False) -> DataFrame:
    """Incoming rows whose key is stored already."""
    same = (lambda k: F.col(f"i.{k}").eqNullSafe(F.col(f"s.{k}"))) if nulls_equal else (lambda k: F.col(f"i.{k}") == F.col(f"s.{k}"))
    return incoming.alias("i").join(stored.select(*key).distinct().alias("s"), _all(map(same, key)), "left_semi")


def upsert_conflict(incoming: DataFrame, stored: DataFrame, identity: list[str], key: list[str]) -> DataFrame:
    """Incoming rows whose unique key is stored under another identity.

    Of each stored key only its least and largest identity are needed: another one is there if either differs. So a key
    that many rows share is one row of the join. Keys with a null conflict with none.
    """
    own = F.struct(*identity)
    ends = stored.groupBy(*key).agg(F.min(own).alias("_least"), F.max(own).alias("_most"))
    on = _all(F.col(f"i.{k}") == F.col(f"s.{k}") for k in key)
    here = F.struct(*[F.col(f"i.{k}").alias(k) for k in identity])
    other = ~here.eqNullSafe(F.col("s._least")) | ~here.eqNullSafe(F.col("s._most"))
    return incoming.alias("i").join(ends.alias("s"), on & other, "left_semi")


def not_null(c: Column) -> Column:
    return F.when(c.isNull(), "DB_NOT_NULL")


def too_long(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, "DB_LENGTH")


def not_in_enum(c: Column, labels: list[str]) -> Column:
    return F.when(~c.isin(*labels), "DB_ENUM")


def out_of_range(c: Column, precision: int, scale: int) -> Column:
    """numeric(precision, scale): whole digits over precision - scale, or places over scale (trailing zeros aside).

    Compared at one scale that leaves room for the bound, so nothing is rounded on the way; a value too large even for
    that, or not finite, is out of range.
    """
    whole = precision - scale
    places = max(scale, min(18, 37 - whole))
    kind = f"decimal(38,{places})"
    d = c.try_cast(kind)
    large = d.isNull() | (F.abs(d) >= F.lit(10**whole).cast(kind))
    return F.when(c.isNotNull() & large, "DB_NUMERIC_RANGE").when(d != F.round(d, scale).cast(kind), "DB_NUMERIC_SCALE")


def integer_overflow(c: Column, bits: int) -> Column:
    return F.when(~c.between(-(1 << (bits - 1)), (1 << (bits - 1)) - 1), "DB_INTEGER_RANGE")


def issues(df: DataFrame, key: str, checks: dict[str, list[Column]]) -> DataFrame:
    """key, field, code for every check that found something; all findings, not just the first. One pass."""
    found = F.array(*[F.struct(F.lit(f).alias("field"), c.alias("code")) for f, cs in checks.items() for c in cs])
    return df.select(F.col(key).alias("row_key"), F.inline(F.filter(found, lambda x: x["code"].isNotNull())))


# ---- a declared target as one pass

#: Bits of whole numbers by their declared name; the greatest number of four bytes.
BITS = {"TINYINT": 8, "SMALLINT": 16, "INT": 32, "INTEGER": 32, "BIGINT": 64}
FLOAT4 = 3.4028234663852886e38
UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
#: Kinds of columns that a family of declared types takes as they are.
TAKES = {
    "integer": ("integer",), "decimal": ("integer", "decimal"), "float": ("integer", "decimal", "number"), "text": ("string",), "uuid": ("string",), "json": ("string",),
    "boolean": ("boolean",), "date": ("date",), "datetime": ("datetime",), "binary": ("bytes",),
}


@dataclass(frozen=True)
class Declared:
    """A target's field: its type as declared, whether it takes nulls, and the labels of an enumeration."""

    type: str
    nullable: bool = True
    labels: tuple[str, ...] = ()


@dataclass(frozen=True)
class Key:
    """A key of a target: unique among the rows, or, with ``parents``, held by them."""

    name: str
    columns: tuple[str, ...]
    parents: DataFrame | None = None
    parent_columns: tuple[str, ...] = ()
    full: bool = False


def bad_uuid(c: Column) -> Column:
    return F.when(~c.rlike(UUID), "DB_UUID")


def nul_byte(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("\0")), "DB_NUL_BYTE")


def float4_overflow(c: Column) -> Column:
    """A finite number that four bytes cannot hold."""
    d = c.cast("double")
    return F.when((F.abs(d) > FLOAT4) & (F.abs(d) < float("inf")), "DB_FLOAT_RANGE")


def field_checks(df: DataFrame, name: str, declared: Declared) -> list[Column]:
    """What a field's declaration asks of its values. A column of a kind that the type does not take is DB_TYPE for every
    value, and so is a type of no known family."""
    from sedimenta.operators.profile import kind_of

    base, _, rest = declared.type.upper().partition("(")
    base, sizes = " ".join(base.split()), [int(x) for x in rest.rstrip(") ").split(",") if x.strip().isdigit()]
    family = next((f for f, names in FAMILIES.items() if base in names), None)
    c = F.col(name)
    out = [] if declared.nullable else [not_null(c)]
    if kind_of(df.schema[name].dataType) not in TAKES.get(family, ()):
        return [*out, F.when(c.isNotNull(), "DB_TYPE")]
    if family == "text":
        out += [nul_byte(c), *([too_long(c, sizes[0])] if sizes else [])]
    elif family == "uuid":
        out.append(bad_uuid(c))
    elif family == "integer":
        out.append(integer_overflow(c, BITS[base]))
    elif family == "decimal" and sizes:
        out.append(out_of_range(c, sizes[0], sizes[1] if len(sizes) > 1 else 0))
    elif base == "REAL":
        out.append(float4_overflow(c))
    return [*out, *([not_in_enum(c, list(declared.labels))] if declared.labels else [])]


def target_issues(df: DataFrame, key: str, fields: dict[str, Declared], keys: list[Key], checks: dict[str, str]) -> DataFrame:
    """row_key, part (field, check or key), name, code: all that a target would refuse, in one frame.

    The rows are read once: fields and checks are one pass, and the keys of all rows, unique and foreign, one shuffle of
    (key, values). A CHECK that is unknown passes. A key with a null is not checked, unless ``full``: then one that is null in
    part is DB_FOREIGN_KEY_PARTIAL. Every row of a unique key that repeats is DB_UNIQUE.
    """
    told = lambda part, name, code: F.struct(F.lit(part).alias("part"), F.lit(name).alias("name"), code.alias("code"))
    found = [told("field", n, c) for n, declared in fields.items() for c in field_checks(df, n, declared)]
    found += [told("check", n, F.when(~F.expr(e), "DB_CHECK")) for n, e in checks.items()]
    asked = []
    for k in keys:
        whole = _all(F.col(c).isNotNull() for c in k.columns)
        asked.append(F.when(whole, F.struct(F.lit(k.name).alias("name"), F.array(*[F.col(c).cast("string") for c in k.columns]).alias("values"))))
        if k.full:
            found.append(told("key", k.name, F.when(~whole & _any(F.col(c).isNotNull() for c in k.columns), "DB_FOREIGN_KEY_PARTIAL")))
    none = F.array().cast("array<struct<name: string, values: array<string>>>")
    narrow = written(df.select(F.col(key).cast("string").alias("row_key"), F.filter(F.array(*found), lambda x: x["code"].isNotNull()).alias("found"), (F.array_compact(F.array(*asked)) if asked else none).alias("asked")))
    out = narrow.select("row_key", F.inline("found"))
    if not keys:
        return out
    each = narrow.select("row_key", F.inline("asked"))
    counts = each.groupBy("name", "values").agg(F.count(F.lit(1)).alias("_n"))
    held = [k.parents.select(F.lit(k.name).alias("name"), F.array(*[F.col(c).cast("string") for c in k.parent_columns]).alias("values")) for k in keys if k.parents is not None]
    alone = [k.name for k in keys if k.parents is None]
    bad = counts.where(F.col("name").isin(*alone) & (F.col("_n") > 1)).select("name", "values", F.lit("DB_UNIQUE").alias("code"))
    if held:
        lost = counts.where(~F.col("name").isin(*alone)) if alone else counts
        bad = bad.union(lost.join(reduce(DataFrame.union, held).distinct(), ["name", "values"], "left_anti").select("name", "values", F.lit("DB_FOREIGN_KEY")))
    return out.unionByName(each.join(bad, ["name", "values"]).select("row_key", F.lit("key").alias("part"), "name", "code"))
