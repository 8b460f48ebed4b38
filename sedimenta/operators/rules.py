"""Business rules: a closed set of declarative checks, compiled to Columns, aggregates, windows and joins.

A rule gives every row of its collection an outcome: pass, fail or indeterminate, and a code that says why it did not
pass. Nulls follow the rule's policy: ``reject`` makes a null operand an issue of its own, ``equal`` lets null equal
null, ``pass`` leaves the comparison unknown.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

VIOLATION, NULL_OPERAND, MISSING_OPERAND, OUT_OF_RANGE = "RULE_VIOLATION", "RULE_NULL_OPERAND", "RULE_MISSING_OPERAND", "RULE_NUMERIC_RANGE"
_COMPARE = {
    "equals": lambda a, b: a == b, "not_equals": lambda a, b: a != b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b,
    "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "date_lt": lambda a, b: a < b, "date_lte": lambda a, b: a <= b,
}


def outcome(truth: Column, code: Column) -> Column:
    """struct(outcome, code) from a three-valued truth and a code for what is not true."""
    told = F.when(truth, "pass").when(~truth, "fail").otherwise("indeterminate")
    return F.struct(told.alias("outcome"), F.when(truth, F.lit(None)).otherwise(code).alias("code"))


def compare(op: str, left: Column, right: Column, nulls: str = "reject", present: Column | None = None) -> Column:
    """A comparison's struct(outcome, code); ``present``: whether both operands' cells are there at all."""
    any_null = left.isNull() | right.isNull()
    truth = _COMPARE[op](left, right)
    if nulls == "equal" and op in ("equals", "not_equals"):
        truth = left.eqNullSafe(right) if op == "equals" else ~left.eqNullSafe(right)
        code = F.lit(VIOLATION)
    elif nulls == "reject":
        code = F.when(any_null, NULL_OPERAND).otherwise(VIOLATION)
    else:
        code = F.when(any_null, F.lit(None)).otherwise(VIOLATION)
    if present is not None:
        truth = F.when(present, truth)
        code = F.when(~present, MISSING_OPERAND).otherwise(code)
    return outcome(truth, code)


def required_if(condition: Column, field: Column) -> Column:
    """Where the condition is definitely true, the field must hold a value; unknown counts as not required."""
    return outcome(~F.coalesce(condition, F.lit(False)) | field.isNotNull(), F.lit(VIOLATION))


def mutually_exclusive(*fields: Column) -> Column:
    """One of the fields at most holds a value."""
    return outcome(reduce(lambda a, b: a + b, [f.isNotNull().cast("int") for f in fields]) <= 1, F.lit(VIOLATION))


def at_least_one(*fields: Column) -> Column:
    """One of the fields at least holds a value; an empty string is one."""
    return outcome(reduce(lambda a, b: a | b, [f.isNotNull() for f in fields]), F.lit(VIOLATION))


def unique_by(df: DataFrame, key: list[str], scope: str | None = None, nulls: str = "distinct") -> DataFrame:
    """Every row of ``df`` with dup_count, the rows that share its key (within the parent ``scope`` if given).

    ``nulls``: a key with a null is ``distinct`` from any other, ``equal`` to its like, or ``reject``-ed (dup_count null).
    Counts come from an aggregate, combined before the shuffle, and join back; a frequent key is a skewed join side,
    not one task's window.
    """
    parts = [*([scope] if scope else []), *key]
    counts = df.groupBy(*parts).agg(F.count(F.lit(1)).alias("dup_count"))
    on = reduce(lambda a, b: a & b, [F.col(f"r.{p}").eqNullSafe(F.col(f"k.{p}")) for p in parts])
    out = df.alias("r").join(counts.alias("k"), on).select("r.*", "k.dup_count")
    if nulls == "equal":
        return out
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    return out.withColumn("dup_count", F.when(whole, F.col("dup_count")).otherwise(F.lit(1 if nulls == "distinct" else None).cast("long")))


def exact_factor(df: DataFrame, name: str) -> Column:
    """A column as an exact decimal: decimals and whole numbers as they are, binary numbers to 6 places."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DecimalType):
        return F.col(name)
    return F.col(name).try_cast("decimal(19,6)" if isinstance(kind, (T.FloatType, T.DoubleType)) else "decimal(20,0)")


def sum_equals(parents: DataFrame, children: DataFrame, key: str, parent_key: str, total: Column, factors: list[str], tolerance: str = "0", places: int = 6) -> DataFrame:
    """Parents with child_sum and outcome: the sum over children of the product of ``factors`` (8 at most) against ``total``.

    Sums are exact decimals of the factors' own types; no children sum to 0; a child with a null factor, or a product or
    sum that no decimal holds, makes its parent indeterminate.
    """
    if not 1 <= len(factors) <= 8:
        raise ValueError("a product has 1 to 8 factors")
    product = reduce(F.try_multiply, [exact_factor(children, f) for f in factors]).try_cast(f"decimal(38,{places})")
    sums = children.groupBy(F.col(parent_key).alias("_parent")).agg(F.try_sum(product).alias("_sum"), F.bool_or(product.isNull()).alias("_poison"), F.bool_or(reduce(lambda a, b: a | b, [F.col(f).isNull() for f in factors])).alias("_null"))
    out = parents.join(sums, F.col(key) == F.col("_parent"), "left")
    there = F.col("_parent").isNotNull()
    poisoned = there & (F.col("_poison") | F.col("_sum").isNull())
    child_sum = F.when(~there, F.lit(0)).otherwise(F.col("_sum")).cast(f"decimal(38,{places})")
    truth = F.when(~F.coalesce(poisoned, F.lit(False)), F.abs(F.try_subtract(child_sum, total.cast(f"decimal(38,{places})"))) <= F.lit(tolerance).cast(f"decimal(38,{places})"))
    code = F.when(F.col("_null"), NULL_OPERAND).when(poisoned, OUT_OF_RANGE).otherwise(VIOLATION)
    return out.withColumn("child_sum", child_sum).withColumn("check", outcome(truth, code)).drop("_parent", "_sum", "_poison", "_null")


def item_count(parents: DataFrame, children: DataFrame, key: str, parent_key: str, least: int | None = None, most: int | None = None) -> DataFrame:
    """Parents with items (0 if none) and outcome against the bounds."""
    counts = children.groupBy(F.col(parent_key).alias("_parent")).agg(F.count(F.lit(1)).alias("_n"))
    out = parents.join(counts, F.col(key) == F.col("_parent"), "left").withColumn("items", F.coalesce("_n", F.lit(0)))
    n = F.col("items")
    truth = (n >= least if least is not None else F.lit(True)) & (n <= most if most is not None else F.lit(True))
    return out.withColumn("check", outcome(truth, F.lit(VIOLATION))).drop("_parent", "_n")


def matches_reference(df: DataFrame, columns: list[str], reference: DataFrame, reference_columns: list[str], nulls: str = "reject") -> DataFrame:
    """Rows whose composite key is not in the reference, with a code. Whether the reference is broadcast is left to its
    measured size."""
    same = lambda a, b: F.col(f"d.{a}").eqNullSafe(F.col(f"f.{b}")) if nulls == "equal" else F.col(f"d.{a}") == F.col(f"f.{b}")
    on = reduce(lambda x, y: x & y, [same(a, b) for a, b in zip(columns, reference_columns, strict=True)])
    out = df.alias("d").join(reference.select(*reference_columns).distinct().alias("f"), on, "left_anti")
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    return out.withColumn("code", F.when(any_null, NULL_OPERAND).otherwise(VIOLATION) if nulls == "reject" else F.lit(VIOLATION))


def groups_of(df: DataFrame, start: Column, order: str, within: str) -> DataFrame:
    """group_no: a new group begins at each row where ``start`` holds, in the order of ``order`` within ``within``."""
    return df.withColumn("group_no", F.sum(start.cast("int")).over(Window.partitionBy(within).orderBy(order)))
