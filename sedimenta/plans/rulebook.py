"""All rules of a parent table and its child table as one plan, and what they say of each record.

Each table is read once. What the rules need of a child's rows (its parent's key, the factors of sums, the rows' findings and
the keys to be told apart or looked up) is written as one narrow table. From it one aggregate by parent key serves every
sum and count, and one shuffle of (rule, key) serves every unique and every reference rule.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.operators import rules as R
from sedimenta.operators import schema as C
from sedimenta.sources.shared import written


@dataclass(frozen=True)
class Sum:
    """The sum over a parent's children of the product of ``factors`` equals the parent's ``total`` within ``tolerance``."""

    name: str
    total: str
    factors: tuple[str, ...]
    tolerance: str = "0"
    places: int = 6


@dataclass(frozen=True)
class Count:
    """A parent has from ``least`` to ``most`` children."""

    name: str
    least: int | None = None
    most: int | None = None


@dataclass(frozen=True)
class Unique:
    """No two rows of a table ("parent" or "child") share a key. A key with a null is ``distinct`` from any other, ``equal`` to
    its like, or ``reject``-ed."""

    name: str
    table: str
    fields: tuple[str, ...]
    nulls: str = "distinct"


@dataclass(frozen=True)
class Reference:
    """A row's key occurs among the columns of a reference table. A key with a null fails."""

    name: str
    table: str
    fields: tuple[str, ...]
    reference: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Row:
    """A rule over single rows of a table."""

    table: str
    rule: C.Rule


ISSUE = "struct<rule: string, outcome: string, code: string>"


def _key(fields: Sequence[str]) -> Column:
    return F.array(*[F.col(f).cast("string") for f in fields])


def _told(name: str, check: Column) -> Column:
    return F.struct(F.lit(name).alias("rule"), check["outcome"].alias("outcome"), check["code"].alias("code"))


def _rows(df: DataFrame, table: str, row_key: Column, rules: list, keep: list[Column]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """row, what is kept, found (issues of row rules) and asked (rule, key of unique and reference rules); and rules unfit."""
    checks, unfit = C.rule_checks(df, [r.rule for r in rules if isinstance(r, Row) and r.table == table])
    asked = []
    for r in rules:
        if isinstance(r, (Unique, Reference)) and r.table == table:
            if not set(r.fields) <= set(df.columns):
                unfit.append((r.name, "RULE_FIELD_UNKNOWN"))
                continue
            whole = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in r.fields])
            if isinstance(r, Reference) or r.nulls == "reject":
                checks.append(F.struct(F.lit(r.name).alias("rule"), F.when(~whole, "fail" if isinstance(r, Reference) else "indeterminate").alias("outcome"), F.when(~whole, R.NULL_OPERAND).alias("code")))
            entry = F.struct(F.lit(r.name).alias("rule"), _key(r.fields).alias("key"))
            asked.append(entry if isinstance(r, Unique) and r.nulls == "equal" else F.when(whole, entry))
    found = F.filter(F.array(*checks), lambda x: x["code"].isNotNull()) if checks else F.array().cast(f"array<{ISSUE}>")
    entries = F.array_compact(F.array(*asked)) if asked else F.array().cast("array<struct<rule: string, key: array<string>>>")
    return df.select(row_key.cast("string").alias("row_key"), *keep, found.alias("found"), entries.alias("asked")), unfit


def issues(parents: DataFrame, key: str, children: DataFrame, child_key: list[str], parent_key: str, rules: list, references: dict[str, DataFrame]) -> DataFrame:
    """table, row_key, record, rule, outcome, code: every finding of every rule, in one frame. ``record`` is the parent's key as
    text; child rows are named by their key's parts joined by "/".

    A rule that cannot be run is one row without a key, outcome indeterminate. A child whose parent's key is null or not
    there has a record of its own key or none; sums and counts are of parents. Rows that repeat are findings each.
    """
    sums, counts = [r for r in rules if isinstance(r, Sum)], [r for r in rules if isinstance(r, Count)]
    factor = lambda r: reduce(F.try_multiply, [R.exact_factor(children, f) for f in r.factors]).try_cast(f"decimal(38,{r.places})")
    products = [x for i, r in enumerate(sums) for x in (factor(r).alias(f"p{i}"), reduce(lambda a, b: a | b, [F.col(f).isNull() for f in r.factors]).alias(f"n{i}"))]
    name = F.concat_ws("/", *[F.col(c).cast("string") for c in child_key])
    narrow, unfit = _rows(children, "child", name, rules, [F.col(parent_key).alias("parent"), *products])
    narrow = written(narrow)
    each = [x for i in range(len(sums)) for x in (F.try_sum(f"p{i}").alias(f"sum{i}"), F.bool_or(F.col(f"p{i}").isNull()).alias(f"poison{i}"), F.bool_or(f"n{i}").alias(f"null{i}"))]
    of_parent = narrow.groupBy("parent").agg(F.count(F.lit(1)).alias("items"), *each)
    upper, unfit_above = _rows(parents, "parent", F.col(key), rules, [F.col(key).alias("parent"), *[F.col(r.total).alias(f"total{i}") for i, r in enumerate(sums)]])
    met = upper.join(of_parent, "parent", "left")
    checks = []
    for i, r in enumerate(sums):
        there, kind = F.col("items").isNotNull(), f"decimal(38,{r.places})"
        poisoned = F.coalesce(there & (F.col(f"poison{i}") | F.col(f"sum{i}").isNull()), F.lit(False))
        own = F.when(there, F.col(f"sum{i}")).otherwise(F.lit(0)).cast(kind)
        truth = F.when(~poisoned, F.abs(F.try_subtract(own, F.col(f"total{i}").cast(kind))) <= F.lit(r.tolerance).cast(kind))
        checks.append(_told(r.name, R.outcome(truth, F.when(F.col(f"null{i}") | F.col(f"total{i}").isNull(), R.NULL_OPERAND).when(poisoned, R.OUT_OF_RANGE).otherwise(R.VIOLATION))))
    for r in counts:
        n = F.coalesce("items", F.lit(0))
        truth = (n >= r.least if r.least is not None else F.lit(True)) & (n <= r.most if r.most is not None else F.lit(True))
        checks.append(_told(r.name, R.outcome(truth, F.lit(R.VIOLATION))))
    more = F.filter(F.array(*checks), lambda x: x["code"].isNotNull()) if checks else F.array().cast(f"array<{ISSUE}>")
    judged = written(met.select("row_key", F.col("parent").cast("string").alias("record"), F.concat("found", more).alias("found"), "asked"))
    both = judged.withColumn("table", F.lit("parent")).unionByName(narrow.select("row_key", F.col("parent").cast("string").alias("record"), "found", "asked", F.lit("child").alias("table")))
    out = both.select("table", "row_key", "record", F.inline("found"))

    asked = both.select("table", "row_key", "record", F.inline("asked"))
    again = asked.groupBy("rule", "key").agg(F.count(F.lit(1)).alias("_n"))
    unique = [r.name for r in rules if isinstance(r, Unique)]
    twice = again.where(F.col("rule").isin(*unique) & (F.col("_n") > 1)) if unique else again.limit(0)
    looked = [references[r.reference].select(F.lit(r.name).alias("rule"), _key(r.columns).alias("key")) for r in rules if isinstance(r, Reference)]
    absent = again.where(F.col("rule").isin(*[r.name for r in rules if isinstance(r, Reference)])).join(reduce(DataFrame.union, looked).distinct(), ["rule", "key"], "left_anti") if looked else again.limit(0)
    bad = asked.join(twice.union(absent).select("rule", "key"), ["rule", "key"])
    out = out.unionByName(bad.select("table", "row_key", "record", "rule", F.lit("fail").alias("outcome"), F.lit(R.VIOLATION).alias("code")))
    lost = parents.sparkSession.createDataFrame([("", None, None, n, "indeterminate", c) for n, c in unfit + unfit_above], "table string, row_key string, record string, rule string, outcome string, code string")
    return out.unionByName(lost)


def states(parents: DataFrame, key: str, found: DataFrame, warnings: Sequence[str] = ()) -> DataFrame:
    """record, state, findings: reject if a rule failed, review if one is undecided, failed as a warning only, or could not be
    run at all, else accept. Every record of ``parents`` has a row."""
    stopped = found.where("row_key is null").limit(1).count() > 0
    failed = (F.col("outcome") == "fail") & ~F.col("rule").isin(*warnings) if warnings else F.col("outcome") == "fail"
    worst = found.where("record is not null").groupBy("record").agg(F.bool_or(failed).alias("_f"), F.count(F.lit(1)).alias("findings"))
    out = parents.select(F.col(key).cast("string").alias("record")).join(worst, "record", "left")
    state = F.when(F.col("_f"), "reject").when(F.col("findings").isNotNull() | F.lit(stopped), "review").otherwise("accept")
    return out.select("record", state.alias("state"), F.coalesce("findings", F.lit(0).cast("long")).alias("findings"))
