"""Orders and their lines against rules of every kind at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimenta.operators.schema import Rule
from sedimenta.plans import rulebook as B
from sedimenta.sources.tables import table

RULES = [
    B.Sum("total", "o_totalprice", ("l_extendedprice",), "150000"), B.Sum("quantity", "quantities", ("l_quantity", "half")), B.Count("lines", 1, 6), B.Unique("line_no", "child", ("l_orderkey", "l_linenumber")), B.Unique("same_part", "child", ("l_orderkey", "color"), "reject"),
    B.Unique("customer_day", "parent", ("o_custkey", "o_orderdate")), B.Reference("part", "child", ("l_partkey",), "part", ("p_partkey",)), B.Reference("buyer", "parent", ("buyer",), "customer", ("c_custkey",)), B.Reference("big_seller", "child", ("l_suppkey",), "rich", ("s_suppkey",)),
    B.Row("parent", Rule("price", "gt", ("o_totalprice",), 1000.0)), B.Row("child", Rule("discount", "lte", ("l_discount",), 0.09)), B.Row("child", Rule("unknown", "equals", ("l_none",), 1)),
]


def _sides(spark, d):
    orders = table(spark, d, "orders").withColumn("quantities", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderkey") % 97)).withColumn("buyer", F.when(F.col("o_custkey") % 50 > 0, F.col("o_custkey") + 10))
    lines = table(spark, d, "lineitem").withColumn("half", F.when(F.col("l_linenumber") != 5, 2)).withColumn("color", F.when(F.col("l_partkey") % 9 > 0, F.col("l_partkey") % 9))
    return orders, lines, {"part": table(spark, d, "part"), "customer": table(spark, d, "customer"), "rich": table(spark, d, "supplier").where("s_acctbal > 0")}


def _found(spark, d):
    orders, lines, references = _sides(spark, d)
    return B.issues(orders, "o_orderkey", lines, ["l_orderkey", "l_linenumber"], "l_orderkey", RULES, references)


def validated_dataset(spark, d):
    return _found(spark, d)


def validated_records(spark, d):
    """States of orders, where a seller's balance and a repeated colour are warnings only."""
    return B.states(table(spark, d, "orders"), "o_orderkey", _found(spark, d), ["big_seller", "same_part", "total", "quantity"])


QUERIES = {q.__name__: q for q in (validated_dataset, validated_records)}

_O = "(SELECT *, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 97 END AS quantities, CASE WHEN o_custkey % 50 > 0 THEN o_custkey + 10 END AS buyer FROM orders)"
_L = "(SELECT *, CASE WHEN l_linenumber <> 5 THEN 2 END AS half, CASE WHEN l_partkey % 9 > 0 THEN l_partkey % 9 END AS color, concat(l_orderkey, '/', l_linenumber) AS name FROM lineitem)"
_ISSUES = f"""
    WITH o AS {_O}, l AS {_L}, s AS (
        SELECT l_orderkey AS k, count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(19,6))) AS price, sum(CAST(l_quantity AS DECIMAL(19,6)) * half) AS quantity, bool_or(half IS NULL) AS gap FROM l GROUP BY 1
    ), x AS (
        SELECT o.*, coalesce(n, 0) AS n, coalesce(price, 0) AS price, coalesce(quantity, 0) AS quantity, coalesce(gap, false) AS gap FROM o LEFT JOIN s ON k = o_orderkey
    ), f AS (
        SELECT 'parent' AS tab, o_orderkey AS k, CAST(NULL AS VARCHAR) AS name, 'total' AS rule, 'fail' AS outcome, 'RULE_VIOLATION' AS code FROM x WHERE abs(price - CAST(o_totalprice AS DECIMAL(19,6))) > 150000
        UNION ALL SELECT 'parent', o_orderkey, NULL, 'quantity', CASE WHEN gap OR quantities IS NULL THEN 'indeterminate' ELSE 'fail' END, CASE WHEN gap OR quantities IS NULL THEN 'RULE_NULL_OPERAND' ELSE 'RULE_VIOLATION' END FROM x WHERE gap OR quantities IS NULL OR quantity <> quantities
        UNION ALL SELECT 'parent', o_orderkey, NULL, 'lines', 'fail', 'RULE_VIOLATION' FROM x WHERE n NOT BETWEEN 1 AND 6
        UNION ALL SELECT 'parent', o_orderkey, NULL, 'price', 'fail', 'RULE_VIOLATION' FROM o WHERE o_totalprice <= 1000
        UNION ALL SELECT 'parent', o_orderkey, NULL, 'customer_day', 'fail', 'RULE_VIOLATION' FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderdate) AS c FROM o) WHERE c > 1
        UNION ALL SELECT 'parent', o_orderkey, NULL, 'buyer', 'fail', CASE WHEN buyer IS NULL THEN 'RULE_NULL_OPERAND' ELSE 'RULE_VIOLATION' END FROM o WHERE buyer IS NULL OR buyer NOT IN (SELECT c_custkey FROM customer)
        UNION ALL SELECT 'child', l_orderkey, name, 'line_no', 'fail', 'RULE_VIOLATION' FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS c FROM l) WHERE c > 1
        UNION ALL SELECT 'child', l_orderkey, name, 'same_part', CASE WHEN color IS NULL THEN 'indeterminate' ELSE 'fail' END, CASE WHEN color IS NULL THEN 'RULE_NULL_OPERAND' ELSE 'RULE_VIOLATION' END
            FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, color) AS c FROM l) WHERE color IS NULL OR c > 1
        UNION ALL SELECT 'child', l_orderkey, name, 'part', 'fail', 'RULE_VIOLATION' FROM l WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
        UNION ALL SELECT 'child', l_orderkey, name, 'big_seller', 'fail', 'RULE_VIOLATION' FROM l WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
        UNION ALL SELECT 'child', l_orderkey, name, 'discount', 'fail', 'RULE_VIOLATION' FROM l WHERE l_discount > 0.09
        UNION ALL SELECT '', NULL, NULL, 'unknown', 'indeterminate', 'RULE_FIELD_UNKNOWN'
    )"""
ORACLE_SQL = {
    "validated_dataset": _ISSUES + """SELECT tab AS "table", coalesce(name, CAST(k AS VARCHAR)) AS row_key, CAST(k AS VARCHAR) AS record, rule, outcome, code FROM f""",
    "validated_records": _ISSUES + """, w AS (
        SELECT k, bool_or(outcome = 'fail' AND rule NOT IN ('big_seller', 'same_part', 'total', 'quantity')) AS bad, count(*) AS findings FROM f WHERE k IS NOT NULL GROUP BY k
    ) SELECT CAST(o_orderkey AS VARCHAR) AS record, CASE WHEN bad THEN 'reject' ELSE 'review' END AS state, coalesce(findings, 0) AS findings FROM orders LEFT JOIN w ON k = o_orderkey""",
}
