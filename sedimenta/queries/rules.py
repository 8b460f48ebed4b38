"""Business rules and target constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimenta.operators import constraints, rules
from sedimenta.sources.tables import table


def _labelled(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")


def rule_sum_equals_orders(spark, d):
    """Sum of quantity times discount of an order's lines against a total, within a tolerance."""
    total = F.pmod("o_orderkey", F.lit(9)).cast("decimal(18,4)")
    out = rules.sum_equals(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey", total, ["l_quantity", "l_discount"], tolerance="2")
    return out.select("o_orderkey", "child_sum", "check.outcome", "check.code")


def rule_item_count(spark, d):
    out = rules.item_count(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey", least=1, most=6)
    return out.select("o_orderkey", "items", "check.outcome", "check.code")


def rule_unique_by(spark, d):
    out = rules.unique_by(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_linenumber"], scope="l_orderkey")
    return out.where("dup_count > 1")


def rule_unique_by_nulls(spark, d):
    out = rules.unique_by(_labelled(spark, d).select("doc_id", "lang", "quality"), ["lang", "quality"], nulls="distinct")
    return out.select("doc_id", "dup_count")


def rule_matches_reference(spark, d):
    """Customers whose nation is not in region 1."""
    nations = table(spark, d, "nation").where("n_regionkey = 1")
    return rules.matches_reference(table(spark, d, "customer"), ["c_nationkey"], nations, ["n_nationkey"]).select("c_custkey", "c_nationkey", "code")


def rule_compare_null_policies(spark, d):
    df, a, b = _labelled(spark, d), F.col("quality"), F.col("toxic")
    checks = [rules.compare(op, a, b, nulls).alias(f"{op}_{nulls}") for op in ("equals", "gt") for nulls in ("reject", "equal", "pass")]
    out = df.select("doc_id", *checks)
    return out.select("doc_id", *[f for op in ("equals", "gt") for p in ("reject", "equal", "pass") for f in (F.col(f"{op}_{p}.outcome").alias(f"{op}_{p}_outcome"), F.col(f"{op}_{p}.code").alias(f"{op}_{p}_code"))])


def rule_required_if(spark, d):
    check = rules.required_if(F.col("lang") == "en", F.col("quality"))
    return _labelled(spark, d).select("doc_id", check.alias("c")).select("doc_id", "c.outcome", "c.code")


def rule_presence(spark, d):
    a, b = F.when(F.col("quality") == 1, 1), F.when(F.col("toxic") == 1, 1)
    out = _labelled(spark, d).select("doc_id", rules.mutually_exclusive(a, b).alias("x"), rules.at_least_one(a, b).alias("y"))
    return out.select("doc_id", F.col("x.outcome").alias("exclusive"), F.col("y.outcome").alias("some"))


def db_fk_missing(spark, d):
    finished = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return constraints.foreign_key_missing(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey"], finished, ["o_orderkey"])


def db_unique_conflict(spark, d):
    """Customers whose nation a supplier has."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nationkey"))
    return constraints.unique_conflict(c, table(spark, d, "supplier").select(F.col("s_nationkey").alias("nationkey")), ["nationkey"])


def db_upsert_conflict(spark, d):
    """Customers whose segment, nation and sign of balance another customer has, all against all."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", (F.col("c_acctbal") < 0).alias("owes"))
    return constraints.upsert_conflict(c, c, ["c_custkey"], ["c_nationkey", "c_mktsegment", "owes"])


def db_field_bounds(spark, d):
    part = table(spark, d, "part")
    checks = {
        "p_name": [constraints.too_long(F.col("p_name"), 8)],
        "p_size": [constraints.integer_overflow(F.col("p_size") * 4, 8)],
        "p_retailprice": [constraints.out_of_range(F.col("p_retailprice"), 5, 2), constraints.out_of_range(F.col("p_retailprice"), 10, 0)],
        "p_brand": [constraints.not_in_enum(F.col("p_brand"), ["Brand#11", "Brand#22"]), constraints.not_null(F.col("p_brand"))],
    }
    return constraints.issues(part, "p_partkey", checks)


QUERIES = {q.__name__: q for q in (rule_sum_equals_orders, rule_item_count, rule_unique_by, rule_unique_by_nulls, rule_matches_reference, rule_compare_null_policies, rule_required_if, rule_presence, db_fk_missing, db_unique_conflict, db_upsert_conflict, db_field_bounds)}

_LABELLED = "(SELECT d.*, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id))"


def _outcome(truth: str) -> str:
    return f"CASE WHEN {truth} THEN 'pass' WHEN NOT ({truth}) THEN 'fail' ELSE 'indeterminate' END"


def _compare_sql() -> str:
    out = []
    for op, sign in (("equals", "="), ("gt", ">")):
        for policy in ("reject", "equal", "pass"):
            truth = "quality IS NOT DISTINCT FROM toxic" if (op, policy) == ("equals", "equal") else f"quality {sign} toxic"
            otherwise = {"reject": "CASE WHEN quality IS NULL OR toxic IS NULL THEN 'RULE_NULL_OPERAND' ELSE 'RULE_VIOLATION' END"}.get(policy)
            if otherwise is None:
                otherwise = "'RULE_VIOLATION'" if (op, policy) == ("equals", "equal") else "CASE WHEN quality IS NULL OR toxic IS NULL THEN NULL ELSE 'RULE_VIOLATION' END"
            out.append(f"{_outcome(truth)} AS {op}_{policy}_outcome, CASE WHEN {truth} THEN NULL ELSE {otherwise} END AS {op}_{policy}_code")
    return f"SELECT doc_id, {', '.join(out)} FROM {_LABELLED}"


_SUM = "abs(child_sum - CAST(o_orderkey % 9 AS DECIMAL(38,6))) <= 2"
_PRICE = "CAST(p_retailprice AS DECIMAL(38,8))"
ORACLE_SQL = {
    "rule_sum_equals_orders": f"""
        SELECT o_orderkey, child_sum, {_outcome(_SUM)} AS outcome, CASE WHEN {_SUM} THEN NULL ELSE 'RULE_VIOLATION' END AS code
        FROM (SELECT o_orderkey, CAST(coalesce(s, 0) AS DECIMAL(38,6)) AS child_sum FROM orders LEFT JOIN
              (SELECT l_orderkey, sum(CAST(CAST(l_quantity AS DECIMAL(19,6)) * CAST(l_discount AS DECIMAL(19,6)) AS DECIMAL(38,6))) AS s FROM lineitem GROUP BY 1)
              ON l_orderkey = o_orderkey)""",
    "rule_item_count": """
        SELECT o_orderkey, items, CASE WHEN items BETWEEN 1 AND 6 THEN 'pass' ELSE 'fail' END AS outcome, CASE WHEN items BETWEEN 1 AND 6 THEN NULL ELSE 'RULE_VIOLATION' END AS code
        FROM (SELECT o_orderkey, count(l_orderkey) AS items FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)""",
    "rule_unique_by": """
        SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS dup_count FROM lineitem) WHERE dup_count > 1""",
    "rule_unique_by_nulls": f"""
        SELECT doc_id, CASE WHEN lang IS NULL OR quality IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY lang, quality) END AS dup_count FROM {_LABELLED}""",
    "rule_matches_reference": "SELECT c_custkey, c_nationkey, 'RULE_VIOLATION' AS code FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "rule_compare_null_policies": _compare_sql(),
    "rule_required_if": f"""
        SELECT doc_id, CASE WHEN lang <> 'en' OR quality IS NOT NULL THEN 'pass' ELSE 'fail' END AS outcome,
               CASE WHEN lang <> 'en' OR quality IS NOT NULL THEN NULL ELSE 'RULE_VIOLATION' END AS code FROM {_LABELLED}""",
    "rule_presence": f"""
        SELECT doc_id, CASE WHEN coalesce(quality, 0) = 1 AND coalesce(toxic, 0) = 1 THEN 'fail' ELSE 'pass' END AS exclusive,
               CASE WHEN coalesce(quality, 0) = 1 OR coalesce(toxic, 0) = 1 THEN 'pass' ELSE 'fail' END AS some FROM {_LABELLED}""",
    "db_fk_missing": """
        SELECT l_orderkey, l_linenumber, l_partkey, 'DB_FOREIGN_KEY' AS code FROM lineitem
        WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')""",
    "db_unique_conflict": "SELECT c_custkey, c_nationkey AS nationkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)",
    "db_upsert_conflict": """
        SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal < 0 AS owes FROM customer i WHERE EXISTS (SELECT 1 FROM customer s
               WHERE s.c_nationkey = i.c_nationkey AND s.c_mktsegment = i.c_mktsegment AND (s.c_acctbal < 0) = (i.c_acctbal < 0) AND s.c_custkey <> i.c_custkey)""",
    "db_field_bounds": f"""
        SELECT p_partkey AS row_key, field, code FROM (
            SELECT p_partkey, 'p_name' AS field, CASE WHEN length(p_name) > 8 THEN 'DB_LENGTH' END AS code FROM part UNION ALL
            SELECT p_partkey, 'p_size', CASE WHEN p_size * 4 NOT BETWEEN -128 AND 127 THEN 'DB_INTEGER_RANGE' END FROM part UNION ALL
            SELECT p_partkey, 'p_retailprice', CASE WHEN abs({_PRICE}) >= 1000 THEN 'DB_NUMERIC_RANGE' WHEN {_PRICE} <> round({_PRICE}, 2) THEN 'DB_NUMERIC_SCALE' END FROM part UNION ALL
            SELECT p_partkey, 'p_retailprice', CASE WHEN {_PRICE} <> round({_PRICE}, 0) THEN 'DB_NUMERIC_SCALE' END FROM part UNION ALL
            SELECT p_partkey, 'p_brand', CASE WHEN p_brand NOT IN ('Brand#11', 'Brand#22') THEN 'DB_ENUM' END FROM part UNION ALL
            SELECT p_partkey, 'p_brand', CASE WHEN p_brand IS NULL THEN 'DB_NOT_NULL' END FROM part) WHERE code IS NOT NULL""",
}
