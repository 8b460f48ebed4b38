"""Load plans and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimenta.operators import lines
from sedimenta.plans import load
from sedimenta.sources.tables import table

_EDGES = [("region", "nation"), ("nation", "customer"), ("nation", "supplier"), ("customer", "orders"), ("orders", "lineitem"), ("part", "lineitem"), ("supplier", "lineitem")]
_TABLES = ["customer", "lineitem", "nation", "orders", "part", "region", "supplier"]


def plan_actions(spark, d):
    """All customers against those that have orders; a negative balance is an issue."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    stored = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return load.plan_actions(c, stored, ["c_custkey"], ["c_acctbal"], c.where("c_acctbal < 0").select("c_custkey")).select("c_custkey", "action")


def plan_counts(spark, d):
    return load.action_counts(plan_actions(spark, d))


def plan_quarantine_closure(spark, d):
    """Rejected customers reach their orders, these their lines' orders' customers: over the edges customer - order."""
    o = table(spark, d, "orders")
    edges = o.select((F.col("o_custkey") * 2).alias("a"), (F.col("o_orderkey") * 2 + 1).alias("b"))
    rejected = table(spark, d, "customer").where("c_acctbal < -900").select((F.col("c_custkey") * 2).alias("node"))
    return load.rejection_closure(edges, rejected)


def fk_load_order(spark, d):
    order = load.load_order(_TABLES, _EDGES)
    return spark.createDataFrame([(i, t) for i, t in enumerate(order)], "place int, table_name string")


def fingerprint_rows(spark, d):
    return load.row_fingerprint(table(spark, d, "customer"), ["c_custkey", "c_name", "c_mktsegment"]).select("c_custkey", "fingerprint")


def tabular_cells_roundtrip(spark, d):
    cells = lines.to_cells(table(spark, d, "customer"), "c_custkey", ["c_name", "c_nationkey", "c_mktsegment"])
    return lines.from_cells(cells, ["c_name", "c_nationkey", "c_mktsegment"])


def json_path_explode(spark, d):
    value = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(value).alias("n"), F.sum(value).alias("total"))


QUERIES = {q.__name__: q for q in (plan_actions, plan_counts, plan_quarantine_closure, fk_load_order, fingerprint_rows, tabular_cells_roundtrip, json_path_explode)}

_ACTIONS = """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'quarantine' WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'update' ELSE 'insert' END AS action
              FROM customer"""
_SEP = "chr(31)"
ORACLE_SQL = {
    "plan_actions": _ACTIONS,
    "plan_counts": f"SELECT action, count(*) AS rows FROM ({_ACTIONS}) GROUP BY 1",
    "plan_quarantine_closure": """
        SELECT c_custkey * 2 AS node, true AS direct FROM customer WHERE c_acctbal < -900 UNION ALL
        SELECT o_orderkey * 2 + 1, false FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < -900""",
    "fk_load_order": "SELECT * FROM (VALUES (0, 'part'), (1, 'region'), (2, 'nation'), (3, 'customer'), (4, 'orders'), (5, 'supplier'), (6, 'lineitem')) t(place, table_name)",
    "fingerprint_rows": f"SELECT c_custkey, sha256('=' || c_custkey || {_SEP} || '=' || c_name || {_SEP} || '=' || c_mktsegment) AS fingerprint FROM customer",
    "tabular_cells_roundtrip": "SELECT c_custkey AS row_key, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer",
    "json_path_explode": "SELECT event_type, count(v) AS n, CAST(sum(v) AS BIGINT) AS total FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS v FROM events) GROUP BY 1",
}
