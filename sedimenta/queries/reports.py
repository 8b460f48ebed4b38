"""Reports, upserts, typed matching and Markdown blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimenta.operators import constraints, matching, report, rules
from sedimenta.operators import lines as L
from sedimenta.plans import load
from sedimenta.queries.loading import _TABLES
from sedimenta.sources.tables import table


def _findings(spark, d):
    orders = table(spark, d, "orders")
    bounds = constraints.issues(orders, "o_orderkey", {"o_totalprice": [constraints.out_of_range(F.col("o_totalprice"), 6, 1)]})
    counts = rules.item_count(orders, table(spark, d, "lineitem"), "o_orderkey", "l_orderkey", least=1)
    return report.combined({"constraints": bounds, "rules": counts.where("check.code is not null").select(F.col("o_orderkey").alias("row_key"), "check.code")})


def validation_summary(spark, d):
    return report.summary(_findings(spark, d))


def validation_loadable(spark, d):
    return report.loadable(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", _findings(spark, d))


def upsert_state(spark, d):
    """Customers that have orders, after balances below zero are set to zero for all customers, twice over."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    stored = c.join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    incoming = c.where("c_acctbal < 0")
    return load.merged(stored, incoming.union(incoming.withColumn("c_acctbal", F.lit(0.0))), ["c_custkey"])


def type_compatibility_pairs(spark, d):
    """Kinds of the tables' columns against each other."""
    from sedimenta.operators.profile import kind_of

    kinds = sorted({kind_of(f.dataType) for t in _TABLES for f in table(spark, d, t).schema})
    pairs = spark.createDataFrame([(a, b) for a in kinds for b in kinds], "source_kind string, target_kind string")
    return pairs.withColumn("fit", matching.type_compatibility(F.col("source_kind"), F.col("target_kind"))).where("fit is not null")


def markdown_kinds(spark, d):
    """Documents rendered as Markdown: a heading, a list, fenced code, a paragraph."""
    text = F.concat(F.lit("# "), "p_name", F.lit("\n\n- "), "p_brand", F.lit("\n- "), "p_type", F.lit("\n```\n# no heading\n```\n"), F.lit("last line"))
    blocks = L.markdown_blocks(L.lines(table(spark, d, "part").select("p_partkey", text.alias("t")), "p_partkey", "t"))
    return blocks.select("id", "block_no", "kind", "first", "last")


QUERIES = {q.__name__: q for q in (validation_summary, validation_loadable, upsert_state, type_compatibility_pairs, markdown_kinds)}

_D = "CAST(o_totalprice AS DECIMAL(38,8))"
_FOUND = f"""
    SELECT 'constraints' AS layer, CAST(o_orderkey AS VARCHAR) AS row_key, CASE WHEN abs({_D}) >= 100000 THEN 'DB_NUMERIC_RANGE' ELSE 'DB_NUMERIC_SCALE' END AS code
    FROM orders WHERE abs({_D}) >= 100000 OR {_D} <> round({_D}, 1) UNION ALL
    SELECT 'rules', CAST(o_orderkey AS VARCHAR), 'RULE_VIOLATION' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"""
ORACLE_SQL = {
    "validation_summary": f"SELECT layer, code, count(*) AS findings, count(DISTINCT row_key) AS rows, false AS blocking FROM ({_FOUND}) GROUP BY 1, 2",
    "validation_loadable": f"SELECT o_orderkey, o_custkey FROM orders WHERE CAST(o_orderkey AS VARCHAR) NOT IN (SELECT row_key FROM ({_FOUND}))",
    "upsert_state": """
        SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0::DOUBLE ELSE c_acctbal END AS c_acctbal FROM customer
        WHERE c_acctbal < 0 OR c_custkey IN (SELECT o_custkey FROM orders)""",
    "type_compatibility_pairs": """SELECT source_kind, target_kind, CAST(fit AS DOUBLE) AS fit FROM (VALUES ('integer', 'integer', 1), ('number', 'number', 1), ('string', 'string', 1), ('datetime', 'datetime', 1), ('integer', 'string', 0.75),
        ('integer', 'number', 0.75), ('string', 'integer', 0.5)) t(source_kind, target_kind, fit)""",
    "markdown_kinds": """
        SELECT p_partkey AS id, CAST(b AS BIGINT) AS block_no, kind, first, last FROM part, (VALUES (0, 'heading', 0, 0), (1, 'blank', 1, 1), (2, 'list', 2, 3), (3, 'code', 4, 6), (4, 'paragraph', 7, 7)) t(b, kind, first, last)""",
}
