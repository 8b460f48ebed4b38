"""Parse plans and inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimenta.operators import inference
from sedimenta.operators import lines as L
from sedimenta.plans import parse
from sedimenta.sources.tables import table


def _cells(spark, d):
    """The customers as cells, the name missing where the balance is negative."""
    n = table(spark, d, "customer").withColumn("c_name", F.when(F.col("c_acctbal") >= 0, F.col("c_name")))
    return L.to_cells(n, "c_custkey", ["c_custkey", "c_name", "c_nationkey"]).withColumnRenamed("row_key", "row_index")


def parse_tabular(spark, d):
    """All rows but the first two and two repeated headers."""
    plan = parse.TabularPlan({"key": 0, "name": 1, "nation": 2}, data_start=2, repeated_headers=(7, 9), required=("key",))
    return parse.tabular(_cells(spark, d), plan)


def parse_tree(spark, d):
    nested = F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.expr("transform(sequence(0, o_orderkey % 3), i -> named_struct('n', i, 's', o_orderstatus))").alias("items")))
    docs = table(spark, d, "orders").select("o_orderkey", nested.alias("j"))
    plan = parse.TreePlan({"key": ("$.key", "long")}, children={"item": ("$.items", {"n": ("$.n", "int"), "s": ("$.s", "string")})})
    return parse.tree(docs, "o_orderkey", "j", plan)["item"]


def parse_log_records(spark, d):
    rows = L.lines(table(spark, d, "documents"), "doc_id", "text")
    plan = parse.LogPlan({"first": (0, 0, "whitespace"), "second": (1, 0, "comma")}, "fixed_lines", 2)
    return parse.log(rows, plan).select("id", "record_no", "first", "second", F.length("text").alias("n"))


def parse_key_values(spark, d):
    lines = F.array(F.concat(F.lit("Brand: "), "p_brand"), F.concat(F.lit("Size : "), F.col("p_size").cast("string")), F.lit("no pair"))
    blocks = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(lines).alias("line"))
    return parse.key_value_blocks(blocks, {"brand": "Brand", "size": "Size"})


def provenance_replay(spark, d):
    """Customers but those of one segment against a replay that lacks negative balances and changes the names of a nation."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    replayed = c.where("c_acctbal >= 0").withColumn("c_name", F.when(F.col("c_nationkey") == 3, "changed").otherwise(F.col("c_name")))
    return parse.provenance_differences(c.where("c_mktsegment <> 'BUILDING'"), replayed, ["c_custkey"], ["c_name", "c_nationkey"])


def infer_widths(spark, d):
    return inference.modal_width(_cells(spark, d))


def infer_types(spark, d):
    mixed = F.when(F.col("o_orderkey") % 10 == 0, F.lit("x")).otherwise(F.col("o_orderkey").cast("string"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderstatus", mixed.alias("mixed"))
    return inference.resolved_types(inference.type_votes(rows, ["key", "day", "o_orderstatus", "mixed"]))


QUERIES = {q.__name__: q for q in (parse_tabular, parse_tree, parse_log_records, parse_key_values, provenance_replay, infer_widths, infer_types)}

_LINES = "SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents"
ORACLE_SQL = {
    "parse_tabular": """
        SELECT c_custkey AS row_index, CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_acctbal >= 0 THEN c_name END AS name, CAST(c_nationkey AS VARCHAR) AS nation
        FROM customer WHERE c_custkey >= 2 AND c_custkey NOT IN (7, 9)""",
    "parse_tree": """
        SELECT o_orderkey AS id, 0 AS ordinal, CAST(i AS INTEGER) AS child_ordinal, CAST(i AS INTEGER) AS n, o_orderstatus AS s
        FROM (SELECT *, unnest(range(0, o_orderkey % 3 + 1)) AS i FROM orders)""",
    "parse_log_records": f"""
        WITH l AS ({_LINES}), r AS (SELECT id, line_no // 2 AS record_no, max(line) FILTER (line_no % 2 = 0) AS a, max(line) FILTER (line_no % 2 = 1) AS b FROM l GROUP BY 1, 2)
        SELECT id, record_no, string_split_regex(trim(a), '\\s+')[1] AS first, string_split(b, ',')[1] AS second, CAST(length(a) + coalesce(length(b) + 1, 0) AS INTEGER) AS n FROM r""",
    "parse_key_values": "SELECT p_partkey AS id, p_brand AS brand, CAST(p_size AS VARCHAR) AS size FROM part",
    "provenance_replay": """
        SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'missing' WHEN c_acctbal < 0 THEN 'unexpected' ELSE 'changed' END AS fault FROM customer
        WHERE (c_mktsegment = 'BUILDING') <> (c_acctbal < 0) OR (c_mktsegment <> 'BUILDING' AND c_acctbal >= 0 AND c_nationkey = 3)""",
    "infer_widths": """
        WITH w AS (SELECT CASE WHEN c_acctbal >= 0 THEN 3 ELSE 2 END AS width, count(*) AS n FROM customer GROUP BY 1)
        SELECT CAST(arg_max(width, n * 10 + width) AS BIGINT) AS width, CAST(sum(n) - max(n) AS BIGINT) AS ragged_rows FROM w""",
    "infer_types": """
        SELECT * FROM (SELECT 'key' AS field, 'integer' AS kind, count(*) AS votes, count(*) AS non_null, 'resolved' AS status FROM orders UNION ALL
        SELECT 'day', 'date', count(*), count(*), 'resolved' FROM orders UNION ALL SELECT 'o_orderstatus', 'string', count(*), count(*), 'resolved' FROM orders UNION ALL
        SELECT 'mixed', 'integer', count(*) FILTER (o_orderkey % 10 > 0), count(*), 'ambiguous' FROM orders)""",
}
