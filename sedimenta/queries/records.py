"""Rows on the way to a target: projection, dependencies, groups, fingerprints, writes that happen once."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from sedimenta.operators import schema as C
from sedimenta.plans import records as R
from sedimenta.sources.tables import table


def _values(spark, d):
    """Customers and their orders as cells of records, one record a customer."""
    c = table(spark, d, "customer")
    own = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(k).alias("kind"), F.col(f).cast("string").alias("value")) for f, k in (("c_custkey", "integer"), ("c_name", "string"))])
    head = c.select(F.col("c_custkey").alias("record_id"), F.lit(0).cast("long").alias("entity_id"), F.lit("customer").alias("entity_type"), F.inline(own))
    o = table(spark, d, "orders")
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.lit("integer").alias("kind"), F.col(f).cast("string").alias("value")) for f in ("o_orderkey", "o_custkey")])
    below = o.select(F.col("o_custkey").alias("record_id"), F.col("o_orderkey").alias("entity_id"), F.lit("order").alias("entity_type"), F.inline(cells))
    return head.union(below)


_MAPPING = {("customer", "c_custkey"): ("people", "id"), ("customer", "c_name"): ("people", "name"), ("order", "o_orderkey"): ("orders", "id"), ("order", "o_custkey"): ("orders", "person")}


def target_projection(spark, d):
    """Target rows of both tables, as their own columns and where they come from."""
    out = R.projected(_values(spark, d), _MAPPING)
    people = out["people"].select("record_id", "entity_id", F.lit("people").alias("target"), "id", F.col("name").alias("other"))
    return people.union(out["orders"].select("record_id", "entity_id", F.lit("orders"), "id", "person"))


def unmapped_records(spark, d):
    """Records without a mapped cell when only orders are mapped."""
    return R.unmapped(_values(spark, d), {k: v for k, v in _MAPPING.items() if k[0] == "order"})


def _rows(spark, d):
    """Suppliers, lines and orders as rows with names of their own, each its own record."""
    o = table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("uid"), F.col("o_orderkey").alias("key"))
    i = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", "l_suppkey").distinct()
    i = i.select(F.concat_ws("-", F.lit("l"), "key", "l_linenumber", "l_suppkey").alias("uid"), "key")
    return o, i


def dependency_edges(spark, d):
    """Of each order, how many of its lines name it."""
    o, i = _rows(spark, d)
    return R.dependency_edges(i, ["key"], o, ["key"]).groupBy(F.col("b").alias("uid")).agg(F.count(F.lit(1)).alias("n"))


def dependency_groups(spark, d):
    """Groups of orders and their lines, orders of one customer being one record: their least row and size."""
    o, i = _rows(spark, d)
    customers = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("c"), "o_custkey").alias("record_id"))
    rows = o.join(customers, F.col("key") == F.col("k")).select("uid", "record_id").union(i.select("uid", F.col("uid").alias("record_id")))
    found = R.dependency_groups(rows, R.dependency_edges(i, ["key"], o, ["key"]))
    return found.groupBy(F.col("group").alias("first_row")).agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("least"))


def parent_faults(spark, d):
    """Orders whose record names a customer: of another nation's records for some, with another key for others."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    parents = c.select(F.col("c_custkey").cast("string").alias("record_id"), F.concat(F.lit("c"), "c_custkey").alias("entity_id"), "c_custkey")
    record = F.when(F.col("o_orderstatus") == "P", F.lit("nowhere")).otherwise(F.col("o_custkey").cast("string"))
    key = F.when(F.col("o_orderstatus") == "F", F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    children = o.select(F.col("o_orderkey").alias("uid"), record.alias("record_id"), F.concat(F.lit("o"), "o_orderkey").alias("entity_id"), F.concat(F.lit("c"), "o_custkey").alias("parent_entity_id"), F.lit(None).cast("string").alias("parent_record_id"), key.alias("k"))
    return R.parent_faults(children, parents, ["k"], ["c_custkey"])


def dataset_fingerprints(spark, d):
    """The fingerprint of the customers' cells does not change with how they are dealt, and does with one value."""
    values = _values(spark, d).where("entity_type = 'customer'")
    of = lambda df: R.dataset_fingerprint(df, "record_id", ["entity_id"]).select("fingerprint", "records")
    one = of(values).withColumnsRenamed({"fingerprint": "a"})
    two = of(values.repartition(5, "value")).select(F.col("fingerprint").alias("b"))
    three = of(values.withColumn("value", F.when(F.col("record_id") == 1, "x").otherwise(F.col("value")))).select(F.col("fingerprint").alias("c"))
    return one.crossJoin(two).crossJoin(three).select("records", (F.col("a") == F.col("b")).alias("same"), (F.col("a") != F.col("c")).alias("differs"))  # one row each


def load_once_ledger(spark, d):
    """Customers loaded twice under one key, those of a nation with a negative balance put aside as a whole."""
    target, ledger = R.scratch(spark, "target"), R.scratch(spark, "ledger")
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("uid"), "c_nationkey", "c_acctbal")
    bad = rows.where("c_acctbal < -900").select("uid", F.lit("RULE_VIOLATION").alias("code"))
    bound = R.binding({"target": "customer", "columns": "c_nationkey,c_acctbal"})
    results = [R.load_once(spark, rows, target, ledger, "first", bound, bad, "c_nationkey") for _ in range(2)]
    there = spark.read.parquet(target).count()
    return spark.createDataFrame([(i, r["rows"], r["quarantined"], r["replayed"], there) for i, r in enumerate(results)], "attempt int, rows long, quarantined long, replayed boolean, stored long")


def staging_faults(spark, d):
    """Events staged by type against a manifest that lacks one type, has one more, and differs in one."""
    staged = table(spark, d, "events").groupBy(F.col("event_type").alias("batch_index")).agg(F.count(F.lit(1)).alias("rows"), F.lit("x").alias("fingerprint"))
    manifest = staged.where("batch_index <> 'click'").withColumn("rows", F.when(F.col("batch_index") == "error", -1).otherwise(F.col("rows"))).union(spark.createDataFrame([("none", 1, "x")], "batch_index string, rows long, fingerprint string"))
    return R.staging_faults(staged, manifest)


def load_column_guards(spark, d):
    columns = spark.createDataFrame([("t", "id", False, True, True, True), ("t", "name", False, False, False, True), ("t", "note", True, False, False, True), ("t", "made", False, True, False, False), ("t", "code", False, False, True, True)], "table string, column string, nullable boolean, has_value boolean, is_key boolean, updatable boolean")
    return R.needs_value(columns, ["id", "note"])


# ---- declared checks


def declared_rules(spark, d):
    """Rules over all orders, two of which cannot be run."""
    declared = [
        C.Rule("price", "gt", ("o_totalprice",), 1000.0), C.Rule("status", "not_equals", ("o_orderstatus",), "P"), C.Rule("due", "date_lt", ("o_orderdate", "o_orderdate")), C.Rule("unknown", "equals", ("o_none",), 1),
        C.Rule("mixed", "equals", ("o_orderkey", "o_orderstatus")), C.Rule("some", "at_least_one", ("o_orderstatus", "o_orderpriority")),
    ]
    out = C.rule_issues(table(spark, d, "orders"), "o_orderkey", declared)
    return out.groupBy("rule", "outcome", "code").agg(F.count(F.lit(1)).alias("n"), F.count("row_key").alias("rows"))


_SCHEMA = {
    "type": "object", "required": ["k", "status", "big"], "additionalProperties": False,
    "properties": {
        "k": {"type": "integer", "minimum": 10, "multipleOf": 5}, "status": {"$ref": "#/$defs/word"}, "big": {"type": "number", "maximum": Decimal("1.5e40"), "exclusiveMinimum": -7}, "wide": {"type": "integer", "multipleOf": 25},
        "tags": {"type": "array", "maxItems": 2, "items": {"enum": ["1-URGENT", "2-HIGH", 3, Decimal("1234567890123456789012.5")]}}, "small": {"exclusiveMinimum": Decimal("2e-30")},
    },
    "$defs": {"word": {"type": "string", "maxLength": 1, "pattern": "^[A-O]"}},
}


def json_schema(spark, d):
    """Orders as JSON: keys, prices with exponents, numbers of up to 60 digits, priorities, some with more or fewer fields, some
    that are no JSON."""
    key, line = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 7
    long = F.concat(F.repeat(key, (F.col("o_orderkey") % 9 + 1).cast("int")), F.lit("0"))
    tags = F.array_join(F.array_compact(F.array(F.concat(F.lit('"'), "o_orderpriority", F.lit('"')), F.when(line == 1, F.lit("3.0")), F.when(line < 3, F.lit("12345678901234567890125e-1")))), ",")
    parts = F.array(
        F.concat(F.lit('"k": '), key, F.when(line == 2, ".00").otherwise("")), F.when(line != 3, F.concat(F.lit('"status": "'), "o_orderstatus", F.lit('"'))),
        F.concat(F.lit('"big": '), F.when(line == 4, "-").otherwise(""), long), F.concat(F.lit('"wide": '), long, F.when(line == 5, "e3").when(line == 6, ".5").otherwise("5")),
        F.concat(F.lit('"tags": ['), tags, F.lit("]")), F.concat(F.lit('"small": '), (F.col("o_orderkey") % 4).cast("string"), F.lit("e-30")), F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit('"more '), key, F.lit('": null'))),
    )
    text = F.concat(F.lit("{"), F.array_join(F.array_compact(parts), ", "), F.when(F.col("o_orderkey") % 13 == 0, "").otherwise("}"))
    return C.json_schema_issues(table(spark, d, "orders").select("o_orderkey", text.alias("t")), "o_orderkey", "t", _SCHEMA)


def check_bindings(spark, d):
    bound = {"positive": "c_acctbal >= 0", "segment": "c_mktsegment <> 'BUILDING' OR c_nationkey > 3", "opaque": None}
    return C.check_issues(table(spark, d, "customer"), "c_custkey", bound)


def column_admission(spark, d):
    catalog = spark.createDataFrame([("customer", c, True) for c in table(spark, d, "customer").columns] + [("region", "r_name", False)], "table string, column string, writable boolean")
    asked = spark.createDataFrame([("customer", "c_name"), ("customer", "c_acctbal"), ("customer", "c_none"), ("region", "r_name"), ("customer", "c_nationkey")], "table string, column string")
    return C.admission_issues(asked, catalog, ["customer.c_acctbal"], ["customer.c_name", "customer.c_none", "region.*"])


QUERIES = {q.__name__: q for q in (target_projection, unmapped_records, dependency_edges, dependency_groups, parent_faults, dataset_fingerprints, load_once_ledger, staging_faults, load_column_guards, declared_rules, json_schema, check_bindings, column_admission)}

ORACLE_SQL = {
    "target_projection": """SELECT c_custkey AS record_id, CAST(0 AS BIGINT) AS entity_id, 'people' AS target, CAST(c_custkey AS VARCHAR) AS id, c_name AS other FROM customer UNION ALL
        SELECT o_custkey, o_orderkey, 'orders', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR) FROM orders""",
    "unmapped_records": "SELECT c_custkey AS record_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "dependency_edges": "SELECT 'o' || l_orderkey AS uid, count(DISTINCT (l_linenumber, l_suppkey)) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1",
    "dependency_groups": """
        WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey FROM lineitem), r AS (
            SELECT 'o' || o_orderkey AS uid, o_custkey AS g FROM orders UNION ALL
            SELECT 'l-' || l_orderkey || '-' || l_linenumber || '-' || l_suppkey, o_custkey FROM l JOIN orders ON o_orderkey = l_orderkey)
        SELECT min(uid) AS first_row, count(*) AS n, min(uid) AS least FROM r GROUP BY g""",
    "parent_faults": "SELECT o_orderkey AS uid, CASE WHEN o_orderstatus = 'P' THEN 'LOAD_FK_PARENT_UNRESOLVED' ELSE 'LOAD_FK_PARENT_MISMATCH' END AS code FROM orders WHERE o_orderstatus IN ('P', 'F')",
    "dataset_fingerprints": "SELECT count(*) AS records, true AS same, true AS differs FROM customer",
    "load_once_ledger": """
        WITH a AS (SELECT c_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal < -900) AS bad FROM customer), s AS (SELECT count(*) FILTER (NOT bad) AS n, count(*) FILTER (bad) AS q FROM a)
        SELECT CAST(i AS INTEGER) AS attempt, n AS rows, q AS quarantined, i = 1 AS replayed, n AS stored FROM s, (VALUES (0), (1)) t(i)""",
    "staging_faults": "SELECT * FROM (VALUES ('click', 'unexpected'), ('error', 'changed'), ('none', 'missing')) t(batch_index, fault)",
    "load_column_guards": "SELECT * FROM (VALUES ('t', 'name', 'LOAD_DEFAULT_UNAVAILABLE'), ('t', 'code', 'LOAD_DEFAULT_UNAVAILABLE'), ('t', 'id', 'LOAD_KEY_UPDATE')) t(\"table\", \"column\", code)",
    "declared_rules": """
        SELECT * FROM (SELECT 'price' AS rule, 'fail' AS outcome, 'RULE_VIOLATION' AS code, count(*) AS n, count(*) AS rows FROM orders WHERE o_totalprice <= 1000 UNION ALL
        SELECT 'status', 'fail', 'RULE_VIOLATION', count(*), count(*) FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'due', 'fail', 'RULE_VIOLATION', count(*), count(*) FROM orders UNION ALL
        SELECT 'unknown', 'indeterminate', 'RULE_FIELD_UNKNOWN', 1, 0 UNION ALL SELECT 'mixed', 'indeterminate', 'RULE_TYPE_MISMATCH', 1, 0) WHERE n > 0""",
    "json_schema": """
        WITH o AS (
            SELECT o_orderkey AS row_key, o_orderstatus AS status, o_orderpriority AS priority, o_orderkey % 7 AS line, repeat(CAST(o_orderkey AS VARCHAR), CAST(o_orderkey % 9 + 1 AS INTEGER)) || '0' AS long FROM orders
        )
        SELECT row_key, '' AS path, 'json' AS keyword FROM o WHERE row_key % 13 = 0
        UNION ALL SELECT o.row_key, x.path, x.keyword FROM o, LATERAL (
            SELECT '/k' AS path, 'minimum' AS keyword WHERE row_key < 10 UNION ALL SELECT '/k', 'multipleOf' WHERE row_key % 5 <> 0
            UNION ALL SELECT '', 'required:status' WHERE line = 3 UNION ALL SELECT '', 'additionalProperties' WHERE row_key % 11 = 0
            UNION ALL SELECT '/status', 'pattern' WHERE line <> 3 AND status > 'O'
            UNION ALL SELECT '/big', 'maximum' WHERE line <> 4 AND (length(long) > 41 OR length(long) = 41 AND long > '15' || repeat('0', 39)) UNION ALL SELECT '/big', 'exclusiveMinimum' WHERE line = 4
            UNION ALL SELECT '/wide', 'type' WHERE line = 6 UNION ALL SELECT '/wide', 'multipleOf' WHERE line <> 5
            UNION ALL SELECT '/tags', 'maxItems' WHERE line = 1 UNION ALL SELECT '/tags/*', 'enum' WHERE priority NOT IN ('1-URGENT', '2-HIGH')
            UNION ALL SELECT '/small', 'exclusiveMinimum' WHERE row_key % 4 <= 2
        ) x WHERE row_key % 13 <> 0""",
    "check_bindings": """SELECT c_custkey AS row_key, 'positive' AS "check", 'DB_CHECK' AS code FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'segment', 'DB_CHECK' FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey <= 3
        UNION ALL SELECT c_custkey, 'opaque', 'DB_CONSTRAINT_UNVERIFIED' FROM customer""",
    "column_admission": "SELECT * FROM (VALUES ('customer', 'c_acctbal', 'DB_COLUMN_DENIED'), ('customer', 'c_none', 'DB_COLUMN_UNKNOWN'), ('region', 'r_name', 'DB_TABLE_NOT_WRITABLE'), ('customer', 'c_nationkey', 'DB_COLUMN_DENIED')) t(\"table\", \"column\", code)",
}
