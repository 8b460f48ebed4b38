"""How the tables relate, by their values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.operators import relate as R
from sedimenta.sources.tables import table

_CUSTOMER, _ORDERS, _LINES = ("c_custkey", "c_name", "in_debt", "rich"), ("o_orderkey", "urgent", "o_orderdate", "large"), ("l_linenumber", "cheap", "returned")


def _levels(spark, d):
    """Customers, orders and lines with fields that only some rows hold."""
    customer = table(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_acctbal") < 0, F.col("c_acctbal")).alias("in_debt"), F.when(F.col("c_acctbal") > 5000, F.col("c_acctbal")).alias("rich"))
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", 1).alias("urgent"), "o_orderdate", F.when(F.col("o_totalprice") > 200000, 1).alias("large"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_extendedprice") < 10000, 1).alias("cheap"), F.when(F.col("l_returnflag") == "R", 1).alias("returned"))
    return customer, orders, lines


def profile_parent_child(spark, d):
    customer, orders, lines = _levels(spark, d)
    upper = R.parent_child_pairs(customer, ["c_custkey"], list(_CUSTOMER), orders, ["o_custkey"], list(_ORDERS))
    return upper.union(R.parent_child_pairs(orders, ["o_orderkey"], list(_ORDERS), lines, ["l_orderkey"], list(_LINES)))


#: Columns by whose values fields are matched: source fields with their entity, target columns with their table.
_SOURCES = {"sale.buyer": ("orders", "o_custkey"), "sale.number": ("orders", "o_orderkey"), "line.sale": ("lineitem", "l_orderkey"), "line.seller": ("lineitem", "l_suppkey"), "line.thing": ("lineitem", "l_partkey"), "seller.country": ("supplier", "s_nationkey"), "visit.person": ("events", "user_id")}
_TARGETS = {"customer.c_custkey": "c_custkey", "customer.c_nationkey": "c_nationkey", "orders.o_orderkey": "o_orderkey", "orders.o_custkey": "o_custkey", "supplier.s_suppkey": "s_suppkey", "part.p_partkey": "p_partkey", "nation.n_nationkey": "n_nationkey", "lineitem.l_orderkey": "l_orderkey"}


def _overlap(spark, d):
    columns = lambda named: {n: (table(spark, d, t), F.col(c)) for n, (t, c) in named.items()}
    targets = {n: (n.split(".")[0], c) for n, c in _TARGETS.items()}
    return R.value_overlap(R.distinct_values(columns(_SOURCES)), R.distinct_values(columns(targets)))


def value_overlaps(spark, d):
    return _overlap(spark, d)


def _possible(spark, d):
    t = {n: table(spark, d, n) for n in ("orders", "customer", "lineitem", "supplier", "part", "nation")}
    returned = t["lineitem"].where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("r_orderkey"), F.col("l_linenumber").alias("r_linenumber"))
    return {
        "orders_customer": (t["orders"], ["o_custkey"], t["customer"], ["c_custkey"]), "lines_orders": (t["lineitem"], ["l_orderkey"], t["orders"], ["o_orderkey"]), "returns_lines": (returned, ["r_orderkey", "r_linenumber"], t["lineitem"], ["l_orderkey", "l_linenumber"]),
        "customer_orders": (t["customer"], ["c_custkey"], t["orders"], ["o_custkey"]), "supplier_nation": (t["supplier"], ["s_nationkey"], t["nation"], ["n_nationkey"]), "part_supplier": (t["part"], ["p_partkey"], t["supplier"], ["s_suppkey"]),
    }


def foreign_keys_found(spark, d):
    return R.foreign_keys(_possible(spark, d))


_EDGES = {
    "orders_customer": ("customer", "orders", (("c_custkey", "o_custkey"),)), "lines_orders": ("orders", "lineitem", (("o_orderkey", "l_orderkey"),)),
    "returns_lines": ("lineitem", "returns", (("l_orderkey", "r_orderkey"), ("l_linenumber", "r_linenumber"))),
}


def _edges(spark, found: DataFrame) -> DataFrame:
    rows = [(fk, p, a, c, b) for fk, (p, c, pairs) in _EDGES.items() for a, b in pairs]
    return spark.createDataFrame(rows, "fk string, parent string, parent_column string, child string, child_column string").join(found.where("holds").select("fk"), "fk", "left_semi")


def graph_support(spark, d):
    """What the keys that hold in the values say of entities whose fields have whole columns' values: one of the two columns of
    the returns' key is anchored, the keys of orders and of lines are whole."""
    found = R.foreign_keys(_possible(spark, d))
    sure = _overlap(spark, d).where("share = 1")
    parts = lambda c, i: F.split(c, r"\.")[i]
    anchors = sure.select(parts("source", 0).alias("entity"), parts("target", 0).alias("table"), parts("target", 1).alias("column"))
    returns = spark.createDataFrame([("return", "returns", "r_orderkey"), ("line", "lineitem", "l_orderkey"), ("sale", "orders", "o_custkey")], "entity string, table string, column string")
    links = spark.createDataFrame([("sale", "line"), ("line", "return"), ("sale", "sale"), ("visit", "sale"), ("line", "line")], "parent_entity string, child_entity string")
    return R.key_support(_edges(spark, found), anchors.union(returns), links)


def relation_topk(spark, d):
    """Entities for both ends of each key, by how far their fields' values are in its tables' columns."""
    found = R.foreign_keys(_possible(spark, d))
    parts = lambda c, i: F.split(c, r"\.")[i]
    shares = _overlap(spark, d).select(parts("source", 0).alias("entity"), parts("target", 0).alias("table"), parts("target", 1).alias("column"), F.col("share").alias("score"))
    tables = shares.groupBy("entity", "table").agg(F.bround(F.avg("score"), 6).alias("score"))
    entities = sorted({s.split(".")[0] for s in _SOURCES})
    links = spark.createDataFrame([(a, b) for a in entities for b in entities if a < b], "parent_entity string, child_entity string")
    return R.relation_candidates(_edges(spark, found), tables, shares, links, 2)


QUERIES = {q.__name__: q for q in (profile_parent_child, value_overlaps, foreign_keys_found, graph_support, relation_topk)}

_C = "(SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN 1 END AS in_debt, CASE WHEN c_acctbal > 5000 THEN 1 END AS rich FROM customer)"
_O = "(SELECT o_custkey, o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END AS urgent, o_orderdate, CASE WHEN o_totalprice > 200000 THEN 1 END AS large FROM orders)"
_L = "(SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice < 10000 THEN 1 END AS cheap, CASE WHEN l_returnflag = 'R' THEN 1 END AS returned FROM lineitem)"
_pairs = lambda p, c, on, left, right: [f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", count(*) AS pairs FROM {p} p JOIN {c} c ON {on} WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a in left for b in right]
_S = " UNION ALL ".join(f"SELECT DISTINCT '{n}' AS source, CAST({c} AS VARCHAR) AS value FROM {t} WHERE {c} IS NOT NULL" for n, (t, c) in _SOURCES.items())
_T = " UNION ALL ".join(f"SELECT DISTINCT '{n}' AS target, CAST({c} AS VARCHAR) AS value FROM {n.split('.')[0]} WHERE {c} IS NOT NULL" for n, c in _TARGETS.items())
_OVERLAP = f"""SELECT source, target, count(*) AS shared, any_value("values") AS "values", round_even(count(*) / any_value("values"), 6) AS share
    FROM (SELECT *, count(*) OVER (PARTITION BY source) AS "values" FROM ({_S})) JOIN ({_T}) USING (value) GROUP BY source, target"""
_RETURNS = "(SELECT l_orderkey AS r_orderkey, l_linenumber AS r_linenumber FROM lineitem WHERE l_returnflag = 'R')"
_KEYS = {
    "orders_customer": ("orders", "o_custkey", "customer", "c_custkey"), "lines_orders": ("lineitem", "l_orderkey", "orders", "o_orderkey"), "returns_lines": (_RETURNS, "(r_orderkey, r_linenumber)", "lineitem", "(l_orderkey, l_linenumber)"),
    "customer_orders": ("customer", "c_custkey", "orders", "o_custkey"), "supplier_nation": ("supplier", "s_nationkey", "nation", "n_nationkey"), "part_supplier": ("part", "p_partkey", "supplier", "s_suppkey"),
}
_FOUND = " UNION ALL ".join(
    f"""SELECT *, missing = 0 AND repeated = 0 AND "rows" > 0 AS holds FROM (SELECT '{fk}' AS fk, (SELECT count(*) FROM {c}) AS "rows", (SELECT count(*) FROM {c} WHERE {a} NOT IN (SELECT {b} FROM {p})) AS missing,
        (SELECT count(*) - count(DISTINCT {b}) FROM {p}) AS repeated)""" for fk, (c, a, p, b) in _KEYS.items()
)
_EDGE_ROWS = "(VALUES " + ", ".join(f"('{fk}', '{p}', '{a}', '{c}', '{b}')" for fk, (p, c, pairs) in _EDGES.items() for a, b in pairs) + ") e(fk, parent, parent_column, child, child_column)"
_HELD = f"edges AS (SELECT e.* FROM {_EDGE_ROWS} WHERE fk IN (SELECT fk FROM ({_FOUND}) WHERE holds))"
_SHARES = f"shares AS (SELECT split_part(source, '.', 1) AS entity, split_part(target, '.', 1) AS tab, split_part(target, '.', 2) AS col, share AS score FROM ({_OVERLAP}))"
ORACLE_SQL = {
    "profile_parent_child": " UNION ALL ".join(f"SELECT * FROM ({q}) WHERE pairs > 0" for q in _pairs(_C, _O, "c_custkey = o_custkey", _CUSTOMER, _ORDERS) + _pairs(_O, _L, "o_orderkey = l_orderkey", _ORDERS, _LINES)),
    "value_overlaps": _OVERLAP,
    "foreign_keys_found": _FOUND,
    "graph_support": f"""
        WITH {_HELD}, {_SHARES}, a AS (
            SELECT DISTINCT entity, tab, col FROM shares WHERE score = 1 UNION SELECT * FROM (VALUES ('return', 'returns', 'r_orderkey'), ('line', 'lineitem', 'l_orderkey'), ('sale', 'orders', 'o_custkey'))
        ), l AS (
            SELECT * FROM (VALUES ('sale', 'line'), ('line', 'return'), ('sale', 'sale'), ('visit', 'sale'), ('line', 'line')) t(p, c)
        ), x AS (
            SELECT fk, l.p, l.c, count(*) AS declared, count(*) FILTER (EXISTS (SELECT 1 FROM a WHERE entity = l.p AND tab = parent AND col = parent_column) AND EXISTS (SELECT 1 FROM a WHERE entity = l.c AND tab = child AND col = child_column)) AS matched
            FROM edges, l WHERE EXISTS (SELECT 1 FROM a WHERE entity = l.p AND tab = parent) AND EXISTS (SELECT 1 FROM a WHERE entity = l.c AND tab = child) GROUP BY fk, l.p, l.c
        )
        SELECT fk, p AS parent_entity, c AS child_entity, declared, matched, CAST(CASE WHEN matched = declared THEN 1 ELSE 0.5 END AS DOUBLE) AS support FROM x""",
    "relation_topk": f"""
        WITH {_HELD}, {_SHARES}, t AS (
            SELECT entity, tab, round_even(avg(score), 6) AS score FROM shares GROUP BY entity, tab
        ), b AS (
            SELECT entity, tab, col, max(score) AS score FROM shares GROUP BY ALL
        ), m AS (
            SELECT e.fk, tp.entity AS parent_entity, tc.entity AS child_entity, any_value(tp.score + tc.score) / 4 AS by_table, avg((bp.score + bc.score) / 4) AS by_column, count(*) AS n
            FROM edges e JOIN t tp ON tp.tab = parent JOIN t tc ON tc.tab = child JOIN b bp ON bp.entity = tp.entity AND bp.tab = parent AND bp.col = parent_column JOIN b bc ON bc.entity = tc.entity AND bc.tab = child AND bc.col = child_column
            WHERE tp.entity <= tc.entity GROUP BY ALL
        ), r AS (
            SELECT fk, parent_entity, child_entity, round_even(by_table + by_column, 6) AS score FROM m WHERE n = (SELECT count(*) FROM edges e WHERE e.fk = m.fk)
        )
        SELECT fk, CAST(rank AS INTEGER) AS rank, parent_entity, child_entity, score FROM (SELECT *, row_number() OVER (PARTITION BY fk ORDER BY score DESC, parent_entity, child_entity) AS rank FROM r) WHERE rank <= 2""",
}
