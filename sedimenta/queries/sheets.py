"""Samples of documents' lines, and a sheet that holds several tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.operators import lines as L
from sedimenta.operators import sheets as S
from sedimenta.operators.structure import ordinals
from sedimenta.sources.tables import table

_BUDGET = (6, 3, 900, 250)


def _sampled(spark, d):
    return S.structural_sample(L.lines(table(spark, d, "documents"), "doc_id", "text"), "id", "line_no", "line", *_BUDGET, span=4)


def structural_sample(spark, d):
    return _sampled(spark, d)[0].select("id", "line_no", "part")


def structural_coverage(spark, d):
    covered = _sampled(spark, d)[1]
    return covered.withColumn("reasons", F.array_join("reasons", ","))


#: Parts after which the header is repeated.
_REPEAT = 300


def _sheet(spark, d) -> DataFrame:
    """Parts with a repeated header and a right total, suppliers with a wrong one, nations without; blank rows between."""
    text = lambda *columns: F.array(*[F.col(c).cast("string") for c in columns])
    money = lambda c: F.col(c).cast("decimal(15,2)").cast("string")
    words = lambda *ws: F.array(*[F.lit(w) for w in ws])
    part, supplier, nation = (table(spark, d, t) for t in ("part", "supplier", "nation"))
    one = spark.range(1)

    def section(i: int, rows: DataFrame, key: str, cells, *others: DataFrame) -> DataFrame:
        whole = rows.select(F.lit(i).alias("section"), (F.col(key) * 2).cast("long").alias("place"), cells.alias("cells"))
        return reduce(DataFrame.union, [whole, *[o.select(F.lit(i), *o.columns) for o in others]])

    row = lambda place, cells: one.select(F.lit(place).cast("long"), cells)
    heads = words("name", "brand", "size", "price")
    last = 1 << 40
    parts = section(
        1, part, "p_partkey", F.array("p_name", "p_brand", F.col("p_size").cast("string"), money("p_retailprice")), row(-1, heads), part.where(F.col("p_partkey") % _REPEAT == 0).select((F.col("p_partkey") * 2 + 1).cast("long"), heads),
        part.select(F.lit(last), F.array(F.lit("Total"), F.lit(""), F.sum("p_size").cast("string"), F.sum(F.col("p_retailprice").cast("decimal(15,2)")).cast("string"))), row(last + 1, words("", "", "", "")),
    )
    suppliers = section(2, supplier, "s_suppkey", F.array(F.col("s_name"), F.col("s_nationkey").cast("string"), money("s_acctbal")), row(-1, words("seller", "country", "balance")),
        supplier.select(F.lit(last), F.array(F.lit("TOTAL"), (F.sum("s_nationkey") + 1).cast("string"), F.sum(F.col("s_acctbal").cast("decimal(15,2)")).cast("string"))), row(last + 1, words("", "", "")))
    nations = section(3, nation, "n_nationkey", text("n_name", "n_nationkey", "n_regionkey"), row(-1, words("country", "number", "region")))
    placed = ordinals(parts.union(suppliers).union(nations), "section", "place", name="row_index")
    return placed.select("row_index", "cells")


def table_regions(spark, d):
    found = S.table_regions(S.row_roles(_sheet(spark, d)))
    told = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return found.select("region", told("header"), "first", "last", "columns", "body_rows", "repeated", "segments", "footer_row", told("sums_right"), told("sums_wrong"))


QUERIES = {q.__name__: q for q in (structural_sample, structural_coverage, table_regions)}

_LINES = "(SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"
_SAMPLED = f"""
    WITH l AS (
        SELECT *, octet_length(encode(line)) AS n, row_number() OVER (PARTITION BY id ORDER BY line_no) AS up, row_number() OVER (PARTITION BY id ORDER BY line_no DESC) AS down FROM {_LINES}
    ), s AS (
        SELECT *, sum(n) OVER (PARTITION BY id ORDER BY up) AS above, sum(n) OVER (PARTITION BY id ORDER BY down) AS below FROM l
    ), p AS (
        SELECT *, CASE WHEN up <= {_BUDGET[0]} AND above <= {_BUDGET[2]} THEN 'head' WHEN down <= {_BUDGET[1]} AND below <= {_BUDGET[3]} THEN 'tail' END AS part FROM s
    )"""
_PART = "(SELECT count(*) AS n, count(*) FILTER (p_partkey % 300 = 0) AS again FROM part)"
ORACLE_SQL = {
    "structural_sample": _SAMPLED + "SELECT id, CAST(line_no AS INTEGER) AS line_no, part FROM p WHERE part IS NOT NULL",
    "structural_coverage": _SAMPLED + f""", c AS (
        SELECT id, count(*) AS rows_seen, CAST(sum(n) AS BIGINT) AS bytes_seen, count(part) AS rows_kept, CAST(coalesce(sum(n) FILTER (part IS NOT NULL), 0) AS BIGINT) AS bytes_kept, count(*) FILTER (part = 'head') AS head_rows, count(*) FILTER (part = 'tail') AS tail_rows FROM p GROUP BY id
    ) SELECT *, concat_ws(',', CASE WHEN rows_kept < rows_seen AND (head_rows = {_BUDGET[0]} OR tail_rows = {_BUDGET[1]}) THEN 'sample_items' END, CASE WHEN rows_kept < rows_seen AND (head_rows < {_BUDGET[0]} OR tail_rows < {_BUDGET[1]}) THEN 'sample_bytes' END) AS reasons FROM c""",
    "table_regions": f"""
        WITH p AS {_PART}, s AS (SELECT count(*) AS m FROM supplier), t AS (SELECT count(*) AS k FROM nation)
        SELECT CAST(1 AS BIGINT) AS region, 'name,brand,size,price' AS header, CAST(0 AS BIGINT) AS "first", n + again + 1 AS "last", CAST(4 AS INTEGER) AS columns, n AS body_rows, again AS repeated, again + 1 - (SELECT count(*) FROM part WHERE p_partkey % 300 = 0 AND p_partkey = (SELECT max(p_partkey) FROM part)) AS segments, n + again + 1 AS footer_row, '2,3' AS sums_right, '' AS sums_wrong FROM p
        UNION ALL SELECT 2, 'seller,country,balance', n + again + 3, n + again + m + 4, 3, m, 0, 1, n + again + m + 4, '2', '1' FROM p, s
        UNION ALL SELECT 3, 'country,number,region', n + again + m + 6, n + again + m + k + 6, 3, k, 0, 1, NULL, '', '' FROM p, s, t""",
}
