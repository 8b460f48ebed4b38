"""Values of sources in one shape, log events, and states that last from batch to batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimenta.operators import lines as L
from sedimenta.operators import physical as P
from sedimenta.plans.records import scratch
from sedimenta.queries.files import _order_json
from sedimenta.sources import files
from sedimenta.sources.tables import table
from sedimenta.streaming import streams


def _mixed_log(spark, d):
    """Events as log lines of three grammars, one in four of none, a user a file."""
    k, u = F.col("event_id") % 4, F.col("user_id").cast("string")
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    line = (
        F.when(k == 0, F.concat(at, F.lit(" [WARN] said "), "event_type")).when(k == 1, F.concat(F.lit('10.0.0.1 - - [01/Jan/2024:00:00:00 +0000] "GET /'), "event_type", F.lit(' HTTP/1.1" 404 12 "-" "agent x"')))
        .when(k == 2, F.concat(F.lit("type="), "event_type", F.lit(" user="), u)).otherwise(F.lit("  and more of it"))
    )
    return table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("line_no"), line.alias("line"))


def log_events(spark, d):
    return P.log_events(_mixed_log(spark, d)).select("id", F.col("event_no").cast("long").alias("event_no"), "first", "lines", "grammar", "level", "message", "status")


def physical_values(spark, d):
    """How many values of each kind documents, customers as cells and orders as trees hold."""
    cells = L.to_cells(table(spark, d, "customer"), "c_custkey", ["c_name", "c_mktsegment"]).select(F.col("row_key").alias("key"), F.lit(0).alias("row_index"), "column_index", "value")
    out = P.values_of(L.lines(table(spark, d, "documents"), "doc_id", "text"), cells, files.nodes(_order_json(spark, d), "o_orderkey", "t", "json"))
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"))


def texts_once(spark, d):
    """Blocks of the first three lines of each document, and the lines that are in none."""
    rows = L.lines(table(spark, d, "documents"), "doc_id", "text")
    values = P.values_of(rows)
    blocks = rows.where("line_no < 3").groupBy(F.col("id").cast("string").alias("source")).agg(F.collect_list(F.concat(F.lit("line:"), "line_no")).alias("covers"))
    out = P.texts_of(values, blocks.select("source", F.lit("block:0").alias("ref"), F.lit("x").alias("value"), "covers"))
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def source_classes(spark, d):
    """Customers as sources: a name each, a card where the balance is negative, an address where it is large."""
    said = F.when(F.col("c_acctbal") < 0, "card 4111 1111 1111 1111").when(F.col("c_acctbal") > 5000, "to a@b.org")
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("source"), F.explode(F.array_compact(F.array("c_mktsegment", said))).alias("value"))
    return P.classified_sources(rows).groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("findings").alias("findings"))


def json_limits(spark, d):
    """Orders as trees; every ninth within more brackets than a parser takes, every tenth without its end."""
    key, deep = F.col("o_orderkey"), (40 + F.col("o_orderkey") % 3000).cast("int")
    rows = _order_json(spark, d)
    text = F.when(key % 9 == 0, F.concat(F.repeat(F.lit("["), deep), "t", F.repeat(F.lit("]"), deep))).when(key % 10 == 0, F.expr("left(t, length(t) - 1)")).otherwise(F.col("t"))
    return P.json_bounds(rows.withColumn("t", text), "o_orderkey", "t", 3, 15)


def json_strings(spark, d):
    return P.json_strings(files.nodes(_order_json(spark, d), "o_orderkey", "t", "json")).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


def stream_log_events(spark, d):
    """Log lines that come in three batches: an event goes on from one batch to the next."""
    path = scratch(spark, "log")
    rows = _mixed_log(spark, d).select("id", "line_no", "line")
    last = rows.agg(F.max("line_no")).first()[0] or 0
    for i in range(3):  # written in order, so they are read in order
        mine = rows.where((F.col("line_no") * 3 >= i * (last + 1)) & (F.col("line_no") * 3 < (i + 1) * (last + 1)))
        mine.coalesce(1).write.mode("append").parquet(path)
    return streams.numbered_events(spark, path)


QUERIES = {q.__name__: q for q in (log_events, physical_values, texts_once, source_classes, json_limits, json_strings, stream_log_events)}

_LINES = "(SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"
_EVENT = "sum(CAST(event_id % 4 <> 3 AS INT)) OVER (PARTITION BY user_id ORDER BY event_id)"
ORACLE_SQL = {
    "log_events": f"""
        WITH e AS (SELECT user_id AS id, event_id, event_type, CAST({_EVENT} AS BIGINT) AS event_no FROM events), f AS (SELECT id, event_no, min(event_id) AS first, count(*) AS lines, arg_min(event_type, event_id) AS t FROM e GROUP BY 1, 2)
        SELECT id, event_no, first, lines, CASE first % 4 WHEN 0 THEN 'levelled' WHEN 1 THEN 'access' WHEN 2 THEN 'pairs' END AS grammar, CASE WHEN first % 4 = 0 THEN 'WARN' END AS level,
               CASE first % 4 WHEN 0 THEN 'said ' || t WHEN 1 THEN '/' || t END AS message, CAST(CASE WHEN first % 4 = 1 THEN 404 END AS INTEGER) AS status FROM f""",
    "physical_values": f"""SELECT 'line' AS kind, count(*) AS n, count(DISTINCT id) AS sources FROM {_LINES} UNION ALL SELECT 'cell', 2 * count(*), count(*) FROM customer UNION ALL
        SELECT 'node', CAST(sum(1 + 2 * (o_orderkey % 3 + 1)) AS BIGINT), count(*) FROM orders""",
    "texts_once": f"SELECT 'block' AS kind, count(*) AS n FROM documents UNION ALL SELECT 'line', count(*) FROM {_LINES} WHERE line_no >= 3",
    "source_classes": """SELECT CASE WHEN c_acctbal < 0 THEN 'RESTRICTED' WHEN c_acctbal > 5000 THEN 'CONFIDENTIAL' ELSE 'PUBLIC' END AS class, count(*) AS n,
        CAST(sum(CASE WHEN c_acctbal < 0 THEN 2 WHEN c_acctbal > 5000 THEN 1 ELSE 0 END) AS BIGINT) AS findings FROM customer GROUP BY 1""",
    "json_limits": """WITH o AS (SELECT o_orderkey AS key, 5 + 5 * (o_orderkey % 3 + 1) AS n, o_orderkey % 9 = 0 AS deep, o_orderkey % 10 = 0 AS cut FROM orders)
        SELECT key, CASE WHEN deep THEN 3 + 40 + key % 3000 ELSE 3 END AS depth, CASE WHEN deep THEN n + 40 + key % 3000 ELSE n END AS items,
            CASE WHEN deep THEN 'too_deep' WHEN n > 15 THEN 'too_many' WHEN cut THEN 'malformed' END AS fault FROM o""",
    "json_strings": """WITH o AS (SELECT o_orderstatus AS s, o_orderkey % 3 + 1 AS n FROM orders)
        SELECT s AS text, CAST(sum(n) AS BIGINT) AS n FROM o GROUP BY 1 UNION ALL SELECT 'key', count(*) FROM o UNION ALL SELECT 'items', count(*) FROM o UNION ALL SELECT 'n', CAST(sum(n) AS BIGINT) FROM o UNION ALL SELECT 's', CAST(sum(n) AS BIGINT) FROM o""",
    "stream_log_events": f"SELECT user_id AS id, event_id AS line_no, CAST({_EVENT} AS BIGINT) AS event_no FROM events",
}
