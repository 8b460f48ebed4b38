"""Order and structure of lines, cells and rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimenta.operators import lines as L
from sedimenta.operators import structure as S
from sedimenta.queries.texts import _log
from sedimenta.sources.tables import table


def _lines(spark, d):
    return L.lines(table(spark, d, "documents"), "doc_id", "text")


def order_ordinals(spark, d):
    return S.ordinals(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


def line_gaps(spark, d):
    """Gaps between the long lines of each document."""
    return S.gaps(_lines(spark, d).where(F.length("line") >= 80), "id", "line_no")


def key_occurrences(spark, d):
    """How often an order has had the same part before."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_partkey") % 3).alias("kind"))
    placed = rows.withColumn("place", F.struct("l_linenumber", "l_suppkey", F.xxhash64("l_orderkey")))
    return S.occurrences(placed, ["l_orderkey"], "kind", "place").groupBy("kind", "occurrence").agg(F.count(F.lit(1)).alias("n"))


def first_events(spark, d):
    return S.first_of(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


def log_shapes(spark, d):
    return S.shapes(_log(spark, d)).where("role = 'shape'")


def _events_text(spark, d):
    """Lines of each document, a short one blank, every other of the rest indented."""
    rows = _lines(spark, d)
    return rows.withColumn("line", F.when(F.length("line") < 12, "").when(F.col("line_no") % 2 == 1, F.concat(F.lit("  "), "line")).otherwise(F.concat(F.lit("x"), "line")))


def log_multiline(spark, d):
    return S.multiline(_events_text(spark, d)).groupBy("signature").agg(F.count(F.lit(1)).alias("n"), F.sum("first").alias("firsts"), F.sum("last").alias("lasts"))


def section_labels(spark, d):
    """The last long line at or before each line."""
    out = S.section_labels(_lines(spark, d), F.length("line") >= 80, "line")
    return out.groupBy("id").agg(F.count("label").alias("labelled"), F.countDistinct("label").alias("labels"))


def text_chunks(spark, d):
    out = S.chunks(_lines(spark, d), 1000, 0)
    return out.groupBy("id").agg(F.sum("bytes").alias("bytes"), F.max("chunk").alias("last"), F.max(F.when(F.col("first") < F.col("last"), F.col("bytes"))).alias("most"))


def prefix_tail_sample(spark, d):
    return S.prefix_and_tail(_lines(spark, d), "id", "line_no", 3, 2).select("id", "line_no")


def paged_rows(spark, d):
    return S.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 100, 50)


def header_rows(spark, d):
    """The parts as a table of cells below a header, which stands in its first row."""
    cells = L.to_cells(table(spark, d, "part").withColumn("k", F.col("p_partkey") + 1), "k", ["p_name", "p_brand", "p_size", "p_retailprice"]).withColumnRenamed("row_key", "row_index")
    header = spark.createDataFrame([(0, i, n) for i, n in enumerate(("name", "brand", "size", "price"))], "row_index long, column_index int, value string")
    return S.header_candidates(cells.select(F.col("row_index").cast("long"), F.col("column_index"), "value").union(header))


def _tree(spark, d):
    """Regions, nations and customers as one tree of nodes."""
    named = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    r = table(spark, d, "region").select(named("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    n = table(spark, d, "nation").select(named("n", "n_nationkey"), named("r", "n_regionkey"), F.col("n_name"))
    c = table(spark, d, "customer").select(named("c", "c_custkey"), named("n", "c_nationkey"), F.col("c_name"))
    return r.union(n).union(c)


def ancestor_paths(spark, d):
    return S.ancestor_paths(_tree(spark, d)).select("node", "root", "path", F.col("depth").cast("int").alias("depth"))


def chain_faults(spark, d):
    """The tree without one region, and with two nodes that are each other's parent."""
    broken = _tree(spark, d).where("node <> 'r1'").union(spark.createDataFrame([("x", "y", "x"), ("y", "x", "y")], "node string, parent string, name string"))
    return S.chain_faults(broken).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


def repeated_groups(spark, d):
    """Sections of documents by the kinds of their lines: long, short and blank, three lines a section."""
    kind = F.when(F.length("line") >= 80, "long").when(F.trim("line") == "", "blank").otherwise("short")
    rows = _lines(spark, d).select("id", F.floor(F.col("line_no") / 3).alias("section_no"), F.col("line_no").alias("block_no"), kind.alias("kind"))
    return S.repeated_groups(rows)


def blocks_repeating_lines(spark, d):
    """Blocks of three lines, of which those that begin with an even line have their lines' text."""
    rows = _lines(spark, d)
    groups = L.fixed_groups(rows, 3).groupBy("id", F.col("group_no").alias("block_no")).agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    said = F.transform("l", lambda x: x["line"])
    text = F.when(F.col("first") % 2 == 0, F.array_join(said, "\n")).otherwise(F.array_join(said, " | "))
    return S.repeats_of_lines(groups.select("id", "block_no", "first", "last", text.alias("text")), rows)


def exact_slices(spark, d):
    """The first and the last word's letters of each customer's name, by places and hashes."""
    slices = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.sha2(F.substring("c_name", a + 1, b - a), 256).alias("sha256")) for a, b in ((0, 4), (5, 9))])
    return S.spans_of(table(spark, d, "customer").withColumn("s", slices), "c_name", "s").select("c_custkey", "value")


QUERIES = {q.__name__: q for q in (order_ordinals, line_gaps, key_occurrences, first_events, log_shapes, log_multiline, section_labels, text_chunks, prefix_tail_sample, paged_rows, header_rows, ancestor_paths, chain_faults, repeated_groups, blocks_repeating_lines, exact_slices)}

_LINES = "(SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"
ORACLE_SQL = {
    "order_ordinals": "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS ordinal FROM orders",
    "text_chunks": f"""
        WITH RECURSIVE l AS (
            SELECT id, line_no, octet_length(encode(line)) AS n FROM {_LINES}
        ), r AS (
            SELECT id, line_no, CAST(0 AS BIGINT) AS chunk, n AS held, n FROM l WHERE line_no = 0
            UNION ALL SELECT l.id, l.line_no, r.chunk + CASE WHEN r.held + l.n > 1000 THEN 1 ELSE 0 END, CASE WHEN r.held + l.n > 1000 THEN l.n ELSE r.held + l.n END, l.n FROM r JOIN l ON l.id = r.id AND l.line_no = r.line_no + 1
        ), c AS (
            SELECT id, chunk, sum(n) AS bytes, count(*) AS lines FROM r GROUP BY id, chunk
        )
        SELECT id, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(max(chunk) AS INTEGER) AS "last", CAST(max(CASE WHEN lines > 1 THEN bytes END) AS BIGINT) AS most FROM c GROUP BY id""",
    "line_gaps": f"""SELECT id, CAST(after AS INTEGER) AS after, CAST(line_no AS INTEGER) AS before FROM (SELECT *, lag(line_no) OVER (PARTITION BY id ORDER BY line_no) AS after FROM {_LINES} WHERE length(line) >= 80) WHERE line_no <> after + 1""",
    "key_occurrences": """SELECT kind, occurrence, count(*) AS n FROM (SELECT l_partkey % 3 AS kind, CAST(row_number() OVER (PARTITION BY l_orderkey, l_partkey % 3 ORDER BY l_linenumber, l_suppkey) - 1 AS INTEGER) AS occurrence FROM lineitem) GROUP BY 1, 2""",
    "first_events": "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY 1",
    "log_shapes": """SELECT 'shape' AS role, 'timestamp level key_value key_value' AS signature, count(*) AS occurrences, count(*) AS times, count(*) AS levels FROM events""",
    "log_multiline": f"""
        WITH l AS (SELECT id, line_no, length(line) < 12 AS blank, line_no % 2 = 1 AS odd FROM {_LINES}),
             r AS (SELECT *, sum(CAST(blank AS INT)) OVER (PARTITION BY id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM l),
             f AS (SELECT *, min(line_no) FILTER (NOT blank) OVER (PARTITION BY id, coalesce(run, 0)) AS first FROM r)
        SELECT signature, count(*) AS n, CAST(sum(first) AS BIGINT) AS firsts, CAST(sum(last) AS BIGINT) AS lasts FROM (
            SELECT 'indented_continuation' AS signature, first, line_no AS last FROM f WHERE odd AND NOT blank AND line_no > first UNION ALL
            SELECT 'blank_separator', first, line_no - 1 FROM f WHERE blank AND line_no - 1 > first) GROUP BY 1""",
    "section_labels": f"""WITH l AS (SELECT id, last_value(CASE WHEN length(line) >= 80 THEN line END IGNORE NULLS) OVER (PARTITION BY id ORDER BY line_no) AS label FROM {_LINES})
        SELECT id, count(label) AS labelled, count(DISTINCT label) AS labels FROM l GROUP BY 1""",
    "prefix_tail_sample": f"""SELECT id, CAST(line_no AS INTEGER) AS line_no FROM (SELECT *, max(line_no) OVER (PARTITION BY id) AS last FROM {_LINES}) WHERE line_no < 3 OR line_no > last - 2""",
    "paged_rows": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50 OFFSET 100",
    "header_rows": "SELECT CAST(0 AS BIGINT) AS row_index, CAST(0.85 AS DOUBLE) AS score",
    "ancestor_paths": """SELECT 'r' || r_regionkey AS node, 'r' || r_regionkey AS root, r_name AS path, CAST(0 AS INTEGER) AS depth FROM region UNION ALL
        SELECT 'n' || n_nationkey, 'r' || n_regionkey, r_name || '/' || n_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL
        SELECT 'c' || c_custkey, 'r' || n_regionkey, r_name || '/' || n_name || '/' || c_name, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "chain_faults": "SELECT 'missing_parent' AS fault, count(*) AS n FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'deep_or_cyclic', 2",
    "repeated_groups": f"""WITH k AS (SELECT id, line_no // 3 AS s, string_agg(CASE WHEN length(line) >= 80 THEN 'long' WHEN trim(line) = '' THEN 'blank' ELSE 'short' END, ',' ORDER BY line_no) AS kinds FROM {_LINES} GROUP BY 1, 2)
        SELECT kinds, count(*) AS sections FROM k GROUP BY 1 HAVING count(*) > 1""",
    "blocks_repeating_lines": f"SELECT id, CAST(line_no // 3 AS BIGINT) AS block_no FROM {_LINES} GROUP BY 1, 2 HAVING min(line_no) % 2 = 0 OR count(*) = 1",
    "exact_slices": "SELECT c_custkey, substr(c_name, 1, 4) || ' ' || substr(c_name, 6, 4) AS value FROM customer",
}
