"""Files written from the tables and read back by each reader."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from sedimenta.operators import structure as S
from sedimenta.plans.records import scratch
from sedimenta.sources import charsets, dialect, files, tables
from sedimenta.sources.tables import table


def source_delimited(spark, d):
    """Parts as delimited text with quotes, read back by the dialect found in it."""
    path = scratch(spark, "delimited")
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string"), F.concat("p_name", F.lit('; "new"')).alias("p_name"), F.concat("p_brand", F.lit("\nsecond line")).alias("p_brand"))
    rows.write.options(sep=";", quote='"', escape='"', quoteAll=True).csv(path)
    found = dialect.detect_file(spark, path)
    back = tables.delimited(spark, path, sep=found.delimiter if found else ";", header=False)
    return back.toDF("p_partkey", "p_name", "p_brand")


def source_json_lines(spark, d):
    path = scratch(spark, "lines")
    rows = table(spark, d, "events").select("event_id", "event_type", F.struct("user_id", "value").alias("who"))
    rows.write.json(path)
    back = tables.json_lines(spark, path, rows.schema)
    return back.select("event_id", "event_type", "who.user_id", "who.value")


def _document_files(spark, d):
    path = scratch(spark, "texts")
    table(spark, d, "documents").select("text").write.text(path)
    return path


def source_physical_lines(spark, d):
    """All documents as text files, line by line: how many lines, letters and ends of each kind."""
    rows = files.physical_lines(spark, _document_files(spark, d))
    numbers = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("line_no").alias("d"), F.max("line_no").alias("last"))
    whole = numbers.agg(F.bool_and((F.col("n") == F.col("d")) & (F.col("n") == F.col("last") + 1)).alias("numbered"))
    sums = rows.agg(F.sum(F.length("line")).alias("letters"), F.count_if(F.col("terminator") == "\n").alias("line_feeds"), F.count_if(F.col("terminator") == "\r\n").alias("both"))
    return sums.crossJoin(whole)  # one row each


def source_encodings(spark, d):
    """Region names as bytes in several encodings."""
    coded = {"utf-8": F.encode(F.concat("r_name", F.lit(" é")), "UTF-8"), "utf-16-be": F.concat(F.unhex(F.lit("FEFF")), F.encode("r_name", "UTF-16BE")), "utf-16-le": F.concat(F.unhex(F.lit("FFFE")), F.encode("r_name", "UTF-16LE")), "utf-8-sig": F.concat(F.unhex(F.lit("EFBBBF")), F.encode("r_name", "UTF-8")), "latin": F.encode(F.concat("r_name", F.lit(" é")), "ISO-8859-1")}
    each = F.array(*[F.struct(F.lit(k).alias("written"), c.alias("content")) for k, c in coded.items()])
    return table(spark, d, "region").select("r_regionkey", F.inline(each)).select("r_regionkey", "written", files.encoding_of(F.col("content")).alias("found"))


#: Sets that documents are written in to be told apart; one of each pair of alike sets.
CHARSETS = ("cp1252", "cp850", "mac-roman", "cp037")


def charsets_found(spark, d):
    """Every document in five sets, and what is found: how many of each as which, those undecided as null."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    fitted = charsets.fit_charsets(docs, "text", list(CHARSETS))

    def write(frames):
        for f in frames:
            rows = []
            for i, t in zip(f["doc_id"], f["text"], strict=True):
                for c in (*CHARSETS, "utf-8"):
                    try:
                        rows.append((i, c, t.isascii(), t.encode(c)))
                    except UnicodeEncodeError:
                        continue
            yield pd.DataFrame(rows, columns=["doc_id", "written", "ascii", "content"])

    coded = docs.mapInPandas(write, "doc_id long, written string, ascii boolean, content binary")
    found = coded.withColumn("c", charsets.charset_of(F.col("content"), fitted))
    return found.groupBy("written", "ascii", F.col("c.encoding").alias("found")).agg(F.count(F.lit(1)).alias("n"), F.bround(F.min("c.confidence"), 4).alias("least"))


def delimited_cells(spark, d):
    """A small table of ragged rows for each customer."""
    text = F.concat(F.lit("id,name\n"), "c_custkey", F.lit(',"'), "c_name", F.lit(', ""x""\nmore"\n\n'), "c_nationkey", F.lit("\n"))
    return files.delimited_cells(table(spark, d, "customer").select("c_custkey", text.alias("t")), "c_custkey", "t")


def _order_json(spark, d):
    items = F.expr("transform(sequence(1, o_orderkey % 3 + 1), i -> named_struct('n', i, 's', o_orderstatus))")
    return table(spark, d, "orders").select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("key"), items.alias("items"))).alias("t"))


def json_nodes(spark, d):
    out = files.nodes(_order_json(spark, d), "o_orderkey", "t", "json")
    return out.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("kind") == "integer", F.col("value").cast("long"))).alias("total"))


def json_paths(spark, d):
    return S.path_statistics(files.nodes(_order_json(spark, d), "o_orderkey", "t", "json"))


def json_record_roots(spark, d):
    return S.record_roots(files.nodes(_order_json(spark, d), "o_orderkey", "t", "json"))


def xml_nodes(spark, d):
    text = F.concat(F.lit("<c n='"), "c_nationkey", F.lit("'><name>"), "c_name", F.lit("</name><seg/><seg>"), "c_mktsegment", F.lit("</seg></c>"))
    out = files.nodes(table(spark, d, "customer").select("c_custkey", text.alias("t")), "c_custkey", "t", "xml")
    return out.select("key", "ordinal", "path", "kind", "value")


def html_nodes(spark, d):
    """Of every page, how many elements, links, active parts and texts it has."""
    out = files.nodes(table(spark, d, "pages"), "page_id", "html", "html")
    is_el = lambda name: F.count_if((F.col("kind") == "element") & (F.col("name") == name))
    return out.groupBy(F.col("key").alias("page_id")).agg(is_el("p").alias("paragraphs"), is_el("li").alias("items"), F.count_if((F.col("kind") == "attribute") & (F.col("name") == "href")).alias("links"), F.count_if((F.col("kind") == "active") & F.col("name").isin("script", "style")).alias("active"))


QUERIES = {q.__name__: q for q in (source_delimited, source_json_lines, source_physical_lines, source_encodings, charsets_found, delimited_cells, json_nodes, json_paths, json_record_roots, xml_nodes, html_nodes)}

_COUNT = lambda tag: f"len(regexp_extract_all(html, '<{tag}[ >]'))"
ORACLE_SQL = {
    "source_delimited": """SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name || '; "new"' AS p_name, p_brand || chr(10) || 'second line' AS p_brand FROM part""",
    "source_json_lines": "SELECT event_id, event_type, user_id, value FROM events",
    "source_physical_lines": """SELECT CAST(sum(length(replace(replace(text, chr(10), ''), chr(13), ''))) AS BIGINT) AS letters,
        CAST(sum(1 + length(text) - length(replace(text, chr(10), '')) - len(regexp_extract_all(text || chr(10), '\\r\\n'))) AS BIGINT) AS line_feeds, CAST(sum(len(regexp_extract_all(text || chr(10), '\\r\\n'))) AS BIGINT) AS both, true AS numbered FROM documents""",
    "source_encodings": "SELECT r_regionkey, w AS written, f AS found FROM region, (VALUES ('utf-8', 'utf-8'), ('utf-16-be', 'utf-16-be'), ('utf-16-le', 'utf-16-le'), ('utf-8-sig', 'utf-8-sig'), ('latin', NULL)) t(w, f)",
    "delimited_cells": """SELECT c_custkey AS key, CAST(r AS INTEGER) AS row_index, CAST(c AS INTEGER) AS column_index, CASE WHEN r = 0 AND c = 0 THEN 'id' WHEN r = 0 THEN 'name' WHEN r = 1 AND c = 0 THEN CAST(c_custkey AS VARCHAR)
        WHEN r = 1 THEN c_name || ', "x"' || chr(10) || 'more' ELSE CAST(c_nationkey AS VARCHAR) END AS value, CAST(CASE WHEN r = 2 THEN 1 ELSE 2 END AS INTEGER) AS width FROM customer, (VALUES (0, 0), (0, 1), (1, 0), (1, 1), (2, 0)) t(r, c)""",
    "json_nodes": """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 3 + 1 AS n FROM orders)
        SELECT 'object' AS kind, CAST(NULL AS VARCHAR) AS name, CAST(sum(1 + n) AS BIGINT) AS n, CAST(NULL AS BIGINT) AS total FROM o UNION ALL SELECT 'integer', 'key', count(*), CAST(sum(k) AS BIGINT) FROM o UNION ALL
        SELECT 'array', 'items', count(*), NULL FROM o UNION ALL SELECT 'integer', 'n', CAST(sum(n) AS BIGINT), CAST(sum(n * (n + 1) // 2) AS BIGINT) FROM o UNION ALL SELECT 'string', 's', CAST(sum(n) AS BIGINT), NULL FROM o""",
    "json_paths": """WITH o AS (SELECT count(*) AS k, CAST(sum(o_orderkey % 3 + 1) AS BIGINT) AS n FROM orders)
        SELECT '' AS path, k AS occurrences, k AS objects, CAST(0 AS BIGINT) AS arrays, CAST(0 AS BIGINT) AS scalars FROM o UNION ALL SELECT '/key', k, 0, 0, k FROM o UNION ALL SELECT '/items', k, 0, k, 0 FROM o UNION ALL
        SELECT '/items/*', n, n, 0, 0 FROM o UNION ALL SELECT '/items/*/n', n, 0, 0, n FROM o UNION ALL SELECT '/items/*/s', n, 0, 0, n FROM o""",
    "json_record_roots": "SELECT '/items/*' AS path, CAST(sum(o_orderkey % 3 + 1) AS BIGINT) AS occurrences, CAST(0.85 AS DOUBLE) AS score FROM orders",
    "xml_nodes": """SELECT c_custkey AS key, CAST(i AS INTEGER) AS ordinal, p AS path, k AS kind, CASE i WHEN 1 THEN CAST(c_nationkey AS VARCHAR) WHEN 3 THEN c_name WHEN 6 THEN c_mktsegment END AS value
        FROM customer, (VALUES (0, '/c[1]', 'element'), (1, '/c[1]/@n', 'attribute'), (2, '/c[1]/name[1]', 'element'), (3, '/c[1]/name[1]/text()[1]', 'text'), (4, '/c[1]/seg[1]', 'element'), (5, '/c[1]/seg[2]', 'element'), (6, '/c[1]/seg[2]/text()[1]', 'text')) t(i, p, k)""",
    "html_nodes": f"""SELECT page_id, CAST({_COUNT('p')} AS BIGINT) AS paragraphs, CAST({_COUNT('li')} AS BIGINT) AS items, CAST(len(regexp_extract_all(html, 'href=')) AS BIGINT) AS links, CAST({_COUNT('script')} + {_COUNT('style')} AS BIGINT) AS active FROM
        (SELECT page_id, regexp_replace(html, '<script>.*?</script>', '<script >', 'g') AS html FROM pages)""",
}
