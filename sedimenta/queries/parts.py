"""Single steps over whole tables: names of rows, groups, roles, candidates, anchors, scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.functions import forms
from sedimenta.operators import constraints, inference, matching, physical, profile, relate, rules, schema, structure
from sedimenta.operators import lines as L
from sedimenta.plans import parse, records
from sedimenta.queries import relate as shared
from sedimenta.sources.tables import table


def _lines(spark, d):
    return L.lines(table(spark, d, "documents"), "doc_id", "text")


def row_identifiers(spark, d):
    return table(spark, d, "orders").select("o_orderkey", records.identifier("orders", F.col("o_orderkey"), F.col("o_orderstatus"), F.lit(None)).alias("uid"))


def record_lines(spark, d):
    """Of documents of three lines or more, the first two lines as one record and the third as another."""
    long = _lines(spark, d).where("line_no = 2").select("id")
    groups = long.select("id", F.inline(F.array(*[F.struct(F.lit(r).alias("record_no"), F.lit(a).alias("first"), F.lit(b).alias("last")) for r, a, b in ((0, 0, 1), (1, 2, 2))])))
    return structure.explicit_groups(_lines(spark, d), groups)


def lines_by_threes(spark, d):
    return structure.grouped_blocks(_lines(spark, d), 3, "line_no").groupBy("id", F.col("record_no").cast("long").alias("record_no")).agg(F.count(F.lit(1)).alias("n"))


def started_groups(spark, d):
    """A user's events in groups, each beginning at a click."""
    return rules.groups_of(table(spark, d, "events").select("user_id", "event_id", "event_type"), F.col("event_type") == "click", "event_id", "user_id").select("event_id", "group_no")


def headed_sections(spark, d):
    """Short lines as headings of the lines after them."""
    return parse.sections(_lines(spark, d), F.length("line") < 30).groupBy("id", "section_no").agg(F.count(F.lit(1)).alias("n"))


def footer_sums(spark, d):
    """Parts' sizes and prices above a footer that is right about the sizes only."""
    part = table(spark, d, "part")
    cell = lambda i, v: F.struct(F.lit(i).alias("column_index"), v.cast("string").alias("value"))
    price = F.col("p_retailprice").cast("decimal(15,2)")
    body = part.select(F.col("p_partkey").cast("long").alias("row_index"), F.inline(F.array(cell(0, F.col("p_name")), cell(1, F.col("p_size")), cell(2, price))))
    foot = part.agg(F.sum("p_size").alias("s"), F.sum(price).alias("p")).select(F.lit(1 << 40).alias("row_index"), F.inline(F.array(cell(0, F.lit("Total")), cell(1, F.col("s")), cell(2, F.col("p") + 1))))
    return inference.footer_matches(body.union(foot), 1 << 40, [1, 2]).select("column_index", F.col("total").cast("double").alias("total"), F.col("footer").cast("double").alias("footer"), "verified")


def roles_by_first_cell(spark, d):
    """Customers' segments as first cells; every tenth a total, every eleventh empty."""
    first = F.when(F.col("c_custkey") % 10 == 0, F.lit(" Total ")).when(F.col("c_custkey") % 11 == 0, F.lit(" ")).otherwise(F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", inference.row_role(first).alias("role"))


def ranked_plan_candidates(spark, d):
    """A user's events as candidates: the kind is their type, the confidence their value's fraction."""
    rows = table(spark, d, "events").select("user_id", F.col("event_type").alias("kind"), F.col("event_id").alias("id"), F.round(F.col("value") - F.floor("value"), 2).alias("confidence"))
    return structure.ranked_candidates(rows, "user_id", 3).select("user_id", "kind", "id", "rank")


def finding_origins(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("uid"), F.col("o_custkey").alias("record_id"), (F.col("o_orderkey") % 100).alias("entity_id"), "o_totalprice")
    found = orders.where("o_totalprice > 200000").select("uid", F.lit("LARGE").alias("code")).union(spark.createDataFrame([("none", "LOST")], "uid string, code string"))
    return records.origins(found, orders)


def column_labels(spark, d):
    """Segments of customers as cells, a column for each nation; the header is the row of the third region."""
    cells = table(spark, d, "customer").select((F.col("c_custkey") % 5).alias("row_index"), F.col("c_nationkey").alias("column_index"), F.concat(F.lit(" "), "c_mktsegment").alias("value"))
    return physical.labels(cells, 3, 3).select("column_index", F.array_join("labels", ",").alias("labels"))


def refs_not_seen(spark, d):
    required = table(spark, d, "orders").select(F.col("o_custkey").alias("ref"))
    return physical.missing_refs(required, table(spark, d, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("ref")))


def identities_supported(spark, d):
    """Whether columns that are to be keys are there in full and unique, by exact counts of all values."""
    wanted = {"orders": ["o_orderkey"], "customers": ["o_custkey"], "lines": ["l_orderkey", "l_linenumber"], "parts": ["p_partkey"], "none": ["p_none"]}
    held = {"orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_linenumber"], "part": ["p_partkey"]}
    each = []
    for name, fields in held.items():
        t = table(spark, d, name)
        nulls = t.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).isNull().alias("is_null")) for f in fields]))).groupBy("field").agg(F.count_if("is_null").alias("null_count"))
        each.append(profile.distinct_exact(t, fields).join(nulls, "field").select("field", "non_null_count", "distinct_count", "null_count", F.lit(True).alias("exact")))
    return physical.identity_supported(reduce(DataFrame.unionByName, each), wanted)


def _scored(spark, d):
    """Fields against columns by the share of their values that the columns hold."""
    part = lambda c, i: F.split(c, r"\.")[i]
    found = shared._overlap(spark, d)
    return found.select("source", "target", F.col("share").alias("score"), part("source", 0).alias("entity"), part("target", 0).alias("table"))


def entity_tables(spark, d):
    return matching.table_scores(_scored(spark, d).select("entity", "source", "table", "score"), 2)


def sure_targets(spark, d):
    return matching.anchors(_scored(spark, d).select("source", "target", "score"), 0.6, 0.0)


def penalized_matches(spark, d):
    ranked = matching.best_matches(_scored(spark, d).select("source", "target", "score"), 2)
    return matching.with_penalties(ranked).select("source", "target", "rank", "final", "status")


def pattern_shares(spark, d):
    """How much of some columns looks like what kinds of targets expect."""
    fields = {"orders": ["o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority"], "part": ["p_name", "p_size"]}
    votes = reduce(DataFrame.union, [inference.type_votes(table(spark, d, t), fs) for t, fs in fields.items()])
    expected = spark.createDataFrame([("count", "integer"), ("money", "decimal"), ("money", "integer"), ("label", "string")], "kind string, pattern string")
    return matching.pattern_share(votes.select("field", F.col("kind").alias("pattern"), F.col("votes").alias("n"), "non_null"), expected)


def mapping_scores(spark, d):
    """All pairs of a field and a column that share values, weighed by how alike their names are, what these mean, their kinds,
    the share of values, and whether a foreign key that holds leads to the table; what is missing counts nothing."""
    scored = _scored(spark, d)
    name = lambda c: F.substring_index(c, ".", -1)
    pairs = forms.with_evidence(scored.withColumn("_s", name(F.col("source"))).withColumn("_t", F.regexp_replace(name(F.col("target")), "^[a-z]+_", "")), "_s", "_t")
    near = relate.foreign_keys(shared._possible(spark, d)).where("holds").select(F.substring_index("fk", "_", -1).alias("_near")).distinct()
    pairs = pairs.join(near, F.col("table") == F.col("_near"), "left")
    signals = pairs.select("source", "target", forms.score(F.col("evidence")).alias("name"), F.col("evidence.alias").alias("alias"), F.lit(1.0).alias("type"), F.lit(None).cast("double").alias("pattern"), F.col("score").alias("structure"), F.when(F.col("_near").isNotNull(), 1.0).alias("graph"))
    return matching.weighted(signals, list(matching.WEIGHTS)).select("source", "target", F.round("score", 6).alias("score"))


def mixed_comparisons(spark, d):
    """Whole numbers against decimals, and cells that are not there at all."""
    lines = table(spark, d, "lineitem")
    equal = rules.compare("equals", F.col("l_quantity").cast("decimal(12,2)"), F.col("l_linenumber"))
    there = rules.compare("gt", F.col("l_extendedprice"), F.lit(20000.0), "reject", F.col("l_orderkey") % 3 > 0)
    return lines.groupBy(equal["outcome"].alias("equal"), there["outcome"].alias("above"), there["code"].alias("code")).agg(F.count(F.lit(1)).alias("n"))


def name_keys(spark, d):
    return table(spark, d, "part").select("p_partkey", forms.name_key(F.initcap("p_name"), F.col("p_partkey") % 2 == 0).alias("key"))


def copied_fields(spark, d):
    kept = schema.typed_copies(table(spark, d, "part").withColumn("price", F.col("p_retailprice").cast("decimal(15,2)")), {"p_partkey": "integer", "p_name": "string", "price": "money"})
    return kept.select("p_partkey", "p_name", F.col("price").cast("double").alias("price"))


def incomplete_line_groups(spark, d):
    return L.incomplete_groups(_lines(spark, d), 3)


def tree_record_faults(spark, d):
    """Orders' lines as arrays of records: some lack a field, some have a text where a number belongs, some are no array or no JSON."""
    key = F.col("o_orderkey")
    items = F.expr("transform(sequence(0, o_orderkey % 3), i -> concat('{', if(i = 1 and o_orderkey % 4 = 0, '', concat('\"n\": ', if(i = 0 and o_orderkey % 5 = 0, '\"x\"', if(i = 2, 'null', cast(i as string))), ', ')), '\"s\": \"', o_orderstatus, '\"}'))")
    text = F.concat(F.lit('{"items": ['), F.array_join(items, ", "), F.lit("]}"))
    text = F.when(key % 7 == 0, F.lit('{"items": 3}')).when(key % 11 == 0, F.lit('{"items": [')).otherwise(text)
    plan = parse.TreePlan({"n": ("$.n", "int"), "s": ("$.s", "string")}, "$.items")
    return parse.tree_faults(table(spark, d, "orders").select("o_orderkey", text.alias("j")), "o_orderkey", "j", plan, ["n", "s"])


def target_refusals(spark, d):
    """Lines against a declared target: types, lengths, ranges, forms, checks, a unique and two foreign keys, in one frame."""
    lines = table(spark, d, "lineitem")
    number = F.concat_ws("/", "l_orderkey", "l_linenumber")
    uid = F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad("l_orderkey", 12, "0"), F.when(F.col("l_linenumber") == 3, "x").otherwise(""))
    rows = lines.select(number.alias("line"), "l_orderkey", "l_linenumber", uid.alias("uid"), F.when(F.col("l_linenumber") != 7, F.col("l_suppkey")).alias("seller"), F.col("l_partkey").cast("long").alias("part"),
        F.concat("l_returnflag", F.when(F.col("l_linenumber") == 2, F.lit("\0")).otherwise("")).alias("flag"), (F.col("l_extendedprice") * F.when(F.col("l_linenumber") == 1, 1e35).otherwise(1.0)).alias("price"), F.col("l_quantity").cast("decimal(12,2)").alias("quantity"))
    fields = {
        "uid": constraints.Declared("uuid", False), "seller": constraints.Declared("smallint", False), "part": constraints.Declared("TINYINT"), "flag": constraints.Declared("varchar (1)", labels=("A", "N", "A\0")), "price": constraints.Declared("real"),
        "quantity": constraints.Declared("numeric(3, 2)"), "l_linenumber": constraints.Declared("boolean"),
    }
    keys = [
        constraints.Key("line", ("l_orderkey", "flag")), constraints.Key("order", ("l_orderkey",), table(spark, d, "orders").where("o_orderkey % 50 <> 0"), ("o_orderkey",)),
        constraints.Key("pair", ("seller", "part"), lines.where("l_linenumber < 3"), ("l_suppkey", "l_partkey"), True),
    ]
    return constraints.target_issues(rows, "line", fields, keys, {"some": "quantity > 2", "early": "seller <> 5"})


QUERIES = {q.__name__: q for q in (row_identifiers, record_lines, lines_by_threes, started_groups, headed_sections, footer_sums, roles_by_first_cell, ranked_plan_candidates, finding_origins, column_labels, refs_not_seen, identities_supported, entity_tables, sure_targets, penalized_matches, pattern_shares, mapping_scores, mixed_comparisons, name_keys, copied_fields, incomplete_line_groups, tree_record_faults, target_refusals)}

_LINES = "(SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"
_SCORED = f"(SELECT source, target, share AS score, split_part(source, '.', 1) AS entity, split_part(target, '.', 1) AS tab FROM ({shared._OVERLAP}))"
_PLACED = f"""(SELECT source, target, score, rank, round(score - next, 6) AS gap FROM (SELECT *, row_number() OVER w AS rank, coalesce(lead(score) OVER w, 0) AS next FROM {_SCORED} WINDOW w AS (PARTITION BY source ORDER BY score DESC, target)))"""
ORACLE_SQL = {
    "row_identifiers": "SELECT o_orderkey, sha256(concat('6:orders', length(CAST(o_orderkey AS VARCHAR)), ':', o_orderkey, length(o_orderstatus), ':', o_orderstatus, '0:')) AS uid FROM orders",
    "record_lines": f"""WITH l AS {_LINES} SELECT id, CAST(CASE WHEN line_no < 2 THEN 0 ELSE 1 END AS INTEGER) AS record_no, string_agg(line, chr(10) ORDER BY line_no) AS line FROM l
        WHERE line_no < 3 AND id IN (SELECT id FROM l WHERE line_no = 2) GROUP BY 1, 2""",
    "lines_by_threes": f"SELECT id, CAST(line_no // 3 AS BIGINT) AS record_no, count(*) AS n FROM {_LINES} GROUP BY 1, 2",
    "started_groups": "SELECT event_id, CAST(sum(CAST(event_type = 'click' AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS group_no FROM events",
    "headed_sections": f"SELECT id, section_no, count(*) AS n FROM (SELECT id, CAST(sum(CAST(length(line) < 30 AS INT)) OVER (PARTITION BY id ORDER BY line_no) AS BIGINT) AS section_no FROM {_LINES}) GROUP BY 1, 2",
    "footer_sums": """SELECT CAST(1 AS INTEGER) AS column_index, CAST(sum(p_size) AS DOUBLE) AS total, CAST(sum(p_size) AS DOUBLE) AS footer, true AS verified FROM part
        UNION ALL SELECT 2, CAST(sum(CAST(p_retailprice AS DECIMAL(15,2))) AS DOUBLE), CAST(sum(CAST(p_retailprice AS DECIMAL(15,2))) + 1 AS DOUBLE), false FROM part""",
    "roles_by_first_cell": "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'summary' WHEN c_custkey % 11 = 0 THEN 'empty' ELSE 'data' END AS role FROM customer",
    "ranked_plan_candidates": """SELECT user_id, event_type AS kind, event_id AS id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(value - floor(value), 2) DESC, event_type, event_id) AS rank FROM events) WHERE rank <= 3""",
    "finding_origins": "SELECT CAST(o_orderkey AS VARCHAR) AS uid, 'LARGE' AS code, o_custkey AS record_id, o_orderkey % 100 AS entity_id FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT 'none', 'LOST', NULL, NULL",
    "column_labels": "SELECT c_nationkey AS column_index, array_to_string(list_sort(list(DISTINCT c_mktsegment))[1:3], ',') AS labels FROM customer WHERE c_custkey % 5 = 3 GROUP BY 1",
    "refs_not_seen": "SELECT DISTINCT o_custkey AS ref FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10)",
    "identities_supported": """SELECT 'orders' AS entity, count(DISTINCT o_orderkey) = count(*) AS supported FROM orders UNION ALL SELECT 'customers', count(DISTINCT o_custkey) = count(*) FROM orders
        UNION ALL SELECT 'lines', count(DISTINCT l_orderkey) = count(*) AND count(DISTINCT l_linenumber) = count(*) FROM lineitem UNION ALL SELECT 'parts', count(DISTINCT p_partkey) = count(*) FROM part UNION ALL SELECT 'none', false""",
    "entity_tables": f"""WITH s AS {_SCORED}, b AS (SELECT entity, tab, source, max(score) AS score FROM s GROUP BY ALL), n AS (SELECT entity, count(DISTINCT source) AS fields FROM s GROUP BY 1),
        t AS (SELECT entity, tab, round_even(sum(score) / any_value(fields), 6) AS score FROM b JOIN n USING (entity) GROUP BY 1, 2)
        SELECT entity, tab AS "table", score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, tab) AS rank FROM t) WHERE rank <= 2""",
    "sure_targets": f"SELECT source, target, score FROM {_PLACED} WHERE rank = 1 AND score >= 0.6 AND gap >= 0",
    "penalized_matches": f"""WITH p AS {_PLACED}, q AS (SELECT * FROM p WHERE rank <= 2)
        SELECT source, target, CAST(rank AS INTEGER) AS rank, greatest(0, round_even(score - CASE WHEN gap < 0.1 THEN 0.1 ELSE 0 END - CASE WHEN rank = 1 AND (SELECT count(*) FROM q z WHERE z.target = q.target AND z.rank = 1) > 1 THEN 0.1 ELSE 0 END, 6)) AS final,
            CASE WHEN score >= 0.9 AND gap >= 0.1 THEN 'auto' WHEN score >= 0.7 THEN 'review' ELSE 'rejected' END AS status FROM q""",
    "pattern_shares": """WITH v AS (SELECT 'o_orderkey' AS field, CAST(o_orderkey AS VARCHAR) AS v FROM orders UNION ALL SELECT 'o_totalprice', CAST(o_totalprice AS VARCHAR) FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders
            UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders UNION ALL SELECT 'p_name', p_name FROM part UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR) FROM part),
        k AS (SELECT field, CASE WHEN regexp_full_match(v, '[0-9]+') THEN 'integer' WHEN regexp_full_match(v, '[0-9]+\\.[0-9]+') THEN 'decimal' ELSE 'string' END AS pattern FROM v),
        c AS (SELECT field, pattern, count(*) AS n, sum(count(*)) OVER (PARTITION BY field) AS non_null FROM k GROUP BY 1, 2)
        SELECT field, kind, round_even(max(n / non_null), 6) AS share FROM c JOIN (VALUES ('count', 'integer'), ('money', 'decimal'), ('money', 'integer'), ('label', 'string')) e(kind, pattern) USING (pattern) GROUP BY 1, 2""",
    "mapping_scores": f"""SELECT source, target, round_even(0.35 * CASE WHEN split_part(source, '.', 2) = 'x' THEN 1 ELSE 0 END + 0.2 + 0.1 * score + CASE WHEN tab IN ('customer', 'orders', 'lines', 'nation', 'supplier', 'lineitem') AND tab IN (SELECT split_part(fk, '_', 2) FROM ({shared._FOUND}) WHERE holds) THEN 0.05 ELSE 0 END, 6) AS score FROM {_SCORED}""",
    "mixed_comparisons": """SELECT CASE WHEN CAST(l_quantity AS DECIMAL(12,2)) = l_linenumber THEN 'pass' ELSE 'fail' END AS equal, CASE WHEN l_orderkey % 3 = 0 THEN 'indeterminate' WHEN l_extendedprice > 20000 THEN 'pass' ELSE 'fail' END AS above,
        CASE WHEN l_orderkey % 3 = 0 THEN 'RULE_MISSING_OPERAND' WHEN l_extendedprice <= 20000 THEN 'RULE_VIOLATION' END AS code, count(*) AS n FROM lineitem GROUP BY ALL""",
    "name_keys": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') ELSE lower(p_name) END AS key FROM part",
    "copied_fields": "SELECT p_partkey, p_name, CAST(CAST(p_retailprice AS DECIMAL(15,2)) AS DOUBLE) AS price FROM part",
    "incomplete_line_groups": f"SELECT id, count(*) AS lines, 'incomplete_group' AS fault FROM {_LINES} GROUP BY id HAVING count(*) % 3 <> 0",
    "tree_record_faults": """
        WITH r AS (SELECT o_orderkey AS id, unnest(range(0, o_orderkey % 3 + 1)) AS i FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0)
        SELECT o_orderkey AS id, CAST(NULL AS INTEGER) AS ordinal, '$.items' AS field, 'no_records' AS fault FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey, NULL, NULL, 'malformed' FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 7 <> 0
        UNION ALL SELECT id, i, 'n', 'absent' FROM r WHERE i = 1 AND id % 4 = 0 UNION ALL SELECT id, i, 'n', 'type' FROM r WHERE i = 0 AND id % 5 = 0""",
    "target_refusals": """
        WITH l AS (SELECT concat(l_orderkey, '/', l_linenumber) AS k, *, CASE WHEN l_linenumber <> 7 THEN l_suppkey END AS seller, l_returnflag || CASE WHEN l_linenumber = 2 THEN 'z' ELSE '' END AS flag FROM lineitem)
        SELECT k AS row_key, 'field' AS part, 'uid' AS name, 'DB_UUID' AS code FROM l WHERE l_linenumber = 3 UNION ALL SELECT k, 'field', 'seller', 'DB_NOT_NULL' FROM l WHERE seller IS NULL UNION ALL SELECT k, 'field', 'seller', 'DB_INTEGER_RANGE' FROM l WHERE seller > 32767
        UNION ALL SELECT k, 'field', 'part', 'DB_INTEGER_RANGE' FROM l WHERE l_partkey > 127 UNION ALL SELECT k, 'field', 'flag', 'DB_NUL_BYTE' FROM l WHERE l_linenumber = 2 UNION ALL SELECT k, 'field', 'flag', 'DB_LENGTH' FROM l WHERE l_linenumber = 2
        UNION ALL SELECT k, 'field', 'flag', 'DB_ENUM' FROM l WHERE flag NOT IN ('A', 'N', 'Az') UNION ALL SELECT k, 'field', 'price', 'DB_FLOAT_RANGE' FROM l WHERE l_linenumber = 1 AND l_extendedprice * 1e35 > 3.4028234663852886e38
        UNION ALL SELECT k, 'field', 'quantity', 'DB_NUMERIC_RANGE' FROM l WHERE l_quantity >= 10 UNION ALL SELECT k, 'field', 'l_linenumber', 'DB_TYPE' FROM l
        UNION ALL SELECT k, 'check', 'some', 'DB_CHECK' FROM l WHERE NOT l_quantity > 2 UNION ALL SELECT k, 'check', 'early', 'DB_CHECK' FROM l WHERE seller = 5
        UNION ALL SELECT k, 'key', 'line', 'DB_UNIQUE' FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, flag) AS n FROM l) WHERE n > 1 UNION ALL SELECT k, 'key', 'order', 'DB_FOREIGN_KEY' FROM l WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 50 <> 0)
        UNION ALL SELECT k, 'key', 'pair', 'DB_FOREIGN_KEY' FROM l WHERE seller IS NOT NULL AND (l_suppkey, l_partkey) NOT IN (SELECT l_suppkey, l_partkey FROM lineitem WHERE l_linenumber < 3) UNION ALL SELECT k, 'key', 'pair', 'DB_FOREIGN_KEY_PARTIAL' FROM l WHERE seller IS NULL""",
}
