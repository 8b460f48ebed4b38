"""Profiles of columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimenta.functions import recognise as R
from sedimenta.functions.normalize import primitive
from sedimenta.operators import profile
from sedimenta.operators.matching import best_matches, candidates
from sedimenta.sources.tables import table

_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
_LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag"]


def profile_orders_fields(spark, d):
    return profile.profile_fields(table(spark, d, "orders"), _ORDERS)


def profile_documents_fields(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return profile.profile_fields(docs, ["lang", "source", "quality", "toxic"])


def profile_distinct_exact(spark, d):
    return profile.distinct_exact(table(spark, d, "customer"), _CUSTOMER)


def profile_distinct_kmv(spark, d):
    return profile.distinct_sketch(table(spark, d, "lineitem"), _LINEITEM, 256).select("field", "kept", "kth_hash", "estimate")


def _order_texts(spark, d):
    """Orders with texts that look like something: days, prices, notes that a third state lacks, sentences."""
    o, key = table(spark, d, "orders"), F.col("o_orderkey").cast("string")
    said = F.concat(F.lit("This is what was said of order number "), key)
    return o.select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.concat(F.lit("$"), key).alias("price"), F.when(F.col("o_orderstatus") == "F", said).alias("note"))


def profile_full(spark, d):
    rows = _order_texts(spark, d)
    out = profile.profile_table(rows, present={"note": F.col("o_orderstatus") != "P"})
    text = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",").alias(m)
    plain = ["entity_count", "missing_count", "explicit_null_count", "null_count", "null_ratio", "min_length", "max_length", "mean_length", "min_number", "max_number", "min_day", "max_day", "distinct_count", "exact", "inferred", "status", "identity", "strength"]
    return out.select("field", *plain, text("votes"), text("patterns"), text("reasons"))


def profile_classified(spark, d):
    named = _order_texts(spark, d).select("o_orderkey", "price", F.concat(F.lit("u"), "o_orderkey", F.lit("@example.org")).alias("contact"), F.col("day").alias("first_name"), F.col("note").alias("token_of"))
    out = profile.classified(profile.profile_table(named))
    return out.select("field", F.array_join("categories", ",").alias("categories"), "class", "state")


#: Texts and what they are: patterns, kinds, reasons and categories.
_TEXTS = (
    ("a.b@example.org", "email", "identifier", "", "email"), ("write to a@b.io, please", "", "", "", "email"), ("+49 (30) 1234567", "phone", "identifier", "", "phone"), ("7707083893", "decimal,integer,russian_inn_10", "identifier", "", ""),
    ("500100732259", "decimal,integer,russian_inn_12", "identifier", "", "personal_tax_id"), ("123e4567-e89b-12d3-a456-426614174000", "uuid", "identifier", "", ""), ("https://u:p@example.org:8080/x?y", "url", "identifier", "", "credential"),
    ("http://example.org:70000/", "", "", "", ""), ("1,234", "decimal", "decimal", "locale_ambiguity", ""), ("1 234,5", "decimal", "decimal", "", ""), ("$12.50", "currency,decimal,money", "money", "currency_ambiguity", "financial"),
    ("12 EUR", "currency,decimal,money", "money", "", "financial"), ("0042", "decimal,integer", "identifier", "", ""), ("1", "boolean,decimal,integer", "boolean,integer", "", ""), ("Да", "boolean", "boolean", "", ""), ("03/04/2024", "date", "date", "locale_ambiguity", ""),
    ("31.12.2024", "date", "date", "", ""), ("2024-02-30", "", "", "", ""), ("2024-01-02T03:04", "datetime", "datetime", "naive_datetime", ""), ("2024-01-02T03:04:05Z", "datetime", "datetime", "", ""), ("password: hunter2", "", "", "", "credential"),
    ("just some words that say nothing at all", "free_text", "", "", ""), ("", "", "", "", ""),
)


def recognised_texts(spark, d):
    """Each order's text, one of those above by its key."""
    text = F.when(F.lit(False), "")
    for i, t in enumerate(_TEXTS):
        text = text.when(F.col("o_orderkey") % len(_TEXTS) == i, t[0])
    rows = table(spark, d, "orders").select("o_orderkey", R.scan(text).alias("s"))
    parts = (("patterns", R.PATTERNS), ("kinds", R.KINDS), ("reasons", R.REASONS), ("categories", R.CATEGORIES))
    return rows.select("o_orderkey", *[F.array_join(R.names(F.col(f"s.{p}"), of), ",").alias(p) for p, of in parts])


def profile_bottomk_sample(spark, d):
    return profile.bottom_k_sample(table(spark, d, "customer"), "c_custkey", ["c_name", "c_mktsegment"])


def profile_cooccurrence(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return profile.cooccurrence(docs, ["lang", "source", "quality", "toxic"])


def profile_events_value_kinds(spark, d):
    value = F.get_json_object("props", "$.k")
    return table(spark, d, "events").groupBy("event_type", primitive(value).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def name_match_topk(spark, d):
    """The columns of orders and customer as sources against those of lineitem, supplier and part."""
    names = lambda *ts: [(c,) for t in ts for c in table(spark, d, t).columns]
    sources = spark.createDataFrame(names("orders", "customer"), "source string")
    targets = spark.createDataFrame(names("lineitem", "supplier", "part"), "target string")
    return best_matches(candidates(sources, targets))


QUERIES = {q.__name__: q for q in (profile_orders_fields, profile_documents_fields, profile_distinct_exact, profile_distinct_kmv, profile_full, profile_classified, recognised_texts, profile_bottomk_sample, profile_cooccurrence, profile_events_value_kinds, name_match_topk)}


def _profile_sql(source: str, fields: dict[str, str]) -> str:
    parts = []
    for f, kind in fields.items():
        size = f"length({f})" if kind == "string" else "NULL"
        parts.append(
            f"SELECT '{f}' AS field, '{kind}' AS kind, count(*) AS entity_count, count({f}) AS non_null_count, count(*) - count({f}) AS null_count, "
            f"CAST(round_even(CAST(count(*) - count({f}) AS DECIMAL(28,10)) / count(*), 6) AS DECIMAL(18,6)) AS null_ratio, "
            f"CAST(min({f}) AS VARCHAR) AS min_value, CAST(max({f}) AS VARCHAR) AS max_value, CAST(min({size}) AS BIGINT) AS min_length, "
            f"CAST(max({size}) AS BIGINT) AS max_length, CAST(sum({size}) AS BIGINT) AS total_length FROM {source}"
        )
    return " UNION ALL ".join(parts)


_LABELLED = "(SELECT d.*, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id))"


def _distinct_sql(source: str, fields: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{f}' AS field, count({f}) AS non_null_count, count(DISTINCT {f}) AS distinct_count, "
        f"count({f}) >= 20 AND count(DISTINCT {f}) <= 20 AND count(DISTINCT {f}) * 5 <= count({f}) AS categorical FROM {source}"
        for f in fields
    )


def _estimate(distinct: str, kth: str, n: str, k: int) -> str:
    """The estimate from a kth hash; 52 of its bits are enough to round alike."""
    h = f"CAST(CAST('0x' || substr({kth}, 1, 13) AS BIGINT) AS DOUBLE) * pow(2, 76)"
    return f"CASE WHEN {distinct} <= {k} THEN {distinct} ELSE least({n}, greatest({k + 1}, CAST(round({k - 1} * pow(2, 128) / ({h} + 1)) AS BIGINT))) END"


def _kmv_sql(source: str, fields: dict[str, str], k: int) -> str:
    return " UNION ALL ".join(
        f"SELECT field, kept, kth_hash, {_estimate('d', 'kth_hash', 'n', k)} AS estimate FROM (SELECT '{f}' AS field, count(*) AS kept, max(h) AS kth_hash FROM (SELECT DISTINCT substr(sha256('{kind}:' || CAST({f} AS VARCHAR)), 1, 32) AS h "
        f"FROM {source} WHERE {f} IS NOT NULL ORDER BY h LIMIT {k})), (SELECT count(DISTINCT {f}) AS d, count({f}) AS n FROM {source})"
        for f, kind in fields.items()
    )


_ORDER_TEXTS = """(SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS day, '$' || o_orderkey AS price, o_orderstatus = 'P' AS lacks,
                   CASE WHEN o_orderstatus = 'F' THEN 'This is what was said of order number ' || o_orderkey END AS note FROM orders)"""


def _full_sql() -> str:
    """Of each field what it must be, its distinct values estimated from hashes."""
    told = {  # number, day, votes, patterns, reasons, inferred, status, identity
        "o_orderkey": ("o_orderkey", "NULL", "'integer=' || n", "''", "''", "integer", "resolved", "'identifier'"),
        "o_orderstatus": ("NULL", "NULL", "'string=' || n", "''", "''", "string", "resolved", "NULL"),
        "day": ("NULL", "CAST(day AS DATE)", "'date=' || n", "'date=' || n", "''", "date", "resolved", "NULL"),
        "price": ("o_orderkey", "NULL", "'money=' || n", "'currency=' || n || ',decimal=' || n || ',money=' || n", "'currency_ambiguity=' || n", "money", "ambiguous", "NULL"),
        "note": ("NULL", "NULL", "'string=' || n", "'free_text=' || n", "''", "string", "resolved", "NULL"),
    }
    parts = []
    for f, (number, day, votes, patterns, reasons, inferred, status, identity) in told.items():
        kind = "integer" if f == "o_orderkey" else "string"
        size = f"length({f})" if kind == "string" else "NULL"
        lacks = "count(*) FILTER (lacks)" if f == "note" else "0"
        parts.append(f"""
            SELECT '{f}' AS field, a AS entity_count, CAST(l AS BIGINT) AS missing_count, a - l - n AS explicit_null_count, a - n AS null_count,
                   CAST(round_even(CAST(a - n AS DECIMAL(28,10)) / a, 6) AS DECIMAL(18,6)) AS null_ratio, CAST(least_size AS BIGINT) AS min_length, CAST(most_size AS BIGINT) AS max_length,
                   CAST(round_even(CAST(sizes AS DECIMAL(28,10)) / n, 6) AS DECIMAL(18,6)) AS mean_length, CAST(x AS DECIMAL(38,10)) AS min_number, CAST(y AS DECIMAL(38,10)) AS max_number, v AS min_day, w AS max_day,
                   {_estimate('d', 'kth', 'n', 1024)} AS distinct_count, d <= 1024 AS exact, '{inferred}' AS inferred, '{status}' AS status, {identity} AS identity,
                   CASE WHEN {identity} IS NOT NULL THEN CASE WHEN {_estimate('d', 'kth', 'n', 1024)} * 100 >= n * 95 THEN 'possible_identifier' ELSE 'none' END END AS strength,
                   {votes} AS votes, {patterns} AS patterns, {reasons} AS reasons
            FROM (SELECT count(*) AS a, count({f}) AS n, {lacks} AS l, min({size}) AS least_size, max({size}) AS most_size, sum({size}) AS sizes, min({number}) AS x, max({number}) AS y,
                         CAST(min({day}) AS DATE) AS v, CAST(max({day}) AS DATE) AS w, count(DISTINCT {f}) AS d FROM {_ORDER_TEXTS}),
                 (SELECT max(h) AS kth FROM (SELECT DISTINCT substr(sha256('{kind}:' || CAST({f} AS VARCHAR)), 1, 32) AS h FROM {_ORDER_TEXTS} WHERE {f} IS NOT NULL ORDER BY h LIMIT 1024))""")
    return " UNION ALL ".join(parts)


def _of_texts(at: int) -> str:
    return "CASE " + " ".join(f"WHEN o_orderkey % {len(_TEXTS)} = {i} THEN '{t[at]}'" for i, t in enumerate(_TEXTS)) + " END"


def _sample_sql(source: str, key: str, fields: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{f}' AS field, CAST(row_number() OVER (ORDER BY sha256('0|{f}|' || CAST({key} AS VARCHAR)), CAST({key} AS VARCHAR)) AS INTEGER) AS rank, "
        f"{f} AS value FROM {source} WHERE {f} IS NOT NULL) WHERE rank <= 5"
        for f in fields
    )


_SOURCES = "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority c_custkey c_name c_nationkey c_acctbal c_mktsegment".split()
_TARGETS = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate s_suppkey s_name s_nationkey s_acctbal "
    "p_partkey p_name p_brand p_type p_size p_retailprice"
).split()


def _ranking_sql() -> str:
    """All pairs of names, scored by their words and by edits of their letters, and the three best of each source."""
    values = lambda names: ", ".join(f"('{n}')" for n in names)
    weight = lambda words: f"list_sum(list_transform({words}, lambda w: CASE WHEN w IN ('id', 'name', 'code', 'type', 'value', 'date', 'number', 'key', 'status') THEN 1 ELSE 4 END))"
    return f"""
        WITH p AS (SELECT source, target, string_split(source, '_') AS a, string_split(target, '_') AS b, replace(source, '_', '') AS x, replace(target, '_', '') AS y
                   FROM (VALUES {values(_SOURCES)}) s(source), (VALUES {values(_TARGETS)}) t(target)),
             d AS (SELECT *, 2.0 * coalesce({weight("list_intersect(a, b)")}, 0) / ({weight("list_distinct(a)")} + {weight("list_distinct(b)")}) AS dice, greatest(length(x), length(y)) AS l, levenshtein(x, y) AS e FROM p),
             s AS (SELECT source, target, CASE WHEN source = target THEN 1.0 WHEN a = b THEN 0.98 WHEN x = y THEN 0.95 ELSE round_even(CAST(greatest(0.9 * dice,
                          CASE WHEN least(length(x), length(y)) >= 4 AND e <= least(3, l // 4) THEN 0.9 * (l - e) / l ELSE 0 END) AS DOUBLE), 6) END AS score FROM d),
             r AS (SELECT *, row_number() OVER w AS rank, round(score - coalesce(lead(score) OVER w, 0), 6) AS gap FROM s WINDOW w AS (PARTITION BY source ORDER BY score DESC, target))
        SELECT source, target, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank, CAST(gap AS DOUBLE) AS gap,
               CASE WHEN score >= 0.9 AND gap >= 0.1 THEN 'auto' WHEN score >= 0.7 THEN 'review' ELSE 'rejected' END AS status FROM r WHERE rank <= 3"""


_CO = sorted(["lang", "source", "quality", "toxic"])
ORACLE_SQL = {
    "profile_orders_fields": _profile_sql("orders", {"o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "string", "o_orderpriority": "string"}),
    "profile_documents_fields": _profile_sql(_LABELLED, {"lang": "string", "source": "string", "quality": "integer", "toxic": "integer"}),
    "profile_distinct_exact": _distinct_sql("customer", _CUSTOMER),
    "profile_distinct_kmv": _kmv_sql("lineitem", {"l_orderkey": "integer", "l_partkey": "integer", "l_suppkey": "integer", "l_returnflag": "string"}, 256),
    "name_match_topk": _ranking_sql(),
    "profile_full": _full_sql(),
    "profile_classified": "SELECT * FROM (VALUES ('o_orderkey', '', 'INTERNAL', 'not_detected'), ('price', 'financial', 'CONFIDENTIAL', 'detected'), ('contact', 'email', 'CONFIDENTIAL', 'detected'), ('first_name', 'person_name', 'CONFIDENTIAL', 'detected'), ('token_of', 'credential', 'RESTRICTED', 'detected')) t(field, categories, class, state)",
    "recognised_texts": f"SELECT o_orderkey, {_of_texts(1)} AS patterns, {_of_texts(2)} AS kinds, {_of_texts(3)} AS reasons, {_of_texts(4)} AS categories FROM orders",
    "profile_bottomk_sample": _sample_sql("customer", "c_custkey", ["c_name", "c_mktsegment"]),
    "profile_cooccurrence": " UNION ALL ".join(
        f"SELECT '{a}' AS field_a, '{b}' AS field_b, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS both_count FROM {_LABELLED}" for i, a in enumerate(_CO) for b in _CO[i + 1 :]
    ),
    "profile_events_value_kinds": """
        SELECT event_type, CASE WHEN lower(v) IN ('true', 'false') THEN 'boolean' WHEN regexp_full_match(v, '0[0-9]+') THEN 'identifier'
               WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN 'integer' WHEN regexp_full_match(v, '[+-]?[0-9]+\\.[0-9]+') THEN 'decimal'
               WHEN v IS NOT NULL THEN 'string' END AS kind, count(*) AS n
        FROM (SELECT event_type, json_extract_string(props, '$.k') AS v FROM events) GROUP BY 1, 2""",
}
