"""Names in all their forms, native types, and how good a ranking is."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimenta.functions import forms
from sedimenta.operators import matching
from sedimenta.sources.tables import table

def name_evidence(spark, d):
    """How alike are words that follow each other in a document, by every way of looking."""
    found = F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9À-ÿ]+"), F.lit(0))
    ws = table(spark, d, "documents").select(found.alias("w"))
    pairs = ws.select(F.inline(F.arrays_zip(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))).alias("source"), F.slice("w", F.lit(2), F.size("w")).alias("target")))).toDF("source", "target").distinct()
    found = forms.with_evidence(pairs, "source", "target", free=True)
    return found.select("source", "target", *[F.round(f"evidence.{n}", 6).alias(n) for n in forms.EVIDENCE], F.round(forms.score(F.col("evidence")), 6).alias("score"))


def field_slugs(spark, d):
    """First lines of documents as labels of fields."""
    label = F.split(F.coalesce("text", F.lit("")), "\n", 2)[0]
    return table(spark, d, "documents").select("doc_id", forms.slug(label, F.concat(F.lit("field_of_"), F.col("doc_id").cast("string"))).alias("slug"))


#: Tables whose columns are declared by what they hold.
_DECLARED = ("orders", "part", "customer", "supplier", "nation")


def native_types(spark, d):
    """Types as a target would declare them for what columns hold, read back: texts by their greatest length, prices by
    digits before the point and two after it."""
    out = None
    for name in _DECLARED:
        t = table(spark, d, name)
        texts = [f.name for f in t.schema if f.dataType.simpleString() == "string"]
        prices = [f.name for f in t.schema if f.dataType.simpleString() in ("double", "decimal(15,2)", "decimal(12,2)")]
        size = [F.max(F.length(c)).alias(c) for c in texts] + [F.length(F.max(F.abs(F.col(c))).cast("long").cast("string")).alias(c) for c in prices]
        whole = t.agg(*size)
        rows = [F.struct(F.lit(c).alias("field"), F.concat(F.lit("varchar("), F.col(c).cast("string"), F.lit(")")).alias("declared")) for c in texts]
        rows += [F.struct(F.lit(c).alias("field"), F.concat(F.lit("Numeric ( "), (F.col(c) + 2).cast("string"), F.lit(", 2 )")).alias("declared")) for c in prices]
        if rows:
            part = whole.select(F.inline(F.array(*rows)))
            out = part if out is None else out.union(part)
    return out.select("field", forms.native_type(F.col("declared")).alias("t")).select("field", "t.family", "t.length", "t.precision", "t.scale", "t.affinity")


def ranking_quality(spark, d):
    """Column names of orders against themselves with another prefix: the right one is the first, so all metrics are 1 but
    what was taken without review."""
    names = table(spark, d, "orders").columns
    expected = spark.createDataFrame([(n, n.replace("o_", "x_")) for n in names], "source string, expected string")
    ranked = matching.best_matches(matching.candidates(expected.select("source"), expected.select(F.col("expected").alias("target"))))
    return matching.ranking_metrics(ranked, expected)


QUERIES = {q.__name__: q for q in (name_evidence, field_slugs, native_types, ranking_quality)}


_GENERIC = "['id', 'name', 'date', 'code', 'value', 'row', 'entity']"
_WEIGHT = f"(4 * len({{0}}) - 3 * len(list_intersect({{0}}, {_GENERIC})))"
_STRINGS = """SELECT '{0}' AS field, 'text' AS family, CAST(max(length({0})) AS INTEGER) AS length, CAST(NULL AS INTEGER) AS "precision", CAST(NULL AS INTEGER) AS scale, 'text' AS affinity FROM {1}"""
_PRICES = """SELECT '{0}', 'decimal', NULL, CAST(length(CAST(CAST(floor(max(abs({0}))) AS BIGINT) AS VARCHAR)) + 2 AS INTEGER), 2, 'decimal' FROM {1}"""
_TEXTS = {"orders": ("o_orderstatus", "o_orderpriority"), "part": ("p_name", "p_brand", "p_type"), "customer": ("c_name", "c_mktsegment"), "supplier": ("s_name",), "nation": ("n_name",)}
_MONEY = {"orders": ("o_totalprice",), "part": ("p_retailprice",), "customer": ("c_acctbal",), "supplier": ("s_acctbal",)}

ORACLE_SQL = {
    "name_evidence": rf"""
        WITH p AS (
            SELECT regexp_extract_all(text, '[A-Za-z0-9À-ÿ]+') AS w FROM documents WHERE text IS NOT NULL
        ), q AS (
            SELECT DISTINCT unnest(w[1:len(w) - 1]) AS source, unnest(w[2:len(w)]) AS target FROM p WHERE len(w) > 1
        ), t AS (
            SELECT source, target, list_transform([source, target], lambda x: regexp_extract_all(
                replace(lower(regexp_replace(regexp_replace(x, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z])([A-Z])', '\1 \2', 'g')), 'ß', 'ss'), '[0-9]+|[^0-9\s]+')) AS ab FROM q
        ), u AS (
            SELECT source, target, ab[1] AS a, ab[2] AS b, array_to_string(ab[1], '') AS wa, array_to_string(ab[2], '') AS wb FROM t
        ), m AS (
            SELECT *, list_transform([a, b], lambda x: regexp_split_to_array(trim(replace(replace(replace(replace(' ' || array_to_string(x, '  ') || ' ', ' tax  id ', ' inn '), ' customers ', ' customer '), ' orders ', ' order '), ' products ', ' product ')), ' +')) AS c,
                greatest(length(wa), length(wb)) AS n, damerau_levenshtein(translate(wa, 'àâäçèéêëíîïñóôöùúûüáœ', 'ABCDEFGHIJKLMNOPQRSTU'), translate(wb, 'àâäçèéêëíîïñóôöùúûüáœ', 'ABCDEFGHIJKLMNOPQRSTU')) AS d,
                list_transform([a, b], lambda x: len(list_filter(x, lambda y: NOT list_contains({_GENERIC}, y))) > 0) AS says,
                list_transform([a, b], lambda x: list_filter(x, lambda y: regexp_matches(y, '^[0-9]'))) AS numbers
            FROM u
        ), s AS (
            SELECT source, target, CASE WHEN source = target THEN 1.0 ELSE 0.0 END AS exact, CASE WHEN a = b THEN 0.98 ELSE 0.0 END AS normalized, CASE WHEN wa = wb THEN 0.95 ELSE 0.0 END AS compact,
                round(round(2.0 * {_WEIGHT.format("list_intersect(a, b)")} / ({_WEIGHT.format("list_distinct(a)")} + {_WEIGHT.format("list_distinct(b)")}), 6) * 0.9, 6) AS token, 0.0 AS transliterated,
                CASE WHEN wa <> wb AND least(length(wa), length(wb)) >= 4 AND says[1] AND says[2] AND numbers[1] = numbers[2] AND d <= least(3, n // 4) THEN round(round((n - d) / n, 6) * 0.9, 6) ELSE 0.0 END AS edit,
                CASE WHEN c[1] <> a OR c[2] <> b THEN round(round(2.0 * {_WEIGHT.format("list_intersect(c[1], c[2])")} / ({_WEIGHT.format("list_distinct(c[1])")} + {_WEIGHT.format("list_distinct(c[2])")}), 6) * 0.85, 6) ELSE 0.0 END AS alias
            FROM m
        )
        SELECT source, target, {", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in forms.EVIDENCE)}, CAST(greatest(exact, normalized, compact, token, edit) AS DOUBLE) AS score FROM s""",
    "field_slugs": r"""
        WITH l AS (
            SELECT doc_id, regexp_replace(regexp_replace(lower(split_part(coalesce(text, ''), chr(10), 1)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS low FROM documents
        ), c AS (
            SELECT doc_id, regexp_replace(substr(CASE WHEN regexp_matches(low, '^[0-9]') THEN 'field_' || low ELSE low END, 1, 64), '_+$', '') AS cut FROM l
        )
        SELECT doc_id, CASE WHEN cut <> '' THEN cut ELSE 'field_of_' || doc_id END AS slug FROM c""",
    "native_types": " UNION ALL ".join([_STRINGS.format(c, t) for t, cs in _TEXTS.items() for c in cs] + [_PRICES.format(c, t) for t, cs in _MONEY.items() for c in cs]),
    "ranking_quality": "SELECT CAST(6 AS BIGINT) AS cases, CAST(1 AS DOUBLE) AS recall_1, CAST(1 AS DOUBLE) AS recall_3, CAST(1 AS DOUBLE) AS mrr, CAST(0 AS BIGINT) AS false_auto, CAST(0 AS DOUBLE) AS auto_coverage",
}
