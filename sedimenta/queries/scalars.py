"""Normalizers over text rendered from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimenta.functions import normalize as N
from sedimenta.sources.tables import table

def _k():
    return F.col("o_orderkey")


def _case(*texts):
    """One of several texts by the order's key."""
    out = F.when(_k() % len(texts) == 0, texts[0])
    for i, t in enumerate(texts[1:], 1):
        out = out.when(_k() % len(texts) == i, t)
    return out


def _of(spark, d, text, normalizer):
    rows = table(spark, d, "orders").select("o_orderkey", text.alias("t")).select("o_orderkey", "t", normalizer(F.col("t")).alias("r"))
    return rows.select("o_orderkey", F.col("r.value").alias("value"), F.col("r.issue").alias("issue"))


def _text():
    return _k().cast("string")


def _low3():
    return F.lpad((_k() % 1000).cast("string"), 3, "0")


def norm_decimal(spark, d):
    text = _case(_text(), F.concat(_text(), F.lit(".25")), F.concat(_text(), F.lit(",5")), F.concat((_k() % 9 + 1).cast("string"), F.lit(","), _low3()), F.concat((_k() % 9 + 1).cast("string"), F.lit(" "), _low3(), F.lit(",75")), F.concat(F.lit("n/a "), _text()), F.lit(None).cast("string"))
    return _of(spark, d, text, lambda c: N.decimal(c))


_LIMITS = (("1234567890" * 4, None), ("9" * 28, "9" * 28), ("9" * 29, None), ("0.123456789012", None), ("0.1234567890", "0.123456789"), ("-0", "0"), ("+007.50", "7.5"), ("0" * 40 + "5", "5"))


def norm_decimal_limits(spark, d):
    """Numbers of very many digits or places: exact, or an issue."""
    return _of(spark, d, _case(*[F.lit(t) for t, _ in _LIMITS]), lambda c: N.decimal(c, "en"))


def norm_date_locales(spark, d):
    """The same texts by each locale's grammar."""
    day = F.col("o_orderdate")
    text = _case(F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "dd.MM.yyyy"), F.date_format(day, "MM/dd/yyyy"), F.date_format(day, "d.M.yyyy"))
    rows = table(spark, d, "orders").select("o_orderkey", text.alias("t"))
    return rows.select("o_orderkey", *[N.date(F.col("t"), k)["value"].alias(k) for k in ("ru", "us", "gb")])


def norm_integer(spark, d):
    text = _case(_text(), F.concat(F.lit("0"), _text()), F.concat(_text(), F.lit(".5")), F.concat(_text(), F.lit(".0")), F.lit("x"))
    return _of(spark, d, text, lambda c: N.integer(c, "en"))


def norm_money(spark, d):
    text = _case(F.concat(F.lit("$"), _text()), F.concat(_text(), F.lit(" USD")), F.concat(_text(), F.lit(" EUR")), F.concat(F.lit("$ "), _text(), F.lit(" USD")), _text())
    return _of(spark, d, text, lambda c: N.money(c, "USD", "en"))


def norm_boolean(spark, d):
    return _of(spark, d, _case(F.lit("Yes"), F.lit("FALSE"), F.lit("да"), F.lit("maybe"), F.lit(None).cast("string")), lambda c: N.boolean(c))


def norm_date(spark, d):
    day = F.col("o_orderdate")
    text = _case(F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "dd.MM.yyyy"), F.date_format(day, "MM/dd/yyyy"), F.lit("2023-02-30"), F.lit("soon"))
    return _of(spark, d, text, lambda c: N.date(c))


def norm_datetime(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = _case(F.concat(day, F.lit("T10:20:30Z")), F.concat(day, F.lit("T10:20:30+02:00")), F.concat(day, F.lit("T10:20:30")), F.concat(day, F.lit("T10:20:30-00:00")))
    return _of(spark, d, text, lambda c: N.datetime(c))


def norm_phone(spark, d):
    seven = F.lpad((_k() % 10000000).cast("string"), 7, "1")
    text = _case(F.concat(F.lit("+1 (555) "), seven), F.concat(F.lit("+0"), seven), F.concat(F.lit("+49)("), seven), seven, F.concat(F.lit("+4"), seven))
    return _of(spark, d, text, lambda c: N.phone(c))


def norm_email(spark, d):
    text = _case(F.concat(F.lit("User."), _text(), F.lit("@Mail.Example.COM")), F.concat(F.lit("a..b"), _text(), F.lit("@x.org")), F.concat(_text(), F.lit("@localhost")), F.concat(_text(), F.lit("@a-b.io")))
    return _of(spark, d, text, lambda c: N.email(c))


def norm_uuid(spark, d):
    h = F.substring(F.upper(F.sha2(_text(), 256)), 1, 32)
    dashed = F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12))
    return _of(spark, d, _case(h, dashed, h.substr(1, 31)), lambda c: N.uuid(c))


def norm_chain(spark, d):
    """Trim, then empty to null, then e-mail."""
    text = _case(F.concat(F.lit("  u"), _text(), F.lit("@X.ORG ")), F.concat(F.lit(" no"), _text()), F.lit("   "), F.concat(F.lit("u"), _text(), F.lit("@x.org")))
    steps = [("trim", N.always(N.trim)), ("empty_to_null", N.always(N.empty_to_null)), ("email", N.email)]
    rows = table(spark, d, "orders").select("o_orderkey", text.alias("t")).select("o_orderkey", N.chain(F.col("t"), steps).alias("r"))
    return rows.select("o_orderkey", "r.value", "r.issue", F.array_join(F.transform("r.trace", lambda x: x["step"]), ",").alias("steps"))


def luhn_inn_checks(spark, d):
    digits = F.lpad((_k() * 7919 % 10000000000).cast("string"), 10, "7")
    card = F.concat(F.lit("4000"), F.lpad((_k() * 104729 % 1000000000000).cast("string"), 12, "0"))
    return table(spark, d, "orders").select("o_orderkey", N.inn(digits).alias("inn"), N.card_like(card).alias("card"))


QUERIES = {q.__name__: q for q in (norm_decimal, norm_decimal_limits, norm_date_locales, norm_integer, norm_money, norm_boolean, norm_date, norm_datetime, norm_phone, norm_email, norm_uuid, norm_chain, luhn_inn_checks)}


def _case_sql(*texts: str) -> str:
    return "CASE " + " ".join(f"WHEN o_orderkey % {len(texts)} = {i} THEN {t}" for i, t in enumerate(texts)) + " END"


_T = "CAST(o_orderkey AS VARCHAR)"
_L3 = "lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0')"
_L1 = "CAST(o_orderkey % 9 + 1 AS VARCHAR)"
_S7 = "lpad(CAST(o_orderkey % 10000000 AS VARCHAR), 7, '1')"
_H = f"substr(upper(sha256({_T})), 1, 32)"


def _dashed(h: str) -> str:
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12)"


def _digit_sum(text: str, weights) -> str:
    return "(" + " + ".join(f"CAST(substr({text}, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(weights)) + ") % 11 % 10"


_CARD = "'4000' || lpad(CAST(o_orderkey * 104729 % 1000000000000 AS VARCHAR), 12, '0')"
ORACLE_SQL = {
    "norm_decimal": f"""
        SELECT o_orderkey, CAST(v AS DECIMAL(38,10)) AS value, i AS issue FROM (SELECT o_orderkey,
            {_case_sql(_T, f"{_T} || '.25'", f"{_T} || '.5'", "NULL", f"{_L1} || {_L3} || '.75'", "NULL", "NULL")} AS v,
            {_case_sql("NULL", "NULL", "NULL", "'AMBIGUOUS_NUMBER'", "NULL", "'INVALID_NUMBER'", "NULL")} AS i FROM orders)""",
    "norm_decimal_limits": f"""
        SELECT o_orderkey, CAST({_case_sql(*["NULL" if v is None else f"'{v}'" for _, v in _LIMITS])} AS DECIMAL(38,10)) AS value,
               {_case_sql(*["'NUMBER_OUT_OF_RANGE'" if v is None else "NULL" for _, v in _LIMITS])} AS issue FROM orders""",
    "norm_date_locales": """
        WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderkey % 4 AS k, day(o_orderdate) AS d, month(o_orderdate) AS m FROM orders)
        SELECT o_orderkey, CASE WHEN k < 2 OR (k = 3 AND d > 9 AND m > 9) THEN day END AS ru, CASE WHEN k IN (0, 2) THEN day END AS us,
               CASE WHEN k = 0 THEN day WHEN k = 2 AND d <= 12 THEN make_date(year(day), d, m) END AS gb FROM t""",
    "norm_integer": f"""
        SELECT o_orderkey, CAST({_case_sql("o_orderkey", "NULL", "NULL", "NULL", "NULL")} AS DECIMAL(38,0)) AS value,
               {_case_sql("NULL", "'INVALID_INTEGER'", "'INVALID_INTEGER'", "'INVALID_INTEGER'", "'INVALID_NUMBER'")} AS issue FROM orders""",
    "norm_money": f"""
        SELECT o_orderkey, CAST({_case_sql("o_orderkey", "o_orderkey", "NULL", "NULL", "o_orderkey")} AS DECIMAL(38,10)) AS value,
               {_case_sql("NULL", "NULL", "'CURRENCY_MISMATCH'", "'AMBIGUOUS_CURRENCY'", "NULL")} AS issue FROM orders""",
    "norm_boolean": f"SELECT o_orderkey, {_case_sql('true', 'false', 'true', 'NULL', 'NULL')} AS value, {_case_sql('NULL', 'NULL', 'NULL', chr(39) + 'INVALID_BOOLEAN' + chr(39), 'NULL')} AS issue FROM orders",
    "norm_date": f"""
        SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1) OR (o_orderkey % 5 = 2 AND (day(o_orderdate) > 12 OR day(o_orderdate) = month(o_orderdate))) THEN CAST(o_orderdate AS DATE) END AS value,
               CASE WHEN o_orderkey % 5 = 2 AND day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate) THEN 'AMBIGUOUS_DATE'
                    WHEN o_orderkey % 5 > 2 THEN 'INVALID_DATE' END AS issue FROM orders""",
    "norm_datetime": f"""
        SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 37230 SECOND
               WHEN 1 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 30030 SECOND END AS value,
               CASE WHEN o_orderkey % 4 > 1 THEN 'TIMEZONE_REQUIRED' END AS issue FROM orders""",
    "norm_phone": f"""
        SELECT o_orderkey, {_case_sql(f"'+1555' || {_S7}", "NULL", "NULL", "NULL", f"'+4' || {_S7}")} AS value,
               CASE WHEN o_orderkey % 5 IN (1, 2, 3) THEN 'INVALID_PHONE' END AS issue FROM orders""",
    "norm_email": f"""
        SELECT o_orderkey, {_case_sql(f"'User.' || {_T} || '@mail.example.com'", "NULL", "NULL", f"{_T} || '@a-b.io'")} AS value,
               CASE WHEN o_orderkey % 4 IN (1, 2) THEN 'INVALID_EMAIL' END AS issue FROM orders""",
    "norm_uuid": f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN lower({_dashed(_H)}) END AS value, CASE WHEN o_orderkey % 3 = 2 THEN 'INVALID_UUID' END AS issue FROM orders",
    "norm_chain": f"""
        SELECT o_orderkey, {_case_sql(f"'u' || {_T} || '@x.org'", f"' no' || {_T}", "NULL", f"'u' || {_T} || '@x.org'")} AS value,
               CASE WHEN o_orderkey % 4 = 1 THEN 'INVALID_EMAIL' END AS issue, {_case_sql("'trim,email'", "''", "'trim,empty_to_null'", "''")} AS steps FROM orders""",
    "luhn_inn_checks": f"""
        SELECT o_orderkey, {_digit_sum("d", (2, 4, 10, 3, 5, 9, 4, 6, 8))} = CAST(substr(d, 10, 1) AS INT) AS inn,
               list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(c, i, 1) AS INT)
                   ELSE CAST(substr(c, i, 1) AS INT) * 2 - CASE WHEN CAST(substr(c, i, 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0 AS card
        FROM (SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 % 10000000000 AS VARCHAR), 10, '7') AS d, {_CARD} AS c FROM orders)""",
}
