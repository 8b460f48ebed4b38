"""Normalizers of scalar text. Each gives struct(value, issue): the value if the text has exactly one reading, else why
it has none. Null passes through. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Grammars of numbers, dates and identifiers.
_SPACE = "[ \\u00a0\\u202f]"
_NUMBER = {"ru": rf"^[+-]?([0-9]{{1,3}}({_SPACE}[0-9]{{3}})+|[0-9]+)(,[0-9]+)?$", "en": r"^[+-]?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)(\.[0-9]+)?$"}
TRUE, FALSE = ("true", "yes", "да"), ("false", "no", "нет")
_ISO = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})$"
_DOTTED = r"^([0-9]{2})\.([0-9]{2})\.([0-9]{4})$"
_SLASHED = r"^([0-9]{2})/([0-9]{2})/([0-9]{4})$"
_ZONED = r"^([0-9./-]{10})[T ]([0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6})?)?)(Z|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])?$"
#: Digits before and after the point that an exact number may have here; what needs more is refused, never rounded.
WHOLE, PLACES = 28, 10
_EMAIL = r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]{1,64}@([A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?)(\.[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?)+$"
_UUID = r"^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"
CURRENCIES = {"$": "USD", "€": "EUR", "£": "GBP", "₽": "RUB", "USD": "USD", "EUR": "EUR", "GBP": "GBP", "RUB": "RUB"}


def _result(value: Column, issue: Column) -> Column:
    return F.struct(value.alias("value"), issue.alias("issue"))


def once(c: Column, of: Callable[[Column], Column]) -> Column:
    """``of(c)`` with ``c`` computed once, however often it is used."""
    return F.get(F.transform(F.array(c), of), F.lit(0))


def trim(c: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.regexp_replace(c, r"^[\s \u0085 -    　]+|[\s \u0085 -    　]+$", "")


def empty_to_null(c: Column, tokens: tuple[str, ...] = ("",)) -> Column:
    return F.when(~c.isin(*tokens), c)


def plain(number: Column) -> Column:
    """A number in digits with a point, in its shortest form: no +, no zeros before or after, no -0."""
    out = F.regexp_replace(number, r"^\+", "")
    out = F.regexp_replace(out, r"^(-?)0+(?=[0-9])", "$1")
    out = F.regexp_replace(F.regexp_replace(out, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.regexp_replace(out, "^-0$", "0")


def exact(number: Column) -> Column:
    """A plain number as a decimal; null where it does not fit without rounding."""
    fits = number.rlike(rf"^-?[0-9]{{1,{WHOLE}}}(\.[0-9]{{1,{PLACES}}})?$")
    return F.when(fits, number).try_cast(f"decimal({WHOLE + PLACES},{PLACES})")


def _readings(c: Column) -> dict[str, Column]:
    one_space = F.size(F.array_distinct(F.regexp_extract_all(c, F.lit(_SPACE), F.lit(0)))) <= 1
    ru = F.when(c.rlike(_NUMBER["ru"]) & one_space, plain(F.translate(F.regexp_replace(c, _SPACE, ""), ",", ".")))
    en = F.when(c.rlike(_NUMBER["en"]), plain(F.regexp_replace(c, ",", "")))
    return {"ru": ru, "en": en, "us": en, "gb": en}


def _number(c: Column, locale: str | None) -> Column:
    """struct(value, issue): a number's plain text by the grammar of ``locale``; without one, both grammars must agree."""
    read = _readings(c)
    if locale:
        return once(read[locale], lambda x: _result(x, F.when(c.isNotNull() & x.isNull(), "INVALID_NUMBER")))

    def judged(x: Column) -> Column:
        ambiguous = F.coalesce(x["ru"] != x["en"], F.lit(False))
        none = c.isNotNull() & x["ru"].isNull() & x["en"].isNull()
        return _result(F.when(~ambiguous, F.coalesce(x["ru"], x["en"])), F.when(ambiguous, "AMBIGUOUS_NUMBER").when(none, "INVALID_NUMBER"))

    return once(F.struct(read["ru"].alias("ru"), read["en"].alias("en")), judged)


def decimal(c: Column, locale: str | None = None) -> Column:
    """An exact number by the grammar of ``locale`` (ru, en); without one, both are tried and must agree. A number with
    more digits than WHOLE or PLACES is an issue."""
    def whole(x: Column) -> Column:
        return _result(exact(x["value"]), F.coalesce(x["issue"], F.when(x["value"].isNotNull() & exact(x["value"]).isNull(), "NUMBER_OUT_OF_RANGE")))

    return once(_number(c, locale), whole)


def integer(c: Column, locale: str | None = None) -> Column:
    """A whole number of 38 digits at most, written without a fraction and without leading zeros."""
    sign = r"[.,][0-9]+$" if locale is None else ",[0-9]+$" if locale == "ru" else r"\.[0-9]+$"
    grouped = F.lit(False) if locale == "ru" else c.rlike(r"^[+-]?[0-9]{1,3}(,[0-9]{3})+$")
    fraction = c.rlike(sign) & ~grouped

    def whole(x: Column) -> Column:
        value = F.when(~fraction & ~c.rlike(r"^[+-]?0[0-9]"), x["value"]).try_cast("decimal(38,0)")
        issue = F.coalesce(x["issue"], F.when(fraction | c.rlike(r"^[+-]?0[0-9]"), "INVALID_INTEGER"))
        return _result(value, F.coalesce(issue, F.when(c.isNotNull() & value.isNull(), "NUMBER_OUT_OF_RANGE")))

    return once(_number(c, locale), whole)


def money(c: Column, currency: str, locale: str | None = None) -> Column:
    """A number beside at most one currency token, which must be the expected one."""
    tokens = "|".join(sorted((t.replace("$", r"\$") for t in CURRENCIES), key=len, reverse=True))
    front, back = F.regexp_extract(c, rf"^({tokens})\s*", 1), F.regexp_extract(c, rf"\s*({tokens})$", 1)
    names = F.create_map(*[F.lit(x) for pair in CURRENCIES.items() for x in pair])
    token = F.when(front != "", front).when(back != "", back)
    bare = F.regexp_replace(F.regexp_replace(c, rf"^({tokens})\s*", ""), rf"\s*({tokens})$", "")
    d = decimal(bare, locale)
    both, wrong = (front != "") & (back != ""), F.element_at(names, token) != currency
    issue = F.when(both, "AMBIGUOUS_CURRENCY").when(wrong, "CURRENCY_MISMATCH").otherwise(d["issue"])
    return _result(F.when(issue.isNull(), d["value"]), issue)


def boolean(c: Column, true: tuple[str, ...] = TRUE, false: tuple[str, ...] = FALSE) -> Column:
    low = F.lower(c)
    value = F.when(low.isin(*true), True).when(low.isin(*false), False)
    return _result(value, F.when(c.isNotNull() & value.isNull(), "INVALID_BOOLEAN"))


def _day(c: Column, pattern: str, year: int, month: int, day: int) -> Column:
    part = lambda i: F.regexp_extract(c, pattern, i)
    return F.when(c.rlike(pattern), F.try_to_date(F.concat_ws("-", part(year), part(month), part(day))))


def date(c: Column, locale: str | None = None) -> Column:
    """ISO; dd.mm.yyyy in ru; with slashes mm/dd in us and dd/mm in gb; without a locale, any of these, and two different
    readings are ambiguous."""
    forms = {"iso": _day(c, _ISO, 1, 2, 3), "ru": _day(c, _DOTTED, 3, 2, 1), "us": _day(c, _SLASHED, 3, 1, 2), "gb": _day(c, _SLASHED, 3, 2, 1)}
    read = {k: v for k, v in forms.items() if k in ("iso", locale) or locale is None}

    def judged(x: Column) -> Column:
        value = F.coalesce(*[x[k] for k in read])
        ambiguous = F.coalesce(x["us"] != x["gb"], F.lit(False)) if locale is None else F.lit(False)
        return _result(F.when(~ambiguous, value), F.when(ambiguous, "AMBIGUOUS_DATE").when(c.isNotNull() & value.isNull(), "INVALID_DATE"))

    return once(F.struct(*[v.alias(k) for k, v in read.items()]), judged)


def datetime(c: Column, locale: str | None = None) -> Column:
    """A date as above and a time with a zone, in UTC; without a zone, or with -00:00, which says that it is unknown, it is
    refused."""
    part = lambda i: F.regexp_extract(c, _ZONED, i)
    zone, formed = part(3), c.rlike(_ZONED)
    clock = F.when(F.length(part(2)) == 5, F.concat(part(2), F.lit(":00"))).otherwise(part(2))
    known = (zone != "") & (zone != "-00:00")

    def judged(day: Column) -> Column:
        value = F.when(formed & known, F.try_to_timestamp(F.concat(day["value"].cast("string"), F.lit("T"), clock, zone)))
        issue = F.coalesce(F.when(formed, day["issue"]), F.when(formed & ~known, "TIMEZONE_REQUIRED"))
        return _result(value, F.coalesce(issue, F.when(c.isNotNull() & value.isNull(), "INVALID_DATETIME")))

    return once(date(F.when(formed, part(1)), locale), judged)


def phone(c: Column) -> Column:
    """+ and 7 to 15 digits, the first not 0, in blanks (no-break ones too), dashes and brackets around digits; 64
    characters at most."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    bracketed = F.regexp_replace(c, r"\([ \u00a0\u202f-]*[0-9][0-9 \u00a0\u202f-]*\)", "")
    fine = (F.length(c) <= 64) & c.rlike(r"^\+[0-9 ()\u00a0\u202f-]+$") & F.length(digits).between(7, 15) & ~digits.startswith("0") & ~bracketed.rlike("[()]")
    value = F.when(fine, F.concat(F.lit("+"), digits))
    return _result(value, F.when(c.isNotNull() & value.isNull(), "INVALID_PHONE"))


def email(c: Column) -> Column:
    """An address of ASCII, 254 letters at most; only the domain is lower-cased."""
    fine = (F.length(c) <= 254) & c.rlike(_EMAIL) & ~c.rlike(r"^\.|\.\.|\.@")
    value = F.when(fine, F.concat(F.substring_index(c, "@", 1), F.lit("@"), F.lower(F.substring_index(c, "@", -1))))
    return _result(value, F.when(c.isNotNull() & value.isNull(), "INVALID_EMAIL"))


def uuid(c: Column) -> Column:
    """Canonical form of 32 hex digits, dashed or not."""
    h = F.lower(F.regexp_replace(c, "-", ""))
    value = F.when(c.rlike(_UUID), F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12)))
    return _result(value, F.when(c.isNotNull() & value.isNull(), "INVALID_UUID"))


def _digit(c: Column, i: int) -> Column:
    return F.substring(c, i, 1).cast("int")


def _checksum(c: Column, weights: tuple[int, ...]) -> Column:
    return sum(_digit(c, i + 1) * w for i, w in enumerate(weights)) % 11 % 10


def inn(c: Column) -> Column:
    """Whether the text is a taxpayer number: 10 or 12 digits with right check digits."""
    ten = _checksum(c, (2, 4, 10, 3, 5, 9, 4, 6, 8)) == _digit(c, 10)
    twelve = (_checksum(c, (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)) == _digit(c, 11)) & (_checksum(c, (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)) == _digit(c, 12))
    return F.when(c.rlike("^[0-9]{10}$"), ten).when(c.rlike("^[0-9]{12}$"), twelve).otherwise(False)


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def card_like(c: Column) -> Column:
    """Whether the text is a payment card: 13 to 19 digits in blanks or dashes, two different ones at least, Luhn."""
    digits = F.regexp_replace(c, "[ -]", "")
    return c.rlike("^[0-9]([ -]?[0-9])*$") & F.length(digits).between(13, 19) & ~digits.rlike(r"^(.)\1*$") & luhn(digits)


def primitive(c: Column) -> Column:
    """A lexical hint: boolean, identifier (a leading zero), integer, decimal, date, timestamp or string."""
    return (
        F.when(F.lower(c).isin("true", "false"), "boolean")
        .when(c.rlike("^0[0-9]+$"), "identifier")
        .when(c.rlike("^[+-]?[0-9]+$"), "integer")
        .when(c.rlike(r"^[+-]?[0-9]+\.[0-9]+$"), "decimal")
        .when(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "date")
        .when(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}"), "timestamp")
        .when(c.isNotNull(), "string")
    )


def chain(c: Column, steps: list[tuple[str, Callable[[Column], Column]]]) -> Column:
    """struct(value, issue, trace) of text put through steps (name, function giving struct(value, issue)).

    All or nothing: the first step that fails gives the issue, and the value is the text as it was. The trace has the
    name and result of each step that changed something; it is empty where a step failed.
    """
    value, issue, trace = c, F.lit(None).cast("string"), []
    for name, step in steps:
        result = step(value)
        after, issue = result["value"].cast("string"), F.coalesce(issue, result["issue"])
        trace.append(F.when(~after.eqNullSafe(value), F.struct(F.lit(name).alias("step"), after.alias("result"))))
        value = after
    made = F.filter(F.array(*trace), lambda x: x.isNotNull() & issue.isNull())
    return F.struct(F.when(issue.isNull(), value).otherwise(c).alias("value"), issue.alias("issue"), made.alias("trace"))


def always(step: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A step of a chain from a function that cannot fail."""
    return lambda c: _result(step(c), F.lit(None).cast("string"))
