"""What a text may be: patterns it has, kinds of value it may stand for, what makes it ambiguous, what it may give away."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedimenta.functions import normalize as N
from sedimenta.functions.normalize import once

# Forms of texts.
_EMAIL = r"[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,63}"
_LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,61}[\p{L}\p{N}])?"
_HOST = rf"{_LABEL}(?:\.{_LABEL})*\.?"
_URL = rf"^https?://(?:[^\s/?#@]*@)?(?:{_HOST}|\[[0-9A-Fa-f:.]+\])(?::(?!0+(?:[/?#]|$))(?:[0-9]{{1,4}}|[1-5][0-9]{{4}}|6[0-4][0-9]{{3}}|65[0-4][0-9]{{2}}|655[0-2][0-9]|6553[0-5]))?(?:[/?#]\S*)?$"
_CURRENCY = r"(?i:RUB|USD|EUR|GBP|₽|\$|€|£|руб\.?)"
_EXT = r"(?i:\s*(?:ext\.?|доб\.?)\s*[0-9]{1,6})"
_CREDENTIAL = r"(?i:(?:password|passwd|api[_-]?key|secret|token|пароль)\s*[:=]\s*\S+)"
_DATETIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6})?)?(Z|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])?$"
BOOLEANS = ("true", "false", "yes", "no", "да", "нет", "0", "1")
PATTERNS = ("boolean", "currency", "date", "datetime", "decimal", "email", "free_text", "integer", "money", "phone", "russian_inn_10", "russian_inn_12", "url", "uuid")
KINDS = ("boolean", "date", "datetime", "decimal", "identifier", "integer", "money")
REASONS = ("currency_ambiguity", "locale_ambiguity", "naive_datetime")
CATEGORIES = ("credential", "email", "financial", "personal_tax_id", "phone")
#: Longer texts are not scanned, and count as skipped.
MOST_BYTES, MOST_DIGITS = 4096, 1024


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def skipped(c: Column) -> Column:
    return (F.octet_length(c) > MOST_BYTES) | (F.length(F.regexp_replace(c, "[^0-9]", "")) > MOST_DIGITS)


def scan(c: Column, locale: str | None = None, money_hint: Column | bool = False) -> Column:
    """struct(patterns, kinds, reasons, categories, number, day, moment): the first four are structs of flags by name, the
    others what the text says as a number, date or time, if it has one reading."""
    hint = F.lit(money_hint) if isinstance(money_hint, bool) else money_hint
    return once(c, lambda c: once(_parts(c), lambda p: once(_readings(p, locale), lambda r: _scanned(c, p, r, hint))))


def _parts(c: Column) -> Column:
    """The text without blanks at its ends, its currency marks, and what is left of a number without them."""
    text, marks = N.trim(c), F.regexp_extract_all(N.trim(c), F.lit(_CURRENCY), F.lit(0))
    at_end = F.coalesce(text.rlike(f"^{_CURRENCY}|{_CURRENCY}$"), F.lit(False))
    bare = F.when(F.size(marks) == 0, text).when((F.size(marks) == 1) & at_end, N.trim(F.regexp_replace(text, _CURRENCY, "")))
    return F.struct(text.alias("text"), marks.alias("marks"), bare.alias("bare"))


def _readings(p: Column, locale: str | None) -> Column:
    has_digit = p["text"].rlike("[0-9]")
    number, day = N._number(F.when(has_digit, p["bare"]), locale), N.date(F.when(has_digit & (F.length(p["text"]) == 10), p["text"]), locale)
    return F.struct(number["value"].alias("number"), number["issue"].alias("issue"), day.alias("day"))


def _signs(c: Column, p: Column, r: Column) -> Column:
    """All that is looked for in a text, each once; cheap signs go before patterns."""
    has = lambda pattern: _flag(c.rlike(pattern))
    at, http, short = _flag(c.contains("@")), _flag(c.startswith("http")), _flag(F.length(c) <= 64)
    bare = F.regexp_replace(c, r"^[<>(),;]+|[<>(),;]+$", "")
    core = F.regexp_replace(c, _EXT + "$", "")
    digits = F.length(F.regexp_replace(core, "[^0-9]", ""))
    is_number = _flag(r["number"].isNotNull() | (r["issue"] == "AMBIGUOUS_NUMBER"))
    moment = F.when(has(_DATETIME), F.try_to_timestamp(F.regexp_replace(c, "(T[0-9]{2}:[0-9]{2})(Z|[+-]|$)", "$1:00$2")))
    found = {
        "mail_like": at & _flag(F.exists(F.split(bare, r"[<>(),;]*\s+[<>(),;]*"), lambda x: x.rlike(f"^(?:{_EMAIL})$"))),
        "email": at & has(rf"^(?:{_EMAIL})$") & _flag(F.substring_index(c, "@", -1).rlike(f"^(?:{_HOST})$")),
        "ten": _flag((F.length(c) == 10) & N.inn(c)), "twelve": _flag((F.length(c) == 12) & N.inn(c)),
        "phone": short & has(rf"^\+?[0-9 ()-]+{_EXT}?$") & _flag(digits.between(10, 15) | (core.startswith("+") & digits.between(7, 15))),
        "uuid": _flag(F.length(c).isin(32, 36)) & has(r"^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})$"),
        "url": http & has(_URL), "login": http & has("^https?://[^/?#]*@"), "credential": has(_CREDENTIAL), "is_number": is_number, "two": _flag(r["issue"] == "AMBIGUOUS_NUMBER"),
        "marked": F.size(p["marks"]) > 0, "marks": (F.size(F.array_distinct(p["marks"])) > 1) | _flag(F.array_contains(p["marks"], "$")), "whole": is_number & _flag(p["bare"].rlike("^[+-]?[0-9]+$")),
        "zero": is_number & _flag(p["bare"].rlike("^[+-]?0[0-9]+$")), "boolean": _flag(F.lower(p["text"]).isin(*BOOLEANS)), "two_days": _flag(r["day"]["issue"] == "AMBIGUOUS_DATE"),
        "zoned": has(r"(?:Z|[+-][0-9]{2}:[0-9]{2})$"), "long": _flag(F.length(c) >= 32), "moment": moment,
    }
    return F.struct(*[v.alias(k) for k, v in found.items()])


def _scanned(c: Column, p: Column, r: Column, hint: Column) -> Column:
    return once(_signs(c, p, r), lambda f: _told(f, r, hint))


def _told(f: Column, r: Column, hint: Column) -> Column:
    phone, tax = f["phone"] & ~f["ten"] & ~f["twelve"], f["ten"] | f["twelve"]
    date, datetime, money = r["day"]["value"].isNotNull() | f["two_days"], f["moment"].isNotNull(), f["is_number"] & (f["marked"] | hint)
    integer, identifier = f["whole"] & ~f["marked"], f["is_number"] & (f["zero"] | tax)
    patterns = {
        "boolean": f["boolean"], "currency": f["is_number"] & f["marked"], "date": date, "datetime": datetime, "decimal": f["is_number"], "email": f["email"], "integer": integer, "money": money, "phone": phone,
        "russian_inn_10": f["ten"], "russian_inn_12": f["twelve"], "url": f["url"], "uuid": f["uuid"],
    }
    some = reduce(lambda a, b: a | b, patterns.values())
    patterns["free_text"] = ~some & f["long"]
    kinds = {
        "boolean": f["boolean"], "date": date, "datetime": datetime, "decimal": f["is_number"] & ~integer & ~identifier & ~money, "identifier": identifier | f["email"] | phone | tax | f["uuid"] | f["url"],
        "integer": integer & ~identifier & ~money, "money": money,
    }
    reasons = {"currency_ambiguity": f["is_number"] & f["marks"], "locale_ambiguity": f["two"] | f["two_days"], "naive_datetime": datetime & ~f["zoned"]}
    categories = {"credential": f["credential"] | (f["url"] & f["login"]), "email": f["mail_like"], "financial": money, "personal_tax_id": f["twelve"], "phone": phone}
    flags = lambda of, found: F.struct(*[found[n].alias(n) for n in of])
    return F.struct(
        flags(PATTERNS, patterns).alias("patterns"), flags(KINDS, kinds).alias("kinds"), flags(REASONS, reasons).alias("reasons"), flags(CATEGORIES, categories).alias("categories"),
        F.when(f["is_number"] & ~f["two"], N.exact(r["number"])).alias("number"), F.when(~f["two_days"], r["day"]["value"]).alias("day"), F.when(f["zoned"], f["moment"]).alias("moment"),
    )


def names(flags: Column, of: tuple[str, ...]) -> Column:
    """The names of the flags that are set."""
    return F.filter(F.array(*[F.when(flags[n], F.lit(n)) for n in of]), lambda x: x.isNotNull())
