"""Sensitive spans with offsets, field-name classes, masking and restoring, phrases that try to instruct a reader model.

Spans are arrays of struct(category, start, end) in code points, end exclusive, made from built-in expressions: a text
split at a pattern's matches tells where these are. Texts are split only where there are matches, and at one letter put in
their place: a pattern to split at would be compiled for each text. Phrases are sought in folded texts, whole Arrow batches at a time.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.functions import folding
from sedimenta.functions.normalize import card_like, inn, once

# Patterns of personal data by category.
PERSONAL = {
    "email": r"(?<![A-Za-z0-9.!#$%&'*+/=?^_`{|}~-])[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]{1,64}@[A-Za-z0-9][A-Za-z0-9.-]{0,252}\.[A-Za-z]{2,63}(?![A-Za-z0-9.-])",
    "phone": r"(?<![A-Za-z0-9])\+?[0-9](?:[ ()-]{0,3}[0-9]){6,14}(?![0-9])",
    "inn": r"(?<![0-9])[0-9]{10}(?:[0-9]{2})?(?![0-9])",
    "snils": r"(?<![0-9])[0-9]{3}[- ]?[0-9]{3}[- ]?[0-9]{3}[ -]?[0-9]{2}(?![0-9])",
    "passport": r"(?<![0-9])[0-9]{2}[ ]?[0-9]{2}[ ]{1,3}[0-9]{6}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9][ -]?){12,18}[0-9](?![0-9])",
}
# What stands before a secret, or is one.
_ASSIGNED = r"(?i:(?<![\p{L}\p{N}_])(?:password(?:hash)?|passwd|pwd|api[_-]?key|secret|(?:access[_-]?|refresh[_-]?|auth[_-]?)token|authorization|пароль)[\"']?[ \t]{0,8}[:=][ \t]{0,8})"
_BEARER = r"(?i:(?<![\p{L}\p{N}_])bearer[ \t]{1,8})"
_QUOTED = r"(?:\"(?:[^\"\\]|\\.)*+|'(?:[^'\\]|\\.)*+|[^ \t\r\n,;\"'][^ \t\r\n,;]*+)"
SECRETS = {
    "private_key": r"(?s)-----BEGIN ((?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY|PGP PRIVATE KEY BLOCK)-----(?:.*?-----END \1-----|.*)",
    "assignment": _ASSIGNED + _QUOTED,
    "bearer": _BEARER + _QUOTED,
    "credential_uri": r"[A-Za-z][A-Za-z0-9+.-]{0,31}://[^ \t\r\n\"'<>;/?#@]*@[^ \t\r\n\"'<>;]*",
    "known_token": r"(?<![A-Za-z0-9_./+=$-])(?=[A-Za-z0-9_./+=$-]{20})(?:sk-|ghp_|gho_|ghu_|ghs_|ghr_|github_pat_|AKIA|ASIA|xoxb-|xoxp-|xoxa-|AIza)[A-Za-z0-9_./+=$-]*",
    "jwt": r"(?<![A-Za-z0-9_./+=$-])eyJ[A-Za-z0-9_/+=$-]+\.[A-Za-z0-9_/+=$-]{4,}\.[A-Za-z0-9_/+=$-]{4,}(?![A-Za-z0-9_./+=$-])",
}
#: What of a match is no part of the secret itself.
_BEFORE = {"assignment": _ASSIGNED + "[\"']?", "bearer": _BEARER + "[\"']?"}
CLASSES = ("PUBLIC", "INTERNAL", "CONFIDENTIAL", "RESTRICTED")
RANK = {k: 2 for k in PERSONAL} | {"card": 3} | {k: 3 for k in SECRETS}
# Phrases by code, over folded text; and how severe each is, of none, low, medium, high and critical.
SIGNALS = {
    "instruction_override": r"\b(?:ignore|disregard|forget|override)\s{1,8}(?:(?:all|the|your)\s{1,8})?(?:previous|prior|system|above)\s{1,8}(?:instructions|rules|prompts)\b"
    r"|игнорируй\s{1,8}(?:все\s{1,8})?(?:предыдущие|системные|прежние)\s{1,8}инструкции|(?:забудь|отмени)\s{1,8}(?:все\s{1,8})?(?:правила|инструкции)"
    r"|ignora\s{1,8}(?:las\s{1,8})?instrucciones\s{1,8}anteriores|ignorez\s{1,8}(?:les\s{1,8})?instructions\s{1,8}précédentes"
    r"|ignoriere\s{1,8}(?:alle\s{1,8})?vorherigen\s{1,8}anweisungen|忽略(?:之前|以前|先前|所有)(?:的)?(?:指令|说明|指示)|تجاهل\s{1,8}التعليمات\s{1,8}السابقة",
    "role_spoofing": r"(?:\[|<)\|?(?:im_start|start_header_id|system|developer)\|?(?:\]|>)|\[/?inst\]|</?(?:system|developer)>"
    r"|\byou are now\s{1,8}(?:the\s{1,8})?(?:administrator|system|developer)\b|теперь ты\s{1,8}(?:системный|администратор|разработчик)",
    "secret_exfiltration": r"\b(?:send|reveal|print|exfiltrate|return|upload)\b.{0,64}\b(?:password|secret|api[ _-]?key|access[ _-]?token|credentials|system prompt)\b"
    r"|(?:отправь|раскрой|верни|покажи|выведи).{0,64}(?:парол|секрет|токен|ключ api|системн.{0,12}промпт)|(?:envía|revela).{0,64}(?:contraseña|clave|secreto)|(?:泄露|发送|输出).{0,32}(?:密码|密钥|令牌)",
    "tool_authority": r"\b(?:call|invoke|use|enable)\b.{0,48}\b(?:tool|shell|terminal|database connection)\b|(?:вызови|используй|запусти).{0,48}(?:инструмент|терминал|оболочку)"
    r"|подключись\s{1,8}к\s{1,8}базе\s{1,8}данных|(?:调用|执行).{0,32}(?:工具|终端)",
    "concealment": r"\b(?:do not|don't|never)\s{1,8}(?:mention|reveal|tell)\b.{0,48}\b(?:instructions|user|request)\b|(?:не сообщай|не говори|скрой).{0,48}(?:пользовател|инструкц)",
    "encoded_instruction": r"\bdecode\b.{0,48}\b(?:base64|hex|rot13)\b.{0,48}\b(?:execute|obey|follow|run)\b|(?:декодируй|расшифруй).{0,64}(?:выполни|исполняй|запусти)",
    "active_content": r"```|<script\b|\$\(|\b(?:eval|exec|compile|__import__|os\.system|subprocess\.\w+)\s*\("
    r"|\b(?:select\b.{0,256}?\bfrom|insert\s+into|delete\s+from|(?:drop|alter|create|truncate)\s+(?:table|database)|update\s+\w+\s+set)\b"
    r"|\b(?:import\s+(?:os|sys|subprocess)|from\s+\w+\s+import|def\s+\w+\s*\(|(?:curl|wget|bash|powershell|cmd\.exe)\s+|rm\s+-|python[0-9.]*\s+-c)"
    r"|ignore\s+(?:all\s+)?(?:previous|system)\s+instructions|игнорируй\s+(?:все\s+)?(?:предыдущие|системные)\s+инструкции",
}
LEVELS = ("none", "low", "medium", "high", "critical")
SEVERITY = {k: 3 for k in SIGNALS} | {"secret_exfiltration": 4, "concealment": 2}
# Sensitive field names, by what their letters and digits hold or are.
_HOLDS = (("password", ("password", "passwd", "пароль", "secret")), ("private_key", ("privatekey",)), ("api_key", ("apikey", "connectionstring", "dsn")), ("token", ("token",)))
_IS = {
    "password": ("pwd",), "token": ("authorization", "cookie", "setcookie"), "person_name": ("fullname", "firstname", "lastname", "фио", "фамилия", "имя"),
    "passport": ("passport", "паспорт", "passportnumber"), "email": ("email", "emailaddress", "электроннаяпочта"), "phone": ("phone", "phonenumber", "telephone", "телефон"),
    "inn": ("inn", "инн"), "snils": ("snils", "снилс"), "card": ("cardnumber", "creditcard", "pan", "номеркарты"),
}
_MARK = "\x1f"
_SPANS = "array<struct<category:string,start:int,end:int,value:string>>"


def matches(c: Column, pattern: str, category: str) -> Column:
    """Spans of a pattern's matches, leftmost first, without overlap."""

    def step(acc, pair):
        start = acc["at"] + F.length(pair["before"])
        end = start + F.length(pair["value"])
        span = F.struct(F.lit(category).alias("category"), start.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.array_append(acc["spans"], span).alias("spans"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))

    def placed(x, found):
        between = F.when(F.contains(x, F.lit(_MARK)), F.split(x, pattern, -1)).otherwise(F.split(F.regexp_replace(x, F.lit(pattern), F.lit(_MARK)), _MARK, -1))
        pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda a, b: F.struct(a.alias("before"), b.alias("value")))
        return F.when(F.size(found) == 0, F.array().cast(_SPANS)).otherwise(F.aggregate(pairs, none, step, lambda acc: acc["spans"]))

    # bound, since a column that a function of an item names may be taken for an alias beside it
    return once(c, lambda x: once(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), lambda found: placed(x, found)))


def accepted(span: Column, inn_checked: bool = True, international: bool = False) -> Column:
    """Whether a personal span stands its category's check: cards are cards, INN have check digits unless told otherwise,
    phones have ten digits or a plus (only a plus if ``international``)."""
    value, category = span["value"], span["category"]
    plus = value.startswith("+")
    phone = plus if international else plus | (F.length(F.regexp_replace(value, "[^0-9]", "")) >= 10)
    return F.when(category == "card", card_like(value)).when(category == "inn", inn(value) if inn_checked else F.lit(True)).when(category == "phone", phone).otherwise(True)


def personal_spans(c: Column, extra: dict[str, str] | None = None, **checks) -> Column:
    """Spans of personal data in ``c``, by category, then start; ``extra`` patterns by name are categories of their own."""
    quick = F.coalesce(c.rlike("[0-9@]"), F.lit(False))
    found = F.concat(*[matches(c, p, k) for k, p in PERSONAL.items()])
    own = F.when(quick, F.filter(found, lambda x: accepted(x, **checks))).otherwise(F.array().cast(_SPANS))
    return F.concat(own, *[matches(c, p, k) for k, p in (extra or {}).items()])


def _without(before: str):
    """A function of a span: the span without what stands before the value."""

    def cut(x: Column) -> Column:
        value = F.regexp_replace(x["value"], before, "")
        return F.struct(x["category"].alias("category"), (x["end"] - F.length(value)).alias("start"), x["end"].alias("end"), value.alias("value"))

    return cut


def secret_spans(c: Column) -> Column:
    """Spans of secrets in ``c``: keys, assigned and bearer values without what stands before them and their quotes,
    addresses with credentials, tokens of known form."""
    parts = []
    for k, p in SECRETS.items():
        found = matches(c, p, k)
        if k in _BEFORE:
            found = F.filter(F.transform(found, _without("^" + _BEFORE[k])), lambda x: x["end"] > x["start"])
        parts.append(found)
    quick = F.coalesce(c.rlike(r"[:=]|-----BEGIN|(?i:bearer)|eyJ|sk-|gh[pours]_|github_pat_|A[KS]IA|xox|AIza"), F.lit(False))
    return F.when(quick, F.concat(*parts)).otherwise(F.array().cast(_SPANS))


def all_spans(c: Column, **checks) -> Column:
    """Personal and secret spans by start, then end, then category."""
    order = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["category"].alias("category"), x["value"].alias("value"))
    return F.array_sort(F.transform(F.concat(personal_spans(c, **checks), secret_spans(c)), order))


def class_rank(spans: Column) -> Column:
    """0 to 3: the highest class that any span raises a text to."""
    ranks = F.create_map(*[F.lit(x) for pair in RANK.items() for x in pair])
    return F.aggregate(spans, F.lit(0), lambda a, x: F.greatest(a, F.coalesce(F.try_element_at(ranks, x["category"]), F.lit(2))))


def field_category(name: Column) -> Column:
    """The category that a field's name tells, null if none."""
    low = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for category, parts in _HOLDS:
        out = out.when(reduce(lambda a, b: a | b, [low.contains(p) for p in parts]) | low.isin(*_IS.get(category, ())), category)
    for category, names in _IS.items():
        if category not in dict(_HOLDS):
            out = out.when(low.isin(*names), category)
    return out


def merged_spans(spans: Column) -> Column:
    """Sorted spans, those that overlap as one with the category of the first; spans that only touch stay apart."""
    kind = "array<struct<start:int,end:int,category:string>>"

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        own = F.struct(x["start"].alias("start"), x["end"].alias("end"), x["category"].alias("category"))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["category"].alias("category"))
        return F.when(F.coalesce(x["start"] < last["end"], F.lit(False)), F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), joined)).otherwise(F.array_append(acc, own))

    return F.aggregate(spans, F.array().cast(kind), step)


def _token(text: Column, span: Column, salt: str) -> Column:
    value = text.substr(span["start"] + 1, span["end"] - span["start"])
    return F.concat(F.lit("["), span["category"], F.lit(":"), F.substring(F.sha2(F.concat(F.lit(salt), value), 256), 1, 16), F.lit("]"))


def redacted(c: Column, salt: str = "", spans: Column | None = None) -> Column:
    """The text with each merged span replaced by a token of its category and a salted hash, equal values by equal tokens."""

    def done(text, merged):
        def step(acc, x):
            between = text.substr(acc["at"] + 1, x["start"] - acc["at"])
            return F.struct(x["end"].alias("at"), F.concat(acc["text"], between, _token(text, x, salt)).alias("text"))

        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
        whole = F.aggregate(merged, start, step, lambda acc: F.concat(acc["text"], text.substr(acc["at"] + 1, F.length(text))))
        return F.when(F.size(merged) == 0, text).otherwise(whole)

    return once(F.struct(c.alias("text"), merged_spans(all_spans(c) if spans is None else spans).alias("merged")), lambda x: done(x["text"], x["merged"]))


def placeholders(df: DataFrame, key: str, text: str, salt: str = "", spans: Column | None = None) -> DataFrame:
    """key, token, value of every masked span: what a restricted table keeps, so that masked texts can be restored."""
    spans = df.select(key, F.col(text).alias("t"), F.explode(merged_spans(all_spans(F.col(text)) if spans is None else spans)).alias("s"))
    return spans.select(key, _token(F.col("t"), F.col("s"), salt).alias("token"), F.col("t").substr(F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value")).distinct()


def restored(masked: DataFrame, kept: DataFrame, key: str, text: str) -> DataFrame:
    """Masked rows with the values that ``kept`` has for their tokens; a token that is not there stays."""
    pairs = kept.groupBy(key).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("token", "value")))).alias("_map"))
    found, between = F.regexp_extract_all(F.col(text), F.lit(r"\[[a-z_]+:[0-9a-f]{16}\]"), F.lit(0)), F.split(F.col(text), r"\[[a-z_]+:[0-9a-f]{16}\]", -1)
    back = F.zip_with(between, F.transform(found, lambda x: F.coalesce(F.try_element_at("_map", x), x)), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    out = masked.join(pairs, key, "left")
    return out.withColumn(text, F.array_join(back, "")).drop("_map")


_SPAN = T.ArrayType(T.StructType([T.StructField("code", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_COMPILED = {k: re.compile(p, re.S) for k, p in SIGNALS.items()}


@F.pandas_udf(_SPAN)
def signal_spans(texts: pd.Series) -> pd.Series:
    """Spans of the phrases in the text as it is, however its letters are styled, spaced or parted by what has no width: phrases
    are sought in the folded text and their places carried back. A null text has none."""
    out = []
    for text in texts:
        spans = []
        if text:
            low, begins, ends = folding.folded(text)
            for code, pattern in _COMPILED.items():
                spans += [{"code": code, "start": int(begins[m.start()]), "end": int(ends[m.end() - 1])} for m in pattern.finditer(low)]
        out.append(spans)
    return pd.Series(out)


def signals(spans: Column) -> Column:
    """Codes of the phrases that :func:`signal_spans` found, each once."""
    return F.array_distinct(F.transform(spans, lambda x: x["code"]))


def severity(codes: Column) -> Column:
    """The highest level of any code, as its name."""
    ranks = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    level = F.aggregate(codes, F.lit(0), lambda a, x: F.greatest(a, F.element_at(ranks, x)))
    return F.element_at(F.array(*map(F.lit, LEVELS)), level + 1)


def action(level: Column) -> Column:
    """What is to be done about a level: high and critical are never only observed."""
    return F.when(level.isin("high", "critical"), "block").when(level.isin("low", "medium"), "observe").otherwise("pass")
