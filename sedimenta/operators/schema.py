"""Declared checks compiled to one pass: business rules with their operands checked first, a subset of JSON Schema over JSON
text, target checks, admission of tables and columns, and patterns that are safe to run."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.operators import rules


@dataclass(frozen=True)
class Rule:
    """A rule over the rows of a table: op and fields, with ``value`` as the right side where there is no second field."""

    name: str
    op: str
    fields: tuple[str, ...]
    value: object = None
    nulls: str = "reject"


_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)


def _family(kind: T.DataType) -> str:
    return "number" if isinstance(kind, _NUMBERS) else "float" if isinstance(kind, (T.FloatType, T.DoubleType)) else kind.typeName()


def operand_issue(schema: T.StructType, rule: Rule) -> str | None:
    """Why a rule cannot be run over a table: a field that is not there, or kinds that do not compare."""
    known = {f.name: f.dataType for f in schema}
    if any(f not in known for f in rule.fields):
        return "RULE_FIELD_UNKNOWN"
    families = [_family(known[f]) for f in rule.fields]
    if rule.op in ("gt", "gte", "lt", "lte") and families[0] in ("string", "boolean"):
        return "RULE_TYPE_MISMATCH"
    if rule.op.startswith("date_") and families[0] not in ("date", "timestamp", "timestamp_ntz"):
        return "RULE_TYPE_MISMATCH"
    if rule.op in rules._COMPARE and len(families) == 2 and families[0] != families[1]:
        return "RULE_TYPE_MISMATCH"
    return None


def rule_checks(df: DataFrame, declared: list[Rule]) -> tuple[list[Column], list[tuple[str, str]]]:
    """struct(rule, outcome, code) for each rule that can be run over ``df``, and name and code of those that cannot."""
    checks, unfit = [], []
    for r in declared:
        issue = operand_issue(df.schema, r)
        if issue:
            unfit.append((r.name, issue))
            continue
        c = [F.col(f) for f in r.fields]
        if r.op in rules._COMPARE:
            check = rules.compare(r.op, c[0], c[1] if len(c) > 1 else F.lit(r.value), r.nulls)
        elif r.op == "required_if":
            check = rules.required_if(c[0] == F.lit(r.value), c[1])
        else:
            check = {"mutually_exclusive": rules.mutually_exclusive, "at_least_one": rules.at_least_one}[r.op](*c)
        checks.append(F.struct(F.lit(r.name).alias("rule"), check["outcome"].alias("outcome"), check["code"].alias("code")))
    return checks, unfit


def rule_issues(df: DataFrame, key: str, declared: list[Rule]) -> DataFrame:
    """row_key, rule, outcome, code of every row that does not pass a rule; a rule that cannot be run is one row without a
    key. All rules are checked in one pass, and all findings are given."""
    checks, unfit = rule_checks(df, declared)
    empty = df.sparkSession.createDataFrame([(None, n, "indeterminate", c) for n, c in unfit], "row_key string, rule string, outcome string, code string")
    if not checks:
        return empty
    found = F.filter(F.array(*checks), lambda x: x["code"].isNotNull())
    return df.select(F.col(key).cast("string").alias("row_key"), F.inline(found)).union(empty)


# ---- JSON Schema


def safe_pattern(pattern: str, most: int = 256) -> bool:
    """Whether a pattern is of a closed, bounded subset: no groups that repeat without bound, no look-around, no references."""
    import re

    if len(pattern) > most or re.search(r"\(\?[^:]|\\[1-9]|\\[bBAZzGkK]", pattern):
        return False
    if re.search(r"\)(?:[*+]|\{\d+,\})", pattern) or len(re.findall(r"(?<!\\)[*+]|\{\d+,\}", pattern)) > 1:
        return False
    try:
        return re.compile(pattern).match("") is None or pattern.startswith("^")
    except re.error:
        return False


#: Characters that mark a number while its text is parsed as a JSON string, with the escapes that write them.
_MARKS = {chr(i): rf"\u000{i}" for i in range(1, 5)}
_BEGIN, _END = chr(5), chr(6)
_STRING_OR_NUMBER = r'(?s)("(?:[^"\\]|\\.)*+")|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?)'
#: Bits of a power of ten.
_POWERS = 62


# A value is taken apart in steps. A step gives columns (or, for the items of an array, fields) made from those of the step
# before, which ``g`` reads by name, so that nothing is computed twice.


def _bound(v: Column, mark: Column) -> dict[str, Column]:
    """What keywords ask of a value: its text, fields and items."""
    return {"text": F.try_variant_get(v, "$", "string"), "fields": F.try_variant_get(v, "$", "map<string,variant>"), "items": F.try_variant_get(v, "$", "array<variant>"), "v": v, "mark": mark}


def _kind(g) -> dict[str, Column]:
    plain = F.when(F.is_variant_null(g("v")), "null").when(g("text").startswith(g("mark")), "number").when(F.schema_of_variant(g("v")) == "BOOLEAN", "boolean").otherwise("string")
    return {"kind": F.when(g("v").isNull(), None).when(g("fields").isNotNull(), "object").when(g("items").isNotNull(), "array").otherwise(plain)}


def _number_parts(g) -> dict[str, Column]:
    """A number's digits with their point, and its exponent."""
    return {"parts": F.when(g("kind") == "number", F.split(F.lower(F.ltrim(F.substring(g("text"), 2, 1 << 30), F.lit("-"))), "e"))}


def _number_digits(g) -> dict[str, Column]:
    exponent = F.get(g("parts"), F.lit(1))
    power = F.when(F.size(g("parts")) == 1, F.lit(0).cast("long")).when(F.length(exponent) <= 19, exponent.try_cast("long"))
    return {"point": F.instr(g("parts")[0], "."), "all": F.replace(g("parts")[0], F.lit("."), F.lit("")), "power": power}


def _number_places(g) -> dict[str, Column]:
    before = F.when(g("point") > 0, g("point") - 1).otherwise(F.length(g("all")))
    return {"left": F.ltrim(g("all"), F.lit("0")), "begins": before - F.length(g("all")) + g("power")}


def _numbered(g) -> dict[str, Column]:
    """sign, place and digits: digits without zeros at either end, which begin at that power of ten; zero has no digits. All
    null if the exponent has over 18 digits."""
    there = (g("kind") == "number") & g("power").isNotNull()
    sign = F.when(g("left") == "", 0).when(F.substring(g("text"), 2, 1) == "-", -1).otherwise(1)
    return {"sign": F.when(there, sign), "place": F.when(there, g("begins") + F.length(g("left"))), "digits": F.when(there, F.rtrim(g("left"), F.lit("0")))}


def _told(g) -> dict[str, Column]:
    """Whole numbers are integers, however written."""
    whole = (g("sign") == 0) | (g("place") >= F.length(g("digits")))
    return {"kind": F.when((g("kind") == "number") & whole, "integer").otherwise(g("kind"))}


_STEPS = (_number_parts, _number_digits, _number_places, _numbered, _told)


def _steps(schema: dict) -> tuple:
    """The steps that a schema needs: none of the number's where no keyword asks for it."""
    types = [schema["type"]] if isinstance(schema.get("type"), str) else schema.get("type", ())
    values = [schema["const"]] if "const" in schema else schema.get("enum", ())
    bounds = schema.keys() & {"minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"}
    asked = bounds or {"integer", "number"} & set(types) or any(isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) for v in values)
    return (_kind, *(_STEPS if asked else ()))


def _exact(value) -> tuple[int, int, str]:
    """The same of a number in a schema."""
    number = Decimal(str(value))
    if not number.is_finite():
        raise ValueError(f"no JSON number: {value}")
    sign, digits, exponent = number.as_tuple()
    text = "".join(map(str, digits)).lstrip("0")
    return (0, 0, "") if not text else (-1 if sign else 1, len(text) + exponent, text.rstrip("0"))


def compare_exact(g, value) -> Column:
    """-1, 0 or 1: how a number compares with one of a schema, whatever their lengths."""
    sign, place, digits = _exact(value)
    size = F.when(g("place") != place, F.signum(g("place") - place)).when(g("digits") < digits, -1).when(g("digits") > digits, 1).otherwise(0)
    return F.when(g("sign") != sign, F.signum(g("sign") - sign)).when(g("sign") == 0, 0).otherwise(size * sign).cast("int")


def is_multiple(g, value) -> Column:
    """Whether a number is an exact multiple. Of value = d * 10**e and x = c * 10**f, both without zeros at the end: not if f < e,
    for c * 10**f has no more factors of ten; else d divides c * 10**(f - e). Remainders stay below 38 digits."""
    sign, place, digits = _exact(value)
    if sign <= 0 or len(digits) > 18:
        raise ValueError("multipleOf takes a number above 0 of up to 18 digits")
    divisor, least = int(digits), place - len(digits)
    whole = lambda v: F.lit(v).cast("decimal(38,0)")
    rest = lambda v: (v % whole(divisor)).cast("decimal(38,0)")
    chunks = F.regexp_extract_all(g("digits"), F.lit("[0-9]{1,9}"), F.lit(0))
    left = F.aggregate(chunks, whole(0), lambda acc, c: rest(acc * F.rpad(F.lit("1"), F.length(c) + 1, "0").cast("decimal(10,0)") + c.cast("decimal(9,0)")))
    power = g("place") - F.length(g("digits")) - least
    factors = F.array(*[whole(pow(10, 1 << i, divisor)) for i in range(_POWERS)])
    raised = F.aggregate(F.sequence(F.lit(0), F.floor(F.log2(F.greatest(power, F.lit(1)))).cast("int") + 1), left, lambda acc, i: F.when(F.getbit(power, i) == 1, rest(acc * F.get(factors, i))).otherwise(acc))
    return (g("sign") == 0) | ((power >= 0) & (F.when(power == 0, left).otherwise(raised) == 0))


def marked_numbers(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``_m``, a JSON text with every number as a string that begins with a mark, and ``_mark``: the first whose
    escape the text does not hold, null (and so no text) if it holds all. What is no JSON is none afterwards either."""
    free = [(m, escape, ~F.contains(text, F.lit(escape))) for m, escape in _MARKS.items()]
    mark, written = (F.coalesce(*[F.when(is_free, F.lit(x[k])) for *x, is_free in free]) for k in range(2))
    cut = F.replace(F.regexp_replace(text, _STRING_OR_NUMBER, f"$1{_BEGIN}$2{_END}"), F.lit(_BEGIN + _END), F.lit(""))
    rows = rows.withColumns({"_c": F.when(~F.col(text).rlike(rf"[{chr(1)}-{_END}]"), cut), "_mark": mark, "_e": written})
    keyed = F.col("_c").rlike(rf"{_END}[ \t\r\n]*:")  # a number where a name belongs
    quoted = F.replace(F.replace("_c", F.lit(_BEGIN), F.concat(F.lit('"'), "_e")), F.lit(_END), F.lit('"'))
    return rows.withColumn("_m", F.when(~keyed, quoted))


_KNOWN = frozenset(
    "type enum const minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minLength maxLength pattern required properties additionalProperties "
    "minItems maxItems items $defs title description $schema $ref".split()
)


class _Compiler:
    """Checks of a schema: named columns for the values at each path, in steps, each made from those of the step before;
    within the items of an array, where no column can stand, values are bound by a first pass over them."""

    def __init__(self, definitions: dict, mark: Column):
        self.definitions, self.mark = definitions, mark
        self.steps: list[dict[str, Column]] = []
        self.checks: list[Column] = []

    def resolved(self, schema: dict) -> dict:
        while "$ref" in schema:
            name = schema["$ref"]
            if not name.startswith("#/$defs/"):
                raise ValueError(f"only local references: {name}")
            schema = self.definitions[name.removeprefix("#/$defs/")]
        if schema.keys() - _KNOWN:
            raise ValueError(f"keywords that are not supported: {sorted(schema.keys() - _KNOWN)}")
        return schema

    def bind(self, level: int, columns: dict[str, Column]) -> None:
        while len(self.steps) <= level:
            self.steps.append({})
        self.steps[level].update(columns)

    def at(self, schema: dict, value: Column, path: str, name: str, level: int) -> None:
        """Checks of a schema for the value at a path; ``value`` can be read when step ``level`` is made."""
        schema = self.resolved(schema)
        self.bind(level, {f"{name}__v": value})
        g = lambda field: F.col(f"{name}__{field}")
        put = lambda fields: self.bind(level, {f"{name}__{k}": c for k, c in fields.items()})
        level += 1
        put({k: c for k, c in _bound(g("v"), self.mark).items() if k != "v"})
        for step in _steps(schema):
            level += 1
            put(step(g))
        level += 1
        self.checks += self.own(schema, g, path)
        for i, (key, below) in enumerate(schema.get("properties", {}).items()):
            self.at(below, F.try_element_at(g("fields"), F.lit(key)), f"{path}/{key}", f"{name}_{i}", level)
        if "items" in schema:
            self.bind(level, {f"{name}__first": self.of_items(schema["items"], g("items"), f"{path}/*")})
            self.checks.append(g("first"))

    def of_items(self, schema: dict, items: Column, path: str) -> Column:
        """The first check that an item breaks."""
        schema = self.resolved(schema)
        known: list[str] = []

        def struct(fields: dict[str, Column], b: Column | None = None) -> Column:
            kept = [b[k].alias(k) for k in known if k not in fields] if b is not None else []
            known[:] = [k for k in known if k not in fields] + list(fields)
            return F.struct(*kept, *[c.alias(k) for k, c in fields.items()])

        bound = F.transform(items, lambda v: struct(_bound(v, self.mark)))
        for step in _steps(schema):
            bound = F.transform(bound, lambda b: struct(step(lambda k: b[k]), b))  # noqa: B023
        each = F.transform(bound, lambda b: F.try_element_at(F.array_compact(F.array(*self.nested(schema, b, path))), F.lit(1)))
        return F.try_element_at(F.array_compact(each), F.lit(1))

    def nested(self, schema: dict, b: Column, path: str) -> list[Column]:
        out = self.own(schema, lambda k: b[k], path)
        for key, below in schema.get("properties", {}).items():
            out.append(self.of_items(below, F.filter(F.array(F.try_element_at(b["fields"], F.lit(key))), lambda v: v.isNotNull()), f"{path}/{key}"))
        if "items" in schema:
            out.append(self.of_items(schema["items"], b["items"], f"{path}/*"))
        return out or [F.lit(None).cast("struct<path: string, keyword: string>")]

    def own(self, schema: dict, g, path: str) -> list[Column]:
        """struct(path, keyword) or null for every keyword of a schema but those about other values; an absent value, whose
        kind is null, breaks none."""
        out: list[Column] = []
        kind, text, fields, items = g("kind"), g("text"), g("fields"), g("items")
        is_text, is_number, is_object, is_array = kind == "string", kind.isin("integer", "number"), kind == "object", kind == "array"

        def check(keyword: str, broken: Column) -> None:
            out.append(F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(keyword).alias("keyword"))))

        if _told in _steps(schema):
            check("number", is_number & g("sign").isNull())  # an exponent beyond all bounds
        if "type" in schema:
            types = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
            check("type", ~(kind.isin(*types) | ((kind == "integer") & F.lit("number" in types))))
        if "const" in schema or "enum" in schema:
            values = [schema["const"]] if "const" in schema else schema["enum"]
            alike = {type(None): lambda v: kind == "null", str: lambda v: is_text & (text == v), bool: lambda v: (kind == "boolean") & (text == str(v).lower())}
            same = [alike.get(type(v), lambda v: is_number & (compare_exact(g, v) == 0))(v) for v in values]
            check("const" if "const" in schema else "enum", ~reduce(lambda a, c: a | F.coalesce(c, F.lit(False)), same, F.lit(False)) & kind.isNotNull())
        for keyword, broken in (("minimum", lambda v: compare_exact(g, v) < 0), ("maximum", lambda v: compare_exact(g, v) > 0), ("exclusiveMinimum", lambda v: compare_exact(g, v) <= 0), ("exclusiveMaximum", lambda v: compare_exact(g, v) >= 0), ("multipleOf", lambda v: ~is_multiple(g, v))):
            if keyword in schema:
                check(keyword, is_number & broken(schema[keyword]))
        if "minLength" in schema:
            check("minLength", is_text & (F.length(text) < schema["minLength"]))
        if "maxLength" in schema:
            check("maxLength", is_text & (F.length(text) > schema["maxLength"]))
        if "pattern" in schema:
            if not safe_pattern(schema["pattern"]):
                raise ValueError(f"pattern outside the safe subset: {schema['pattern']}")
            check("pattern", is_text & ~text.rlike(schema["pattern"]))
        for name in schema.get("required", ()):
            check(f"required:{name}", is_object & ~F.map_contains_key(fields, name))
        if schema.get("additionalProperties") is False:
            extra = F.array_except(F.map_keys(fields), F.array(*map(F.lit, schema.get("properties", {}))).cast("array<string>"))
            check("additionalProperties", is_object & (F.size(extra) > 0))
        if "minItems" in schema:
            check("minItems", is_array & (F.size(items) < schema["minItems"]))
        if "maxItems" in schema:
            check("maxItems", is_array & (F.size(items) > schema["maxItems"]))
        return out


def json_schema_issues(df: DataFrame, key: str, text: str, schema: dict) -> DataFrame:
    """row_key, path, keyword of every keyword of a schema that a JSON text breaks; of the items of an array, the first that
    breaks it. Text that is no JSON (or repeats a key) breaks ``json``; a null text is not checked.

    The subset: types, enum and const, bounds, exact multipleOf, lengths, safe patterns, required, properties,
    additionalProperties, items and their number, local references. Anything else is refused when compiled. Numbers of any
    length compare exactly, by their digits; one whose exponent has over 18 digits breaks ``number``. A text that writes the escapes of U+0001 to U+0004 all together breaks ``json``.
    """
    rows = df.select(F.col(key).alias("row_key"), F.col(text).alias("_t")).where("_t is not null")
    # a value and then a string that no text can hold: with anything more or less the text is not one value
    rows = marked_numbers(rows, "_t").withColumn("_p", F.try_parse_json(F.concat(F.lit("["), "_m", F.lit(',"'), "_e", F.lit('"]'))))
    rows = rows.withColumn("_a", F.try_variant_get("_p", "$", "array<variant>"))
    whole = (F.size("_a") == 2) & (F.try_variant_get(F.get("_a", F.lit(1)), "$", "string") == F.col("_mark"))
    rows = rows.withColumn("_v", F.when(whole, F.get("_a", F.lit(0))))
    compiler = _Compiler(schema.get("$defs", {}), F.col("_mark"))
    compiler.at(schema, F.col("_v"), "", "_r", 0)
    for step in compiler.steps:
        rows = rows.withColumns(step)
    bad = F.struct(F.lit("").alias("path"), F.lit("json").alias("keyword"))
    found = F.when(F.col("_v").isNull(), F.array(bad)).otherwise(F.array_compact(F.array(*compiler.checks)))
    return rows.select("row_key", F.inline(found))


# ---- targets


def check_issues(df: DataFrame, key: str, bound: dict[str, str | None]) -> DataFrame:
    """row_key, check, code of a target's CHECKs by name: DB_CHECK where its expression is false (unknown passes), and for one
    that is bound to none, DB_CONSTRAINT_UNVERIFIED for every row."""
    found = [F.struct(F.lit(n).alias("check"), (F.when(~F.expr(e), "DB_CHECK") if e else F.lit("DB_CONSTRAINT_UNVERIFIED")).alias("code")) for n, e in sorted(bound.items())]
    return df.select(F.col(key).alias("row_key"), F.inline(F.filter(F.array(*found), lambda x: x["code"].isNotNull())))


def admission_issues(columns: DataFrame, catalog: DataFrame, denied: list[str], allowed: list[str] | None = None) -> DataFrame:
    """table, column, code of the columns that a load names: in no catalog, in a table that is not writable, or not allowed
    ("table.column" or "table.*"; what is denied wins)."""
    there = catalog.select(F.col("table").alias("_t"), F.col("column").alias("_c"), "writable")
    met = columns.join(there, (F.col("table") == F.col("_t")) & (F.col("column") == F.col("_c")), "left")
    full, whole = F.concat("table", F.lit("."), "column"), F.concat("table", F.lit(".*"))
    of = lambda names: full.isin(*names) | whole.isin(*names) if names else F.lit(False)
    code = F.when(of(denied), "DB_COLUMN_DENIED").when(F.col("_t").isNull(), "DB_COLUMN_UNKNOWN").when(~F.col("writable"), "DB_TABLE_NOT_WRITABLE")
    if allowed is not None:
        code = code.when(~of(allowed), "DB_COLUMN_DENIED")
    return met.select("table", "column", code.alias("code")).where("code is not null")


def typed_copies(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """``df`` with fields copied under their kinds: nothing is converted, bytes are refused, and money comes of decimals only."""
    for name, kind in fields.items():
        own = df.schema[name].dataType
        if isinstance(own, T.BinaryType) or (kind == "money" and not isinstance(own, T.DecimalType)):
            raise ValueError(f"{name} cannot be copied as {kind}")
    return df.select(*fields)
