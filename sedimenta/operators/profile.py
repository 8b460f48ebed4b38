"""Column profiles: counts, kinds, lengths, extrema, distinct values, samples, co-occurrence.

Everything but distinct counts is one pass whose partial aggregates are a few numbers for each field and task.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.functions import recognise as R
from sedimenta.functions.text import field_category

SKETCH_SIZE = 1024
CATEGORICAL_ROWS, CATEGORICAL_VALUES = 20, 20
#: Short values of a field that a task remembers to have hashed.
SEEN_VALUES = 1 << 16


def kind_of(data_type: T.DataType) -> str:
    """The tag of a native type: integer, number, decimal, boolean, date, datetime, bytes or string."""
    kinds = (
        ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "integer"),
        ((T.FloatType, T.DoubleType), "number"),
        (T.DecimalType, "decimal"),
        (T.BooleanType, "boolean"),
        (T.DateType, "date"),
        ((T.TimestampType, T.TimestampNTZType), "datetime"),
        (T.BinaryType, "bytes"),
    )
    return next((k for t, k in kinds if isinstance(data_type, t)), "string")


def ratio(n: Column, d: Column) -> Column:
    """n / d to 6 places, half to even; null where d is 0."""
    return F.when(d != 0, F.bround(n.cast("decimal(28,10)") / d.cast("decimal(10,0)"), 6)).cast("decimal(18,6)")


def unpivoted(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, kind, value (canonical text) of the named columns; a null value stays a row."""
    kinds = {f: kind_of(df.schema[f].dataType) for f in fields}
    text = {f: F.col(f).cast("string") for f in fields}
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(kinds[f]).alias("kind"), text[f].alias("value")) for f in fields])
    return df.select(F.inline(entries))


def profile_fields(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One row for each field: kind, entity_count, non_null_count, null_count, null_ratio, string lengths, extrema.

    The aggregates of all fields are taken side by side in one pass without unpivoting; only the one row of results is
    turned into rows. Extrema of numbers compare as numbers, of strings by code point.
    """
    fields = fields or df.columns
    out, aggregates = [], [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(fields):
        kind, c = kind_of(df.schema[f].dataType), F.col(f)
        length = F.length(c) if kind == "string" else F.lit(None).cast("int")
        aggregates += [
            F.count(c).alias(f"count{i}"), F.min(c).cast("string").alias(f"min{i}"), F.max(c).cast("string").alias(f"max{i}"),
            F.min(length).alias(f"shortest{i}"), F.max(length).alias(f"longest{i}"), F.sum(length).alias(f"letters{i}"),
        ]
        out.append(
            F.struct(
                F.lit(f).alias("field"), F.lit(kind).alias("kind"), F.col("n").alias("entity_count"), F.col(f"count{i}").alias("non_null_count"),
                (F.col("n") - F.col(f"count{i}")).alias("null_count"), ratio(F.col("n") - F.col(f"count{i}"), F.col("n")).alias("null_ratio"),
                F.col(f"min{i}").alias("min_value"), F.col(f"max{i}").alias("max_value"), F.col(f"shortest{i}").cast("long").alias("min_length"),
                F.col(f"longest{i}").cast("long").alias("max_length"), F.col(f"letters{i}").cast("long").alias("total_length"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*out)))


def distinct_exact(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, non_null_count, distinct_count, categorical: values are counted once by a two-level aggregate."""
    by_value = unpivoted(df, fields).where("value is not null").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    out = by_value.groupBy("field").agg(F.sum("n").alias("non_null_count"), F.count(F.lit(1)).alias("distinct_count"))
    n, d = F.col("non_null_count"), F.col("distinct_count")
    return out.withColumn("categorical", (n >= CATEGORICAL_ROWS) & (d <= CATEGORICAL_VALUES) & (d * 5 <= n))


def distinct_sketch(df: DataFrame, fields: list[str], k: int = SKETCH_SIZE) -> DataFrame:
    """field, kept, kth_hash, more, estimate: distinct values from the k smallest of 128-bit hashes.

    Up to k distinct values the count is exact and ``more`` 0; beyond, the estimate is (k - 1) (2**128 + 1) / (kth + 1)
    rounded half up, k + 1 at least and never over the number of values. One pass over the columns side by side: a task
    hashes each batch's distinct values and holds the k + 1 smallest hashes of each field, which is all that is shuffled.
    """
    kinds = [kind_of(df.schema[f].dataType) for f in fields]

    def sketch(batches):
        import pyarrow as pa

        best, counts = [np.empty(0, "S16") for _ in fields], [0] * len(fields)
        seen: list[set[str]] = [set() for _ in fields]  # values hashed lately
        for batch in batches:
            for i, kind in enumerate(kinds):
                values = batch.column(i).drop_null()
                counts[i] += len(values)
                said = f"{kind}:".encode()
                fresh = [v for v in values.unique().to_pylist() if v not in seen[i]]
                if len(seen[i]) > SEEN_VALUES:
                    seen[i].clear()
                seen[i].update(v for v in fresh if len(v) <= 64)
                found = np.array([hashlib.sha256(said + v.encode("utf-8", "surrogatepass")).digest()[:16] for v in fresh], "S16")
                if len(best[i]) > k:
                    found = found[found < best[i][-1]]
                best[i] = np.unique(np.concatenate((best[i], found)))[: k + 1]
        rows = [(f, n, [h.ljust(16, b"\0").hex() for h in b.tolist()]) for f, n, b in zip(fields, counts, best, strict=True) if n]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.string()))], names=["field", "n", "hashes"])

    parts = df.select(*[F.col(f).cast("string").alias(f"v{i}") for i, f in enumerate(fields)]).mapInArrow(sketch, "field string, n long, hashes array<string>")
    # a task's number of values goes with its first hash
    hashes = parts.select("field", "n", F.posexplode("hashes").alias("at", "hash")).groupBy("field", "hash").agg(F.sum(F.when(F.col("at") == 0, F.col("n"))).alias("n"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy("hash"))
    ranked = hashes.withColumn("rank", rank)
    first = F.when(F.col("rank") <= k, F.col("hash"))
    found = ranked.groupBy("field").agg(F.sum("n").alias("n"), F.count(first).alias("kept"), F.max(first).alias("kth_hash"), (F.count_if(F.col("rank") > k) > 0).cast("int").alias("more"))

    @F.pandas_udf("long")
    def estimated(kept: pd.Series, kth: pd.Series, more: pd.Series) -> pd.Series:
        return pd.Series([max(k + 1, (2 * (k - 1) * (2**128 + 1) + int(h, 16) + 1) // (2 * (int(h, 16) + 1))) if m else n for n, h, m in zip(kept, kth, more, strict=True)])

    return found.select("field", "kept", "kth_hash", "more", F.least("n", estimated("kept", "kth_hash", "more")).alias("estimate"))


def bottom_k_sample(df: DataFrame, key: str, fields: list[str], seed: str = "0", k: int = 5) -> DataFrame:
    """field, rank, value: a sample of k non-null values of each field by the smallest sha256(seed, field, key)."""
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    rows = df.select(F.col(key).cast("string").alias("key"), F.inline(entries)).where("value is not null")
    priority = F.sha2(F.concat_ws("|", F.lit(seed), "field", "key"), 256)
    rank = F.row_number().over(Window.partitionBy("field").orderBy("priority", "key"))
    return rows.withColumn("priority", priority).withColumn("rank", rank).where(F.col("rank") <= k).select("field", "rank", "value")


def cooccurrence(df: DataFrame, fields: list[str]) -> DataFrame:
    """field_a, field_b, both_count: in how many rows both of two fields hold a value; one pass, no self-join."""
    pairs = [(a, b) for i, a in enumerate(sorted(fields)) for b in sorted(fields)[i + 1 :]]
    sums = df.agg(*[F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"n{i}") for i, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(a).alias("field_a"), F.lit(b).alias("field_b"), F.col(f"n{i}").alias("both_count")) for i, (a, b) in enumerate(pairs)]
    return sums.select(F.inline(F.array(*rows)))


# ---- the whole profile of a table in one grouped pass

# Words in a field's name by which numbers are money, and names that tell an identity.
MONEY_WORDS = ("amount", "price", "cost", "сумм", "цен", "стоим")
IDENTITY_NAMES, IDENTITY_ENDS = ("id", "uuid", "guid", "inn", "инн", "email", "code", "код"), ("_id", "_code")
LEAST_VALUES = 20


def profile_table(df: DataFrame, fields: list[str] | None = None, locale: str | None = None, k: int = SKETCH_SIZE, present: dict[str, Column] | None = None) -> DataFrame:
    """One row for each field: counts (entities, present, missing, explicit nulls, null, non-null, skipped), ratio, kinds,
    lengths with their mean, extrema of values and of what texts parse to, counts of patterns, votes, reasons and
    categories, the resolved kind, distinct values and an identity hint.

    ``present``: for a field that a record may lack, whether it has it; a cell that is lacked is missing, one that is
    there and null is an explicit null. All of it but distinct values comes from one pass with partial aggregates of a
    fixed number a field; texts too long to scan are counted as skipped. An empty table has no counts but zeros.
    """
    fields = fields or df.columns
    entries = []
    for f in fields:
        kind, c = kind_of(df.schema[f].dataType), F.col(f)
        there = (present or {}).get(f, F.lit(True))
        number = c.cast("decimal(38,10)") if kind in ("integer", "decimal") else F.lit(None).cast("decimal(38,10)")
        entries.append(F.struct(F.lit(f).alias("field"), F.lit(kind).alias("kind"), F.coalesce(there, F.lit(False)).alias("there"), F.when(there, c).cast("string").alias("value"), number.alias("number")))
    rows = df.select(F.inline(F.array(*entries)))
    text = F.col("kind") == "string"
    too_long = F.coalesce(text & R.skipped(F.col("value")), F.lit(False))
    money = reduce(lambda a, b: a | b, [F.lower("field").contains(w) for w in MONEY_WORDS])
    rows = rows.withColumn("skipped", too_long).withColumn("s", R.scan(F.when(text & ~too_long, F.col("value")), locale, money))
    length = F.when(text, F.length("value"))
    n = lambda flag: F.count_if(F.coalesce(flag, F.lit(False)))
    scanned = text & F.col("value").isNotNull() & ~F.col("skipped")
    plain = scanned & ~reduce(lambda a, b: a | b, [F.col(f"s.kinds.{x}") for x in R.KINDS])
    aggregates = [
        F.count(F.lit(1)).alias("entity_count"), n(F.col("there")).alias("present_count"), F.count("value").alias("non_null_count"), n(F.col("skipped")).alias("skipped_count"),
        F.min(length).alias("min_length"), F.max(length).alias("max_length"), F.sum(length).alias("total_length"),
        F.min(F.coalesce("number", F.when(scanned, F.col("s.number")))).alias("min_number"), F.max(F.coalesce("number", F.when(scanned, F.col("s.number")))).alias("max_number"),
        F.min("s.day").alias("min_day"), F.max("s.day").alias("max_day"), F.min("s.moment").alias("min_moment"), F.max("s.moment").alias("max_moment"),
        F.min(F.when(text, F.col("value"))).alias("min_text"), F.max(F.when(text, F.col("value"))).alias("max_text"), n(plain).alias("k_string"),
    ]
    for part, of in (("patterns", R.PATTERNS), ("kinds", R.KINDS), ("reasons", R.REASONS), ("categories", R.CATEGORIES)):
        aggregates += [n(F.col(f"s.{part}.{x}") & scanned).alias(f"{part[0]}_{x}") for x in of]
    out = rows.groupBy("field", "kind").agg(*aggregates)
    counted = lambda p, of: F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(x).alias("key"), F.col(f"{p}_{x}").alias("value")) for x in of]), lambda x: x["value"] > 0))
    votes = F.when(F.col("kind") == "string", counted("k", (*R.KINDS, "string"))).otherwise(F.when(F.col("non_null_count") > 0, F.create_map("kind", "non_null_count")).otherwise(F.create_map().cast("map<string,bigint>")))
    out = out.withColumn("votes", votes)
    hint = F.col("kind").isin("integer", "decimal") & reduce(lambda a, b: a | b, [F.lower("field").contains(w) for w in MONEY_WORDS])
    out = out.withColumn("votes", F.when(hint & (F.col("non_null_count") > 0), F.create_map(F.lit("money"), "non_null_count")).otherwise(F.col("votes")))
    out = out.select(
        "field", "kind", "entity_count", "present_count", (F.col("entity_count") - F.col("present_count")).alias("missing_count"), (F.col("present_count") - F.col("non_null_count")).alias("explicit_null_count"),
        (F.col("entity_count") - F.col("non_null_count")).alias("null_count"), "non_null_count", ratio(F.col("entity_count") - F.col("non_null_count"), F.col("entity_count")).alias("null_ratio"), "skipped_count",
        F.col("min_length").cast("long").alias("min_length"), F.col("max_length").cast("long").alias("max_length"), ratio(F.col("total_length"), F.when(F.col("kind") == "string", F.col("non_null_count"))).alias("mean_length"),
        "min_number", "max_number", "min_day", "max_day", "min_moment", "max_moment", "min_text", "max_text", "votes",
        counted("p", R.PATTERNS).alias("patterns"), counted("r", R.REASONS).alias("reasons"), counted("c", R.CATEGORIES).alias("categories"),
    )
    distinct = distinct_sketch(df, fields, k).select("field", F.col("estimate").alias("distinct_count"), (F.col("more") == 0).alias("exact"))
    out = out.join(distinct, "field", "left").withColumns({"distinct_count": F.coalesce("distinct_count", F.lit(0)), "exact": F.coalesce("exact", F.lit(True))})
    return with_identity(with_inference(out))


def with_inference(profile: DataFrame) -> DataFrame:
    """``inferred`` and ``status`` of a profile's fields by their votes: resolved with 95 % of the values and a lead of 10 %,
    for texts also with LEAST_VALUES of them; ambiguous with a reason against it; insufficient without values."""
    order = F.array_sort(F.map_entries("votes"), lambda a, b: F.when(a["value"] != b["value"], (b["value"] - a["value"]).cast("int")).when(a["key"] < b["key"], -1).otherwise(1))
    best, second = F.try_element_at(order, F.lit(1)), F.coalesce(F.try_element_at(order, F.lit(2))["value"], F.lit(0))
    n, blocked = F.col("non_null_count"), F.size("reasons") > 0
    enough = (best["value"] * 100 >= n * 95) & ((best["value"] - second) * 10 >= n)
    few = (F.col("kind") == "string") & (best["key"] != "string") & (n < LEAST_VALUES)
    status = F.when(n == 0, "insufficient").when(blocked, "ambiguous").when((F.col("skipped_count") > 0) | best.isNull(), "insufficient").when(~enough, "ambiguous").when(few, "insufficient").otherwise("resolved")
    return profile.withColumns({"inferred": best["key"], "status": status})


def with_identity(profile: DataFrame) -> DataFrame:
    """``identity`` (natural_key, code or identifier) and ``strength`` of fields whose name, patterns or whole numbers hint
    at one: candidate, possible_identifier, insufficient_evidence or none; null where nothing hints."""
    low, n = F.lower("field"), F.col("non_null_count")
    named = low.isin(*IDENTITY_NAMES) | reduce(lambda a, b: a | b, [low.endswith(e) for e in IDENTITY_ENDS])
    has = lambda p: F.coalesce(F.try_element_at("patterns", F.lit(p)), F.lit(0)) > 0
    telling = has("email") | has("uuid") | has("russian_inn_10") | has("russian_inn_12")
    hinted = named | telling | (F.col("kind") == "integer")
    kind = F.when(telling & ~has("uuid"), "natural_key").when(low.contains("code") | (low == "код"), "code").otherwise("identifier")
    whole = F.col("null_count") == 0
    unique = F.col("exact") & (F.col("distinct_count") == n)
    strength = (
        F.when(n < LEAST_VALUES, "insufficient_evidence")
        .when(whole & unique & (named | telling) & (F.col("status") == "resolved") & (F.size("reasons") == 0), "candidate")
        .when(whole & (F.col("distinct_count") * 100 >= n * 95), "possible_identifier")
        .otherwise("none")
    )
    return profile.withColumns({"identity": F.when(hinted, kind), "strength": F.when(hinted, strength)})


def classified(profile: DataFrame) -> DataFrame:
    """field, categories, class and state of a profile's fields: what values and names give away, and how restricted that
    makes them."""
    by_name = field_category(F.col("field"))
    low = F.lower("field")
    holds = lambda *words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    told = F.array_compact(F.array(F.when(holds("password", "secret", "api_key", "token", "пароль"), "credential"), F.when(holds("full_name", "first_name", "last_name", "фио", "фамил", "имя"), "person_name"), F.when(holds("address", "адрес"), "address"), F.when(by_name.isin("email", "phone"), by_name)))
    all_of = F.array_sort(F.array_distinct(F.concat(F.map_keys("categories"), told)))
    level = F.when(F.array_contains(all_of, "credential"), "RESTRICTED").when(F.size(all_of) > 0, "CONFIDENTIAL").otherwise("INTERNAL")
    complete = (F.col("skipped_count") == 0) & (F.col("non_null_count") > 0)
    return profile.select("field", all_of.alias("categories"), level.alias("class"), F.when(F.size(all_of) > 0, "detected").when(complete, "not_detected").otherwise("unknown").alias("state"))
