"""Rows and their origins on the way to a target: projection, dependencies between rows, groups, fingerprints, and writes that
happen once."""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sedimenta.plans.claims import Claim, Folder, LoadBusy, claimed
from sedimenta.plans.load import components
from sedimenta.sources.shared import discarded, shared_dir, tidied

_AND = lambda terms: reduce(lambda a, b: a & b, terms)


def row_uid(*parts: Column) -> Column:
    """A row's own name: a hash over the parts, each with its length, so that no two lists of parts run together."""
    text = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("", *[F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in text]), 256)


def identifier(kind: str, *parts: Column) -> Column:
    """A catalog object's name from its kind and parts."""
    return row_uid(F.lit(kind), *parts)


def projected(values: DataFrame, mapping: dict[tuple[str, str], tuple[str, str]]) -> dict[str, DataFrame]:
    """Of each target table its rows: uid, record_id, entity_id and the mapped columns as text.

    ``values`` (record_id, entity_id, entity_type, field, value) are cells; ``mapping`` takes (entity type, field) to
    (table, column). A table takes one entity type. Cells without a mapping are left out, see :func:`unmapped`.
    """
    tables: dict[str, dict] = {}
    for (entity, field), (table, column) in mapping.items():
        spec = tables.setdefault(table, {"entity": entity, "columns": {}})
        if spec["entity"] != entity:
            raise ValueError(f"table {table} takes one entity type")
        spec["columns"][field] = column
    out = {}
    for table, spec in tables.items():
        rows = values.where((F.col("entity_type") == spec["entity"]) & F.col("field").isin(*spec["columns"]))
        wide = rows.groupBy("record_id", "entity_id").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(c) for f, c in spec["columns"].items()])
        out[table] = wide.select(row_uid(F.col("record_id"), F.col("entity_id"), F.lit(table)).alias("uid"), "*")
    return out


def unmapped(values: DataFrame, mapping: dict[tuple[str, str], tuple[str, str]]) -> DataFrame:
    """record_id of records of which no cell has a mapping."""
    known = reduce(lambda a, b: a | b, [(F.col("entity_type") == e) & (F.col("field") == f) for e, f in mapping], F.lit(False))
    return values.groupBy("record_id").agg(F.bool_or(known).alias("_any")).where("not _any").select("record_id")


def dependency_edges(children: DataFrame, columns: list[str], parents: DataFrame, parent_columns: list[str]) -> DataFrame:
    """a, b: a row's uid and that of the incoming parent row its key names; a key with a null names none."""
    whole = _AND(F.col(c).isNotNull() for c in columns)
    p = parents.select(F.col("uid").alias("b"), *[F.col(c).alias(f"_p{i}") for i, c in enumerate(parent_columns)])
    c = children.where(whole).select(F.col("uid").alias("a"), *[F.col(x).alias(f"_c{i}") for i, x in enumerate(columns)])
    return c.join(p, _AND(F.col(f"_c{i}") == F.col(f"_p{i}") for i in range(len(columns)))).select("a", "b")


def dependency_groups(rows: DataFrame, edges: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """uid, group: rows that load together or not at all. Rows of one source record are one group, so are those of records that
    are ``related`` (record_id, other_id), and rows that depend on each other."""
    rows = tidied(rows.select("uid", "record_id"))
    first = rows.groupBy("record_id").agg(F.min("uid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = tidied((first if related is not None else first.where("_n > 1")).drop("_n"))
    links = rows.join(first, "record_id").select(F.col("uid").alias("a"), F.col("_first").alias("b")).union(edges.select("a", "b"))
    if related is not None:
        other = first.select(F.col("record_id").alias("other_id"), F.col("_first").alias("b"))
        links = links.union(related.join(first.withColumnRenamed("_first", "a"), "record_id").join(other, "other_id").select("a", "b"))
    found = components(links.where("a <> b"))  # a row without links is a group of its own
    out = tidied(rows.select("uid").join(found.select(F.col("node").alias("uid"), "component"), "uid", "left").select("uid", F.coalesce("component", "uid").alias("group")))
    discarded(rows, first, found)
    return out


def parent_faults(children: DataFrame, parents: DataFrame, columns: list[str], parent_columns: list[str]) -> DataFrame:
    """uid, code of rows whose parent is not the one their record names: LOAD_FK_PARENT_UNRESOLVED unless exactly one parent
    row is of the same record and the same or parent entity, or of the parent record; LOAD_FK_PARENT_MISMATCH if its key
    differs. Both sides have record_id and entity_id, children also parent_entity_id and parent_record_id."""
    whole = _AND(F.col(c).isNotNull() for c in columns)
    p = parents.select(F.col("record_id").alias("_r"), F.col("entity_id").alias("_e"), *[F.col(c).alias(f"_p{i}") for i, c in enumerate(parent_columns)])
    c = children.where(whole).select("uid", "record_id", "entity_id", "parent_entity_id", "parent_record_id", *[F.col(x).alias(f"_c{i}") for i, x in enumerate(columns)])
    asked = c.select("*", F.explode(F.array_distinct(F.array_compact(F.array("record_id", "parent_record_id")))).alias("_r"))
    met = asked.join(p, "_r")
    same = F.col("_r") == F.col("record_id")
    linked = met.where(F.coalesce((same & ((F.col("_e") == F.col("entity_id")) | F.col("_e").eqNullSafe(F.col("parent_entity_id")))) | (F.col("_r") == F.col("parent_record_id")), F.lit(False)))
    equal = _AND(F.col(f"_c{i}").eqNullSafe(F.col(f"_p{i}")) for i in range(len(columns)))
    found = linked.groupBy("uid").agg(F.count(F.lit(1)).alias("_n"), F.bool_and(equal).alias("_equal"))
    told = c.select("uid").join(found, "uid", "left")
    code = F.when(F.coalesce("_n", F.lit(0)) != 1, "LOAD_FK_PARENT_UNRESOLVED").when(~F.col("_equal"), "LOAD_FK_PARENT_MISMATCH")
    return told.select("uid", code.alias("code")).where("code is not null")


def origins(findings: DataFrame, rows: DataFrame) -> DataFrame:
    """Findings (uid, code) with the record and entity of the row they are about."""
    return findings.join(rows.select("uid", "record_id", "entity_id"), "uid", "left")


def dataset_fingerprint(values: DataFrame, record: str, order: list[str]) -> DataFrame:
    """One row, fingerprint and records: a hash over records in their order, each a hash over its sorted cells, so that
    neither how rows are dealt nor what records are called matters; records of one place are in the order of their hashes.
    A few hex digits a record meet in one task."""
    cells = values.groupBy(record, *order).agg(F.array_sort(F.collect_list(F.struct("field", "kind", "value"))).alias("c"))
    frame = lambda x: F.concat(F.octet_length(x).cast("string"), F.lit(":"), x)
    cell = lambda x: F.concat(frame(x["field"]), frame(x["kind"]), F.coalesce(frame(x["value"]), F.lit("-")))
    hashed = cells.select(*order, F.sha2(F.array_join(F.transform("c", cell), ";"), 256).alias("h"))
    # blocks of records by place, then the blocks: no task has all records
    from sedimenta.operators.structure import ordinals

    placed = ordinals(hashed, *order, "h")
    block = lambda df, by: df.groupBy(by).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "h"))), lambda x: x["h"]), ""), 256).alias("h"), F.count(F.lit(1)).alias("n"))
    blocks = block(placed, F.floor(F.col("ordinal") / 4096).alias("_block")).select(F.col("_block").alias("ordinal"), "h", "n")
    ends = blocks.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "h"))), lambda x: x["h"]), ""), 256).alias("fingerprint"), F.coalesce(F.sum("n"), F.lit(0)).alias("records"))
    return ends


# ---- writes that happen once


class LoadConflict(ValueError):
    """The same key was used for another load, or a write is not what was planned."""


def binding(parts: dict[str, str]) -> str:
    """What a load is bound to: a hash over its named parts, in the order of names. How it is batched is none of them."""
    import hashlib

    text = "".join(f"{len(k)}:{k}{len(v)}:{v}" for k, v in sorted(parts.items()))
    return hashlib.sha256(text.encode()).hexdigest()


def load_once(spark: SparkSession, rows: DataFrame, target: str, ledger: str, key: str, bound: str, rejected: DataFrame | None = None, groups: str | None = None, atomic: bool = False, lease: float = 60.0, wait: float = 0.0) -> dict:
    """Append rows to a Parquet table once for each key, and give what was done: key, rows, quarantined, replayed.

    ``rejected`` (uid, code) are rows with findings. Atomic loads are refused if there is any; others put the whole group
    (column ``groups`` of rows, else the row) aside, with codes, in the folder ``target`` + "_quarantine".

    A load claims its key (folder ``ledger`` + "_claims"): of loads of one key at once one writes, the others raise
    ``LoadBusy`` or, given ``wait`` seconds, replay it. A claim that its holder has not renewed for ``lease`` seconds is
    taken over. Rows are written aside and moved to a folder named after the key while the claim still holds, then the
    ledger has its line: readers see a load whole or not at all, and one that died is done anew. A key that is in the ledger
    with the same binding is replayed, with another it is a conflict. The rows stored must be as many as were planned.
    """
    name = binding({"key": key})
    until = time.time() + wait
    while True:
        if done := _done(spark, ledger, key, bound):
            return done
        try:
            with claimed(spark, f"{ledger}_claims", name, lease) as claim:
                return _done(spark, ledger, key, bound) or _load(spark, rows, target, ledger, key, bound, rejected, groups, atomic, claim)
        except LoadBusy:
            if time.time() >= until:
                raise
            time.sleep(0.2)


def _done(spark: SparkSession, ledger: str, key: str, bound: str) -> dict | None:
    if not Folder(spark, ledger).exists():
        return None
    known = spark.read.schema("key string, binding string, rows long, quarantined long").parquet(ledger).where(F.col("key") == key).collect()
    if not known:
        return None
    if known[0]["binding"] != bound:
        raise LoadConflict("the key is that of another load")
    return {"key": key, "rows": known[0]["rows"], "quarantined": known[0]["quarantined"], "replayed": True}


def _load(spark: SparkSession, rows: DataFrame, target: str, ledger: str, key: str, bound: str, rejected: DataFrame | None, groups: str | None, atomic: bool, claim: Claim) -> dict:
    own = f"load={claim.key}"
    aside = None
    if rejected is not None:
        bad = rejected.select("uid", "code").distinct()
        if atomic and not bad.isEmpty():
            raise LoadConflict("an atomic load with rejected rows")
        hit = rows.join(bad, "uid", "left_semi")
        hit = hit.select(groups).distinct() if groups else hit.select("uid")
        on = groups or "uid"
        aside = rows.join(hit, on, "left_semi").join(bad.groupBy("uid").agg(F.array_sort(F.collect_set("code")).alias("codes")), "uid", "left")
        aside = aside.withColumn("codes", F.coalesce("codes", F.array(F.lit("DRY_RUN_DEPENDENCY_QUARANTINED"))))
        rows = rows.join(hit, on, "left_anti")

    def stored(df: DataFrame, place: str) -> int:
        """Write aside, once, counting what is planned on the way; move it in while the claim holds; count what is there."""
        planned, folder, staged = Observation(), Folder(spark, place), f"_staged/{claim.name}"
        df.observe(planned, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{place}/{staged}")
        n, there = planned.get["n"], spark.read.schema(df.schema).parquet(f"{place}/{staged}").count()
        if n != there:
            raise LoadConflict(f"{n} rows planned, {there} written")
        claim.check()
        folder.move(staged, own)
        return n

    n = stored(rows, target)
    put_aside = stored(aside.select(F.sha2(F.col("uid"), 256).alias("unit_hash"), "codes"), f"{target}_quarantine") if aside is not None else 0
    claim.check()
    spark.createDataFrame([(key, bound, n, put_aside)], "key string, binding string, rows long, quarantined long").write.mode("append").parquet(ledger)
    return {"key": key, "rows": n, "quarantined": put_aside, "replayed": False}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/sedimenta/{name}-{uuid.uuid4().hex}"


def needs_value(columns: DataFrame, mapped: list[str]) -> DataFrame:
    """table, column, code of columns that a load leaves out though they are not null and have no default, identity or
    generated value; and of key columns that an update would change. ``columns``: table, column, nullable, has_value, is_key,
    updatable."""
    lacks = columns.where(~F.col("column").isin(*mapped) & ~F.col("nullable") & ~F.col("has_value")).select("table", "column", F.lit("LOAD_DEFAULT_UNAVAILABLE").alias("code"))
    moved = columns.where(F.col("is_key") & F.col("updatable") & F.col("column").isin(*mapped)).select("table", "column", F.lit("LOAD_KEY_UPDATE").alias("code"))
    return lacks.union(moved)


def staging_faults(batches: DataFrame, manifest: DataFrame) -> DataFrame:
    """batch_index, fault of staged batches (batch_index, rows, fingerprint) against the manifest: missing, unexpected, changed."""
    both = batches.alias("a").join(manifest.alias("b"), F.col("a.batch_index") == F.col("b.batch_index"), "full_outer")
    same = F.col("a.rows").eqNullSafe(F.col("b.rows")) & F.col("a.fingerprint").eqNullSafe(F.col("b.fingerprint"))
    fault = F.when(F.col("a.batch_index").isNull(), "missing").when(F.col("b.batch_index").isNull(), "unexpected").when(~same, "changed")
    return both.select(F.coalesce("a.batch_index", "b.batch_index").alias("batch_index"), fault.alias("fault")).where("fault is not null")
