"""How fields and tables relate: pairs of fields across parents and children, values that columns share, foreign keys found in
values, and what these say of candidates for a mapping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields of one word of a bit set.
WORD = 62


def presence(fields: list[str]) -> Column:
    """Which fields hold a value, as words of a bit set."""
    bit = lambda i, f: F.when(F.col(f).isNotNull(), F.lit(1 << (i % WORD)).cast("long")).otherwise(F.lit(0).cast("long"))
    words = [fields[a : a + WORD] for a in range(0, len(fields), WORD)]
    return F.array(*[reduce(lambda x, y: x + y, [bit(i, f) for i, f in enumerate(w)]) for w in words])


def parent_child_pairs(parents: DataFrame, key: list[str], parent_fields: list[str], children: DataFrame, parent_key: list[str], child_fields: list[str]) -> DataFrame:
    """left, right, pairs: over all children that have a parent, how often a field of the parent and one of the child both
    hold a value; pairs that never do are left out.

    A row is a bit set. Children are counted by key and bit set before they are shuffled, meet their parents once, and
    what is left are the few patterns that occur, over which all pairs of fields are summed in one pass. A null key has
    no parent; a parent's key is taken to be unique (repeated parents count each).
    """
    p = parents.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], presence(parent_fields).alias("_p"))
    c = children.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(parent_key)], presence(child_fields).alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    patterns = c.join(p, [f"_k{i}" for i in range(len(key))]).groupBy("_p", "_c").agg(F.sum("_n").alias("_n"))
    has = lambda words, i: F.getbit(F.col(words)[i // WORD], F.lit(i % WORD)) == 1
    there = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), (has("_p", i) & has("_c", j)).alias("both")) for i, a in enumerate(parent_fields) for j, b in enumerate(child_fields)]
    return patterns.select("_n", F.inline(F.array(*there))).where("both").groupBy("left", "right").agg(F.sum("_n").alias("pairs"))


def distinct_values(fields: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """field, value: the distinct values of each field as text, nulls aside; combined before they are shuffled."""
    parts = [df.select(F.lit(name).alias("field"), value.cast("string").alias("value")).where("value is not null").distinct() for name, (df, value) in fields.items()]
    return reduce(DataFrame.unionByName, parts)


def value_overlap(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target, shared, values, share: of a source field's distinct values those that a target field has too.

    Both sides are field, value, distinct. They meet by value, so a value costs as many rows as it has pairs of fields."""
    met = sources.select(F.col("field").alias("source"), "value").join(targets.select(F.col("field").alias("target"), "value"), "value")
    sizes = sources.groupBy(F.col("field").alias("source")).agg(F.count(F.lit(1)).alias("values"))
    found = met.groupBy("source", "target").agg(F.count(F.lit(1)).alias("shared")).join(sizes, "source")
    return found.select("source", "target", "shared", "values", F.bround(F.col("shared") / F.col("values"), 6).alias("share"))


def foreign_keys(declared: dict[str, tuple[DataFrame, list[str], DataFrame, list[str]]]) -> DataFrame:
    """fk, rows, missing, repeated, holds: for each possible key (child, its columns, parent, its columns) how many children
    with a whole key have no parent, how many parents share a key, and whether it holds: neither, and some children."""
    out = None
    for name, (child, child_columns, parent, parent_columns) in declared.items():
        names = [f"_k{i}" for i in range(len(child_columns))]
        keys = lambda df, columns, ns=names: df.select(*[F.col(c).alias(n) for c, n in zip(columns, ns, strict=True)]).dropna()
        parents = keys(parent, parent_columns).groupBy(*names).agg(F.count(F.lit(1)).alias("_p"))
        children = keys(child, child_columns).groupBy(*names).agg(F.count(F.lit(1)).alias("_c"))
        sums = children.join(parents, names, "full").agg(
            F.coalesce(F.sum("_c"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("_p").isNull(), F.col("_c"))), F.lit(0)).alias("missing"), F.coalesce(F.sum(F.col("_p") - 1), F.lit(0)).alias("repeated")
        )
        part = sums.select(F.lit(name).alias("fk"), "rows", "missing", "repeated", ((F.col("missing") == 0) & (F.col("repeated") == 0) & (F.col("rows") > 0)).alias("holds"))
        out = part if out is None else out.unionByName(part)
    return out


def key_support(edges: DataFrame, anchors: DataFrame, links: DataFrame) -> DataFrame:
    """fk, parent_entity, child_entity, declared, matched, support: how far foreign keys bear out that an entity's table is the
    parent of another's.

    ``edges``: fk, parent, parent_column, child, child_column, a row for each pair of columns. ``anchors``: entity, table,
    column, the columns that are sure; ``links``: parent_entity, child_entity. A key supports a pair whole (1) only if all its
    pairs of columns are anchored on both sides, which counting matched against declared pairs tells; if the tables are
    anchored but some column is not, 0.5. A column that is anchored more than once counts once.
    """
    declared = edges.groupBy("fk").agg(F.count_distinct("parent_column", "child_column").alias("declared"))
    tables = anchors.select("entity", "table").distinct()
    of = lambda side: [F.col("entity").alias(f"{side}_entity"), F.col("table").alias(side)]
    near = edges.select("fk", "parent", "child").distinct().join(tables.select(*of("parent")), "parent").join(tables.select(*of("child")), "child").join(links, ["parent_entity", "child_entity"], "left_semi")
    sure = anchors.select("entity", "table", "column").distinct()
    both = edges.distinct().join(sure.select(*of("parent"), F.col("column").alias("parent_column")), ["parent", "parent_column"]).join(sure.select(*of("child"), F.col("column").alias("child_column")), ["child", "child_column"])
    matched = both.groupBy("fk", "parent_entity", "child_entity").agg(F.count(F.lit(1)).alias("matched"))
    out = near.join(declared, "fk").join(matched, ["fk", "parent_entity", "child_entity"], "left").withColumn("matched", F.coalesce("matched", F.lit(0).cast("long")))
    return out.select("fk", "parent_entity", "child_entity", "declared", "matched", F.when(F.col("matched") == F.col("declared"), 1.0).otherwise(0.5).alias("support"))


def relation_candidates(edges: DataFrame, tables: DataFrame, columns: DataFrame, links: DataFrame, k: int = 3) -> DataFrame:
    """fk, rank, parent_entity, child_entity, score: for each foreign key the k best pairs of entities for its two tables.

    ``edges`` as above; ``tables``: entity, table, score; ``columns``: entity, table, column, score (0 to 1, the best field);
    ``links``: parent_entity, child_entity. A pair of entities counts if they are linked or are one and the same, and if each
    has a field for every column of the key. Its score is half the mean of both table scores and half the mean, over
    pairs of columns, of both column scores. Ties go by the names of the entities.

    Columns are joined only for pairs that can still be among the k: a pair's score is at most that with each entity's best
    column, and at least that with its worst, so a pair whose most is under the k-th greatest least is left out before.
    """
    ends = columns.groupBy("entity", "table").agg(F.max("score").alias("most"), F.min("score").alias("least"), F.count_distinct("column").alias("held"))
    scored = tables.join(ends, ["entity", "table"])
    side = lambda s: scored.select(*[F.col(c).alias(f"{s}_entity" if c == "entity" else s if c == "table" else f"{s}_{c}") for c in scored.columns])
    pairs = edges.select("fk", "parent", "child").distinct().join(side("parent"), "parent").join(side("child"), "child")
    linked = links.select("parent_entity", "child_entity", F.lit(True).alias("_l")).distinct()
    pairs = pairs.join(linked, ["parent_entity", "child_entity"], "left").where(F.col("_l") | (F.col("parent_entity") == F.col("child_entity"))).drop("_l")
    by_table = (F.col("parent_score") + F.col("child_score")) / 4
    pairs = pairs.withColumn("_most", by_table + (F.col("parent_most") + F.col("child_most")) / 4).withColumn("_least", by_table + (F.col("parent_least") + F.col("child_least")) / 4)
    # the least of a pair only counts if the pair has all columns of the key
    declared = edges.select("fk", "parent_column", "child_column", "parent", "child").distinct()
    has = lambda s: columns.select(F.col("entity").alias(f"{s}_entity"), F.col("table").alias(s), F.col("column").alias(f"{s}_column")).distinct()
    sizes = declared.groupBy("fk").agg(F.count(F.lit(1)).alias("_n"))
    whole = lambda s: declared.select("fk", s, f"{s}_column").join(has(s), [s, f"{s}_column"]).groupBy("fk", f"{s}_entity").agg(F.count(F.lit(1)).alias("_h")).join(sizes, "fk").where("_h = _n").select("fk", f"{s}_entity")
    pairs = pairs.join(whole("parent"), ["fk", "parent_entity"], "left_semi").join(whole("child"), ["fk", "child_entity"], "left_semi")
    place = F.row_number().over(Window.partitionBy("fk").orderBy(F.desc("_least")))
    kth = pairs.select("fk", "_least").withColumn("_place", place).where(F.col("_place") <= k).groupBy("fk").agg(F.when(F.count(F.lit(1)) == k, F.min("_least")).alias("_kth"))
    kept = pairs.join(kth, "fk").where(F.col("_kth").isNull() | (F.col("_most") >= F.col("_kth") - 1e-9))
    best = columns.groupBy("entity", "table", "column").agg(F.max("score").alias("score"))
    of = lambda s: best.select(F.col("entity").alias(f"{s}_entity"), F.col("table").alias(s), F.col("column").alias(f"{s}_column"), F.col("score").alias(f"_{s}"))
    met = kept.select("fk", "parent", "child", "parent_entity", "child_entity", "parent_score", "child_score").join(declared, ["fk", "parent", "child"]).join(of("parent"), ["parent_entity", "parent", "parent_column"]).join(of("child"), ["child_entity", "child", "child_column"])
    total = met.groupBy("fk", "parent_entity", "child_entity").agg(F.bround((F.first("parent_score") + F.first("child_score")) / 4 + F.avg((F.col("_parent") + F.col("_child")) / 4), 6).alias("score"))
    order = Window.partitionBy("fk").orderBy(F.desc("score"), "parent_entity", "child_entity")
    return total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("fk", "rank", "parent_entity", "child_entity", "score")
