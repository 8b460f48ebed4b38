"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm.common import WORD_PATTERN, written

#: Weights given to the sources in order, again and again; how often a source may be repeated at most.
WEIGHTS, MAX_EPOCHS = (5, 2, 1), 3
#: A source's documents are ordered by hash. The place where its mix ends is found by sums over so many ranges of the
#: hash, then over as many parts of the range found; only the documents of that last part are sorted.
PARTS = 256


def _ranked(sources: DataFrame) -> DataFrame:
    """The place of each source by code point, from 0, null last: ranks within sorted ranges plus the ranges before."""
    ranges = written(
        sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id())
    )
    start, starts = 0, []
    for part, n in sorted(ranges.groupBy("part").count().collect()):  # a row for each of a fixed number of ranges
        starts.append((part, start))
        start += n
    starts = ranges.sparkSession.createDataFrame(starts, "part int, start long")
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return ranges.withColumn("own", own).join(starts, "part").withColumn("place", F.col("start") + F.col("own")).drop("part", "own", "start")


def _end(sums: DataFrame, plan: DataFrame, at: str, rest: str) -> DataFrame:
    """Of the sums of each source (words, by ``at``) the one in which ``rest`` of the plan ends, and what is left there."""
    upto = F.sum("words").over(Window.partitionBy("source").orderBy(at))
    found = sums.withColumn("upto", upto).join(plan, F.col("source").eqNullSafe(F.col("s")))
    found = found.where((F.col("upto") - F.col("words") < F.col(rest)) & (F.col(rest) <= F.col("upto")))
    ends = found.select(F.col("s").alias("es"), F.col(at).alias(f"last_{at}"), (F.col(rest) - F.col("upto") + F.col("words")).alias(f"rest_{at}"))
    return written(plan.join(ends, F.col("s").eqNullSafe(F.col("es")), "left").drop("es"))


def water_fill(sources: DataFrame, total: int, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of ``sources`` (weight, source_size): shares of ``total`` by weight, none above its cap.

    Each round clamps the sources above their caps and shares what is left among the rest by weight, until no source
    is above. A round is one aggregate over the table of sources; only its two sums come to the driver.
    """
    cap = F.col("source_size") * F.lit(max_epochs)
    level = None
    while True:
        # at a level, a source gets weight * level or its cap; the level only rises
        free = F.lit(True) if level is None else F.col("weight") * F.lit(level) < cap
        left, weight = sources.agg(
            F.lit(float(total)) - F.coalesce(F.sum(F.when(~free, cap)).cast("double"), F.lit(0.0)),
            F.coalesce(F.sum(F.when(free, F.col("weight"))).cast("double"), F.lit(0.0)),
        ).first()
        higher = left / weight if weight > 0 else level
        if higher is None or (level is not None and higher <= level * (1 + 1e-12)):
            break
        level = higher
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level or 0.0), cap.cast("double")))


def _keyed(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Rows as ``row``, with what a mix needs of them: doc_id, source, size, draw and the draw's range and part."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    keys = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"))
    keys = keys.withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", F.col(f"row.{text_col}")))  # ids may be null or repeat
    return keys.withColumn("range", F.pmod("draw", F.lit(PARTS))).withColumn("part", F.pmod(F.shiftright("draw", 8), F.lit(PARTS)))


def _plan(rows: DataFrame, weights, max_epochs: int) -> DataFrame:
    """For each source s: its size, target, whole epochs, and where the rest of its mix ends."""
    ranges = written(rows.groupBy("source", "range").agg(F.sum("size").alias("words")))
    ranked = _ranked(ranges.groupBy("source").agg(F.sum("words").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = written(ranked.withColumn("weight", weight))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    epochs = F.least(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))), F.lit(max_epochs)).cast("long")
    plan = water_fill(sources, total, max_epochs).select(F.col("source").alias("s"), "source_size", "target", epochs.alias("epochs"))
    plan = plan.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))

    plan = _end(ranges, plan, "range", "rest")
    here = rows.join(plan.select("s", "last_range"), F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("last_range")))
    return _end(here.groupBy("source", "part").agg(F.sum("size").alias("words")), plan, "part", "rest_range")


def _deal(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with source_size, target, epochs and taken. Only the rows of the last part of each source are sorted."""
    dealt = rows.join(plan, F.col("source").eqNullSafe(F.col("s")))
    before = (F.col("range") < F.col("last_range")) | ((F.col("range") == F.col("last_range")) & (F.col("part") < F.col("last_part")))
    at_end = F.coalesce((F.col("range") == F.col("last_range")) & (F.col("part") == F.col("last_part")), F.lit(False))
    outside = dealt.where(~at_end).withColumn("extra", F.when(before, F.col("size")).otherwise(0))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    inside = dealt.where(at_end).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest_part") - F.coalesce(upto, F.lit(0)))))
    return outside.unionByName(inside).withColumn("taken", (F.col("epochs") * F.col("size") + F.col("extra")).cast("long"))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, source_size, target, epochs, taken.

    A source whose target is r times its size gives every document floor(r) whole repetitions. The rest is taken from
    its documents in the order of a seeded hash of id and text until the target is met; the document in which that
    happens gives only its first words, so a source misses its target by less than one word. Ties of the hash go by
    id, then size; rows that agree in these too are interchangeable.

    Null texts have size 0, and null sources are one source, ranked last. A source without words has target 0. Where
    the sum of all caps is below the total, all sources stop at their caps. Repeated rows are rows of their own;
    further columns are ignored; an empty table gives an empty result.
    """
    rows = written(_keyed(docs, seed, id_col, text_col, source_col).drop("row"))
    return _deal(rows, _plan(rows, weights, max_epochs)).select("doc_id", "source", "size", "source_size", "target", "epochs", "taken")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` (documents: doc_id, text, source and more) as the mix takes them, whole.

    A row is repeated for each whole repetition. Where a source's mix ends within a document, that document is taken
    whole once more or not, whichever is nearer to the target. Documents that the mix does not take are left out; those
    without words, of which nothing can be taken, stay once. Texts are dealt where they are read: only the plan, a row
    for each source, meets them. Null texts, ids and sources are as in :func:`mix`; an empty table gives an empty result.
    """
    keyed = _keyed(docs, seed, "doc_id", "text", "source")
    rows = _deal(keyed, _plan(written(keyed.drop("row")), weights, max_epochs)).select("row", "size", "taken")
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.greatest("size", F.lit(1))))).cast("int")
    return rows.withColumn("copy", F.explode(F.array_repeat(F.lit(0), times))).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
