"""Ranking of target columns for source fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.names import similarity, tokens

AUTO, REVIEW, LEAD = 0.90, 0.70, 0.10


def candidates(sources: DataFrame, targets: DataFrame, k: int = 3) -> DataFrame:
    """source, target, score of all pairs whose score is not 0, and of enough others to rank k targets and the next.

    Pairs come from an equi-join on whole names, words, all letters, and two letters in a row. No other pair has a score:
    names within e edits, e at most 3 and a quarter of the longer, the shorter of m >= 4 letters, share m - 1 - 2e >= 1
    of the latter. As such pairs are ranked by target, the least 2k + 2 targets are paired with every source.
    """
    letters = lambda c: F.array_join(tokens(c), "")
    pieces = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(letters(c)) - 1, F.lit(1))), lambda i: F.substring(letters(c), i, 2))
    block = lambda c: F.explode(F.array_distinct(F.concat(tokens(c), pieces(c), F.array(c, letters(c)))))
    left = sources.select("source", block(F.col("source")).alias("b"))
    right = targets.select("target", block(F.col("target")).alias("b"))
    least = targets.select("target").where("target is not null").distinct().orderBy("target").limit(2 * k + 2)
    pairs = left.join(right, "b").select("source", "target").union(sources.select("source").where("source is not null").crossJoin(least)).distinct()
    return pairs.withColumn("score", similarity(F.col("source"), F.col("target")))


def best_matches(scored: DataFrame, k: int = 3) -> DataFrame:
    """The k best targets of each source with rank, gap to the next, competitors at the same score, and status: auto at
    0.9 or more with a lead of 0.1, review at 0.7 or more, else rejected."""
    order = Window.partitionBy("source").orderBy(F.desc("score"), "target")
    out = scored.withColumn("rank", F.row_number().over(order)).withColumn("gap", F.round(F.col("score") - F.coalesce(F.lead("score").over(order), F.lit(0.0)), 6))
    status = F.when((F.col("score") >= AUTO) & (F.col("gap") >= LEAD), "auto").when(F.col("score") >= REVIEW, "review").otherwise("rejected")
    return out.where(F.col("rank") <= k).withColumn("status", status)

WEIGHTS = {"name": 0.35, "alias": 0.20, "type": 0.20, "pattern": 0.10, "structure": 0.10, "graph": 0.05}
COMPATIBLE = {("integer", "integer"), ("integer", "decimal"), ("decimal", "decimal"), ("number", "number"), ("string", "string"), ("date", "date"), ("datetime", "datetime"), ("boolean", "boolean")}
CONDITIONAL = {("integer", "string"): 0.75, ("decimal", "string"): 0.75, ("date", "datetime"): 0.75, ("decimal", "integer"): 0.5, ("string", "integer"): 0.5, ("string", "decimal"): 0.5, ("datetime", "date"): 0.5, ("number", "decimal"): 0.75, ("integer", "number"): 0.75}


def type_compatibility(source_kind, target_kind):
    """1 for kinds that go together, 0.75 or 0.5 for those that do under a condition, null for those that do not."""
    pairs = [(a, b, 1.0) for a, b in sorted(COMPATIBLE)] + [(a, b, s) for (a, b), s in CONDITIONAL.items()]
    table = F.create_map(*[F.lit(x) for a, b, s in pairs for x in (f"{a}>{b}", s)])
    return F.try_element_at(table, F.concat_ws(">", source_kind, target_kind))


def weighted(scored: DataFrame, signals: list[str]) -> DataFrame:
    """``score``: the weighted sum of signals (columns), a missing one counting 0, without scaling up the rest."""
    total = sum(F.coalesce(F.col(s), F.lit(0.0)) * WEIGHTS[s] for s in signals)
    return scored.withColumn("score", F.bround(total, 6))


def with_penalties(ranked: DataFrame, penalty: float = 0.10) -> DataFrame:
    """Scores of best_matches less ``penalty`` for a lead under 0.1, and again where several sources want the target."""
    wanted = F.count_if(F.col("rank") == 1).over(Window.partitionBy("target"))
    less = F.when(F.col("gap") < LEAD, penalty).otherwise(0.0) + F.when((wanted > 1) & (F.col("rank") == 1), penalty).otherwise(0.0)
    return ranked.withColumn("final", F.greatest(F.lit(0.0), F.bround(F.col("score") - less, 6)))


def ranking_metrics(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: cases, recall at 1 and 3, mean reciprocal rank, targets taken as auto that are wrong, and the share of cases
    taken so. ``expected``: source, expected."""
    hit = ranked.select("source", "target", "rank", "status").join(expected.withColumnRenamed("source", "_s"), F.col("source") == F.col("_s"))
    right = F.col("target") == F.col("expected")
    auto = (F.col("rank") == 1) & (F.col("status") == "auto")
    by = hit.groupBy("source").agg(F.min(F.when(right, F.col("rank"))).alias("at"), F.bool_or(auto).alias("auto"), F.bool_or(auto & ~right).alias("wrong"))
    all_of = expected.select("source").join(by, "source", "left")
    at, n = F.col("at"), F.count(F.lit(1))
    return all_of.agg(
        n.alias("cases"), F.avg(F.coalesce((at <= 1).cast("double"), F.lit(0.0))).alias("recall_1"), F.avg(F.coalesce((at <= 3).cast("double"), F.lit(0.0))).alias("recall_3"), F.avg(F.coalesce(1 / at, F.lit(0.0))).alias("mrr"),
        F.count_if("wrong").alias("false_auto"), F.avg(F.coalesce(F.col("auto").cast("double"), F.lit(0.0))).alias("auto_coverage"),
    )


def anchors(scored: DataFrame, least: float = 0.95, lead: float = LEAD) -> DataFrame:
    """Sources whose best target is sure enough to judge others by: a score of ``least`` with a lead over the second."""
    w = Window.partitionBy("source").orderBy(F.desc("score"), "target")
    out = scored.withColumn("rank", F.row_number().over(w)).withColumn("next", F.coalesce(F.lead("score").over(w), F.lit(0.0)))
    return out.where((F.col("rank") == 1) & (F.col("score") >= least) & (F.col("score") - F.col("next") >= lead)).select("source", "target", "score")


def table_scores(scored: DataFrame, k: int = 3) -> DataFrame:
    """entity, table, score, rank: the mean over an entity's fields of each one's best candidate in a table, k tables each.
    ``scored``: entity, source, table, score; a field without a candidate there counts 0."""
    best = scored.groupBy("entity", "table", "source").agg(F.max("score").alias("score"))
    fields = scored.groupBy("entity").agg(F.count_distinct("source").alias("fields"))
    means = best.groupBy("entity", "table").agg(F.sum("score").alias("total")).join(fields, "entity").select("entity", "table", F.bround(F.col("total") / F.col("fields"), 6).alias("score"))
    return means.withColumn("rank", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("score"), "table"))).where(F.col("rank") <= k)


def pattern_share(patterns: DataFrame, expected: DataFrame) -> DataFrame:
    """field, kind, share: how much of a field's values has a pattern that a kind of target expects. ``patterns``: field,
    pattern, n, non_null; ``expected``: kind, pattern."""
    met = patterns.join(expected, "pattern").groupBy("field", "kind").agg(F.max(F.col("n") / F.col("non_null")).alias("share"))
    return met.withColumn("share", F.bround("share", 6))


def graph_support(pairs: DataFrame, edges: DataFrame, found: DataFrame) -> DataFrame:
    """source, target, support of candidates (source, target, table) by anchors (table) in tables that a foreign key links to
    theirs: 1 where parent and child are both anchored, 0.5 where only the other is, else 0. ``edges``: parent, child."""
    both = edges.select(F.col("parent").alias("_t"), F.col("child").alias("_o")).union(edges.select("child", "parent"))
    tables = found.select(F.col("table").alias("_a")).distinct()
    near = both.join(tables, F.col("_o") == F.col("_a"), "left_semi").select("_t").distinct()
    own = tables.withColumnRenamed("_a", "_own")
    met = pairs.join(near, F.col("table") == F.col("_t"), "left").join(own, F.col("table") == F.col("_own"), "left")
    return met.select("source", "target", F.when(F.col("_t").isNull(), 0.0).when(F.col("_own").isNotNull(), 1.0).otherwise(0.5).alias("support"))
