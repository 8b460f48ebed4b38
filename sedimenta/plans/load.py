"""Load plans: what to insert, update, skip or quarantine, in which order, and how rejection spreads."""

from __future__ import annotations

import heapq
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.sources.shared import discarded, tidied, written

#: Rounds of neighbours that rejection spreads by before whole components are found.
ROUNDS = 4


def plan_actions(incoming: DataFrame, stored: DataFrame, identity: list[str], mutable: list[str], issues: DataFrame | None = None) -> DataFrame:
    """Incoming rows with action: quarantine if the row has an issue, else update (or skip, where nothing is mutable)
    if its identity is stored, else insert. ``issues`` holds the identity columns of rows with findings."""
    known = stored.select(*identity).distinct().withColumn("_stored", F.lit(True))
    out = incoming.join(known, identity, "left")
    bad = F.lit(False)
    if issues is not None:
        out = out.join(issues.select(*identity).distinct().withColumn("_bad", F.lit(True)), identity, "left")
        bad = F.coalesce("_bad", F.lit(False))
    action = F.when(bad, "quarantine").when(F.col("_stored"), F.lit("update" if mutable else "skip")).otherwise("insert")
    return out.withColumn("action", action).drop("_stored", "_bad")


def action_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count(F.lit(1)).alias("rows"))


def rejection_closure(edges: DataFrame, rejected: DataFrame, cut=written) -> DataFrame:
    """node, direct: all nodes that rejection reaches over ``edges`` (a, b: either way).

    A few rounds join only the nodes that the one before has reached, each written by itself. Whatever is far along a chain
    after them is reached by components, in a number of rounds that grows with the logarithm of its length.
    """
    direct = cut(rejected.select(F.col(rejected.columns[0]).alias("node")).where("node is not null").distinct())
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a is not null and b is not null").distinct())
    seen = front = direct
    for _ in range(ROUNDS):
        reached = front.join(both, front.node == both.a).select(F.col("b").alias("node")).distinct()
        front = cut(reached.join(seen, "node", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.union(front)
    else:
        groups = connected(edges, cut)
        hit = groups.join(front, "node", "left_semi").select("component").distinct()
        seen = seen.union(groups.join(hit, "component", "left_semi").select("node")).distinct()
    return seen.join(direct.withColumn("direct", F.lit(True)), "node", "left").select("node", F.coalesce("direct", F.lit(False)).alias("direct"))


def connected(edges: DataFrame, cut=tidied) -> DataFrame:
    """node, component (its least node) of all nodes of ``edges`` (a, b: either way; nulls are no nodes)."""
    whole = edges.where("a is not null and b is not null")
    found = components(whole.where("a <> b"), cut)
    alone = whole.where("a = b").select(F.col("a").alias("node")).distinct().join(found, "node", "left_anti")
    return found.union(alone.select("node", F.col("node").alias("component")))


def components(edges: DataFrame, cut=tidied) -> DataFrame:
    """:func:`connected` for edges between two different nodes, as a table of its own.

    Nodes with one edge take their neighbour's component and go through no round. Every round points each other node's
    neighbours at the least node among them, larger ones first, then all, until stars are left. Minima are combined before
    they are shuffled, and a node with many edges is a skewed join side that Spark splits. Each round is written by ``cut``,
    edges only, none rewrites what an earlier one has settled, and a table goes when the next one is there.
    """
    every = cut(edges.select("a", "b"))
    ends = cut(every.union(every.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("n")))
    inner, outer = ends.where("n > 1"), ends.where("n = 1").select("node", "least")
    core = every.join(inner.select(F.col("node").alias("a")), "a", "left_semi").join(inner.select(F.col("node").alias("b")), "b", "left_semi")
    now = cut(core.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    discarded(every)
    last = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(low, "a")
        small = met.select("a", F.col("m").alias("b")).union(met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        before, now = now, cut(small.distinct())
        discarded(before)
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == last:
            break
        last = state
    # the least node of a component may be one of those left out: each inner node knows its least neighbour
    stars = inner.join(now.select(F.col("a").alias("node"), F.col("b").alias("star")), "node", "left").select("node", "least", F.coalesce("star", "node").alias("star"))
    lowest = stars.groupBy("star").agg(F.min(F.least("node", "least")).alias("component"))
    settled = cut(stars.join(lowest, "star").select("node", "component"))
    discarded(now)
    hung = outer.join(settled.select(F.col("node").alias("least"), "component"), "least", "left")  # two with no other edge have none
    found = cut(settled.union(hung.select("node", F.coalesce("component", F.least("node", "least")))))
    discarded(ends, settled)
    return found


def load_order(tables: list[str], edges: list[tuple[str, str]]) -> list[str] | None:
    """Tables parents first, ties by name; None if foreign keys (parent, child) form a cycle. Metadata-sized."""
    waiting = {t: 0 for t in tables}
    for parent, child in set(edges):
        if parent == child:
            return None
        waiting[child] += 1
    ready = [t for t, n in waiting.items() if not n]
    heapq.heapify(ready)
    out = []
    while ready:
        out.append(table := heapq.heappop(ready))
        for parent, child in sorted(set(edges)):
            if parent == table:
                waiting[child] -= 1
                if not waiting[child]:
                    heapq.heappush(ready, child)
    return out if len(out) == len(tables) else None


def row_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with sha256 over the columns as text, in order, nulls told apart from the text of any value."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return df.withColumn("fingerprint", F.sha2(reduce(lambda a, b: F.concat(a, F.lit("\x1f"), b), parts), 256))


def merged(stored: DataFrame, incoming: DataFrame, identity: list[str]) -> DataFrame:
    """The table after an upsert: incoming rows in the place of stored ones of the same identity, others as they are.

    Of incoming rows that share an identity, the one that is largest column by column stays. Applying the same rows again
    changes nothing. Null identities are equal to each other.
    """
    rest = [c for c in stored.columns if c not in identity]
    last = F.max(F.struct(*rest) if rest else F.lit(0)).alias("_last")
    once = incoming.groupBy(*identity).agg(last)
    once = once.select(*[F.col(c) if c in identity else F.col("_last").getField(c).alias(c) for c in stored.columns])
    same = reduce(lambda a, b: a & b, [F.col(f"s.{k}").eqNullSafe(F.col(f"i.{k}")) for k in identity])
    kept = stored.alias("s").join(once.alias("i"), same, "left_anti")
    return kept.select(*stored.columns).unionByName(once)
