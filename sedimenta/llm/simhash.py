"""Near-duplicates by SimHash fingerprints and a Gray-order hierarchical index.

Fingerprints in the order of their Gray rank (the position of a value in the reflected Gray code) make a binary tree:
values below a node share their upper bits and are neighbours in that order. A node stands for all of them by the bit
pattern they share: a mask and the bits under it. Two nodes whose shared patterns differ in more than ``distance``
bits hold no link, and neither do any nodes below them, so whole groups are left out at once.

Two fingerprints within ``distance`` bits agree on at least one of ``distance + 1`` parts of their bits (on two of
``distance + 2``, and so on). So there is a table of the fingerprints for each part, or set of parts, that may agree, and
a tree of its own below each value there: no other fingerprints need be compared, and the work of one does not grow
with the others, as long as parts are taken that groups stay small.

The index is made of tables. A group that is too large for one task is cut by four more bits, again and again, so a
dense cluster just makes a deeper tree. Pairs of groups descend the tree the same way, each level an equi-join with the
children of those that were cut. What is left are pairs of leaves of bounded size; a task compares two leaves by the
same pruning over blocks of 64 neighbours, and gives back a spanning star of each set of linked fingerprints rather than
all links.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.llm.common import ascii_words, without, written

SHINGLE_WORDS, SEED, DISTANCE = 3, 42, 3
#: Fingerprints in a leaf at most, bits by which a level is deeper than the one above, neighbours in a block of a leaf.
LEAF, STEP, BLOCK = 4096, 4, 64


def fingerprint(text: str | None, k: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Bit i is 1 if it is set in over half the XXH64 of the text's word k-shingles, repeats included."""
    import xxhash

    words = ascii_words(text)
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)) if len(words) > k else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, seed) for s in shingles], "<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and print (the fingerprint's 64 bits as a long) of each row; null texts count as empty."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            values = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values)], names=["doc_id", "print"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, print long")


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Positions of uint64 values in the reflected Gray code."""
    out = values.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


def _shared(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits and mask that the values from each start to the next share."""
    all_of, any_of = np.bitwise_and.reduceat(values, starts), np.bitwise_or.reduceat(values, starts)
    return all_of, ~(all_of ^ any_of)


def linked_stars(a: np.ndarray, b: np.ndarray | None, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars (member, centre) over the links between ``a`` and ``b``, or within ``a``; a and b: distinct uint64."""
    a = a[np.argsort(gray_rank(a))]
    values, own = (a, 0) if b is None else (np.concatenate((a, b := b[np.argsort(gray_rank(b))])), len(a))
    other = a if b is None else b
    sa, sb = np.arange(0, len(a), BLOCK), np.arange(0, len(other), BLOCK)
    (va, ma), (vb, mb) = _shared(a, sa), _shared(other, sb)
    near = np.bitwise_count((va[:, None] ^ vb) & ma[:, None] & mb) <= distance
    if b is None:
        near = np.triu(near)
    labels = np.arange(len(values))
    pairs = np.argwhere(near)
    pad = lambda x: np.concatenate((x, np.zeros(-len(x) % BLOCK, np.uint64))).reshape(-1, BLOCK)
    grid_a, grid_b = pad(a), pad(other)
    for part in np.array_split(pairs, max(1, len(pairs) // 128)):
        if not len(part):
            continue
        close = np.bitwise_count(grid_a[part[:, 0]][:, :, None] ^ grid_b[part[:, 1]][:, None, :]) <= distance
        p, i, j = np.nonzero(close)
        i, j = part[p, 0] * BLOCK + i, part[p, 1] * BLOCK + j
        real = (i < len(a)) & (j < len(other))
        i, j = i[real], j[real] + own
        while True:  # labels fall to the smallest that is linked
            low = np.minimum(labels[i], labels[j])
            before = labels.copy()
            np.minimum.at(labels, labels[i], low)
            np.minimum.at(labels, labels[j], low)
            labels = labels[labels]
            if (labels == before).all():
                break
    member = np.flatnonzero(labels != np.arange(len(values)))
    return values[member], values[labels[member]]


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of all nodes of ``edges`` (a, b: longs).

    Large-star and small-star steps in turn, until stars are all there is. Each step takes minima by node, combined
    before the shuffle, and joins them back, so a hub with many edges is a skewed join side that Spark splits.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, last = written(now), None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(least, "a")
        small = met.select("a", F.col("m").alias("b")).union(met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        now = written(small.where("a <> b").distinct())
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    roots = now.select(F.col("b").alias("a")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("a", "a"))


def stars_of_groups(values: np.ndarray, sizes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars (member, centre) over the links within each of many groups of BLOCK values at most, one after the other."""
    starts = np.cumsum(sizes) - sizes
    labels = np.arange(len(values))
    width = 2
    while width <= BLOCK:
        mine = starts[(sizes <= width) & (sizes > width // 2)]
        some = sizes[(sizes <= width) & (sizes > width // 2)]
        for part in np.array_split(np.arange(len(mine)), max(1, len(mine) * width * width >> 20)):
            at = np.minimum(mine[part][:, None] + np.arange(width), len(values) - 1)
            real = np.arange(width) < some[part][:, None]
            grid = values[at]
            near = (np.bitwise_count(grid[:, :, None] ^ grid[:, None, :]) <= distance) & real[:, :, None] & real[:, None, :] & ~np.tri(width, dtype=bool)
            g, i, j = np.nonzero(near)
            i, j = at[g, i], at[g, j]
            while True:  # labels fall to the smallest that is linked
                low = np.minimum(labels[i], labels[j])
                before = labels.copy()
                np.minimum.at(labels, labels[i], low)
                np.minimum.at(labels, labels[j], low)
                labels = labels[labels]
                if (labels == before).all():
                    break
        width *= 2
    member = np.flatnonzero(labels != np.arange(len(values)))
    return values[member], values[labels[member]]


def parts_of(rows: int, distance: int, leaf: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each table, how many bits must agree, and all parts of a fingerprint (shift, width) with those that must first.

    As few parts must agree as leave a leaf's worth of evenly spread fingerprints in a group."""
    agree = 1
    while agree < 4 and rows >> (64 * agree // (distance + agree)) > leaf // 8:
        agree += 1
    n = distance + agree
    ends = [64 * i // n for i in range(n + 1)]
    parts = [(64 - b, b - a) for a, b in zip(ends, ends[1:], strict=False)]
    chosen = list(combinations(range(n), agree))
    return [(sum(parts[i][1] for i in c), [parts[i] for i in c] + [parts[i] for i in range(n) if i not in c]) for c in chosen]


def _moved(column: Column, parts: list[tuple[int, int]]) -> Column:
    """The bits of a long with its parts in another order, the first on top."""
    out, room = F.lit(0).cast("long"), 64
    for shift, width in parts:
        room -= width
        part = F.shiftrightunsigned(column, shift).bitwiseAND(F.lit((1 << width) - 1))
        out = out.bitwiseOR(F.shiftleft(part, room))
    return out


def _upper(column: Column, depth: Column) -> Column:
    """The upper ``depth`` bits (1 or more), the others 0."""
    return column.bitwiseAND(F.call_function("shiftleft", F.lit(-1).cast("long"), F.lit(64) - depth))


def _cells(rows: DataFrame) -> DataFrame:
    """Groups of equal upper bits in a table: their size and the pattern they share."""
    shared = F.bitwise_not(F.bit_or("print").bitwiseXOR(F.bit_and("print")))
    return rows.groupBy("table", "depth", "cell").agg(F.count(F.lit(1)).alias("n"), F.bit_and("print").alias("bits"), shared.alias("mask"))


def _near(distance: int) -> Column:
    return F.bit_count(F.col("bits").bitwiseXOR(F.col("bits2")).bitwiseAND(F.col("mask")).bitwiseAND(F.col("mask2"))) <= distance


def links(prints: DataFrame, distance: int = DISTANCE, leaf: int = LEAF) -> DataFrame:
    """Edges (a, b) that connect the same fingerprints as all links do; ``prints``: distinct values in ``print``."""
    tables = parts_of(prints.count(), distance, leaf)
    entries = F.array(*[F.struct(F.lit(i).alias("table"), F.lit(depth).alias("depth"), _moved(F.col("print"), parts).alias("moved")) for i, (depth, parts) in enumerate(tables)])
    rows = prints.select("print", F.inline(entries)).withColumn("cell", _upper(F.col("moved"), F.col("depth")))
    cells = written(_cells(rows).where("n > 1"))
    key = ["table", "depth", "cell"]

    # groups that are one leaf, by far the most: each is compared within itself
    def within(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(0)
            values, sizes = np.asarray(lists.flatten()).astype(np.int64).view(np.uint64), np.asarray(lists.value_lengths()).astype(np.int64)
            few, ends = sizes <= BLOCK, np.cumsum(sizes)
            found = [stars_of_groups(values[np.repeat(few, sizes)], sizes[few], distance)]
            found += [linked_stars(values[ends[i] - sizes[i] : ends[i]], None, distance) for i in np.flatnonzero(~few)]
            for member, centre in found:
                if len(member):
                    yield pa.RecordBatch.from_arrays([pa.array(member.view(np.int64)), pa.array(centre.view(np.int64))], names=["a", "b"])

    leaves = rows.join(cells.where(f"n <= {leaf}").select(*key), key, "left_semi").groupBy(*key).agg(F.collect_list("print").alias("prints"))
    edges = leaves.select("prints").mapInArrow(within, "a long, b long")

    # the others are cut, and pairs of their parts descend
    large = written(cells.where(F.col("n") > leaf).select(*key))
    if large.isEmpty():
        return edges
    rest = written(rows.join(large, key, "left_semi").select("table", "depth", "cell", "moved", "print"))
    facts = ["table", *key[1:], "n", "bits", "mask"]
    second = facts[1:]
    pairs = cells.where(F.col("n") > leaf).select(*facts, *[F.col(c).alias(f"{c}2") for c in second])
    done, blocks = [], []
    while not large.isEmpty():
        rest = rest.withColumns({"over": F.col("depth"), "up": F.col("cell"), "depth": F.least(F.col("depth") + STEP, F.lit(64))}).withColumn("cell", _upper(F.col("moved"), F.col("depth")))
        rest = written(rest)
        cells = written(_cells(rest))
        child = rest.select(*key, "over", "up").distinct().join(cells, key)

        def descend(frame, mark, child=child):
            """A side that was cut is replaced by its children, one that is a leaf stays."""
            kids = child.select("table", F.col("over").alias(f"depth{mark}"), F.col("up").alias(f"cell{mark}"), *[F.col(c).alias(f"c_{c}") for c in second])
            other = "" if mark else "2"
            return frame.join(kids, ["table", f"depth{mark}", f"cell{mark}"], "left").select(
                "table", *[F.coalesce(F.col(f"c_{c}"), F.col(f"{c}{mark}")).alias(f"{c}{mark}") for c in second], *[f"{c}{other}" for c in second], "same"
            )

        both = descend(descend(pairs.withColumn("same", F.expr("cell = cell2 and depth = depth2")), ""), "2")
        once = ~F.col("same") | (F.col("cell") <= F.col("cell2"))
        pairs = written(both.where(_near(distance) & once).select(*facts, *[f"{c}2" for c in second]))
        done.append(pairs.where(f"n <= {leaf} and n2 <= {leaf}"))
        pairs = pairs.where(f"n > {leaf} or n2 > {leaf}")
        large = written(cells.where(F.col("n") > leaf).select(*key))
        blocks.append(rest.join(large, key, "left_anti").select(*key, "print"))
        rest = rest.join(large, key, "left_semi").drop("over", "up")

    gathered = written(reduce(DataFrame.union, blocks).groupBy(*key).agg(F.collect_list("print").alias("prints")))
    met = reduce(DataFrame.union, done).select("table", "depth", "cell", "depth2", "cell2").join(gathered, key)
    met = met.join(gathered.select("table", F.col("depth").alias("depth2"), F.col("cell").alias("cell2"), F.col("prints").alias("prints2")), ["table", "depth2", "cell2"])
    same = (F.col("cell") == F.col("cell2")) & (F.col("depth") == F.col("depth2"))

    def compare(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (np.asarray(batch.column(c)[i].values).astype(np.int64).view(np.uint64) for c in (0, 1))
                member, centre = linked_stars(a, None if batch.column(2)[i].as_py() else b, distance)
                if len(member):
                    yield pa.RecordBatch.from_arrays([pa.array(member.view(np.int64)), pa.array(centre.view(np.int64))], names=["a", "b"])

    return edges.union(met.select("prints", "prints2", same.alias("same")).mapInArrow(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints that differ in ``distance`` bits or fewer are linked; component_id is the smallest id that can be
    reached, the row's own included. Texts without words (null, empty, white space) have fingerprint zero, which is
    linked like any other; texts of fewer words than a shingle are one shingle. Rows that share an id are one
    document. A row whose id is null makes no links: it gets the component of its fingerprint, null if no row with an
    id has it. Further columns are ignored; an empty table gives an empty result.
    """
    prints = written(fingerprints(docs, id_col, text_col))
    nodes = written(prints.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("node")))
    edges = links(nodes.select("print"), distance)
    first, second = (nodes.select(F.col("print").alias(c), F.col("node").alias(f"n{c}")) for c in ("a", "b"))
    edges = edges.join(first, "a").join(second, "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    found = components(edges)
    classes = nodes.join(found, "node", "left").select("print", F.coalesce("component", "node").alias("component_id"))
    return prints.join(classes, "print", "left").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component of linked fingerprints: the one with the smallest id, of rows that have it
    too (repeated rows, ids with several texts, no id at all) one with the smallest fingerprint. Columns as they are; an
    empty table gives an empty result.

    Rows without an id are linked like any others. Rows are numbered, and kept with their fingerprints, so texts are
    read and hashed once and never shuffled.
    """
    at = docs.columns.index("text")
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("print", T.LongType())])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            values = np.array([fingerprint(t) for t in b.column(at).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(b.columns, fields=list(b.schema)), pa.array(values)], names=["row", "print"])

    keyed = written(docs.mapInArrow(run, schema).withColumn("number", F.monotonically_increasing_id()))
    id_of = F.col("row.doc_id").cast("long")
    # components are found over the prints themselves, whose order says nothing; of each, the row with the least id stays
    prints = written(keyed.groupBy("print").agg(F.min(F.struct(id_of.isNull().alias("none"), id_of.alias("id"), "print", "number")).alias("least")))
    found = components(links(prints.select("print"), DISTANCE)).select(F.col("node").alias("print"), "component")
    stays = prints.join(found, "print", "left").groupBy(F.coalesce("component", "print").alias("component")).agg(F.min("least").alias("least"))
    return without(keyed, keyed.select("number").join(stays.select("least.number"), "number", "left_anti"))
