"""Ranked lexical search by Fagin's threshold algorithm.

The index is a table of blocks of documents: a block holds its documents by id, the number of terms of each, and for each
document the terms it has with their occurrences (the forward index). Counts over all blocks give the weights of terms
and the lengths' mean. Then every block of items meets every block of documents in one task. There the postings of each
term are sorted by impact. An item reads its terms' lists in parallel, some entries at a time; each document that is new
is looked up in the forward index and scored whole. What no list has shown yet scores at most the threshold, the weighted sum of
the impacts last read; reading stops when it falls strictly below the k-th score, so that ties are all seen. The best of
all blocks are merged by rank: a task gives k rows an item, and no more than that is shuffled.

Items travel to the index in broadcasts of measured size, in several passes where they are too many for one.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm.common import written

#: Documents and terms of a block at most (a document is never split); entries of each list that are read at a time, at first.
BLOCK_DOCS, BLOCK_TERMS, STEP = 16_384, 4 << 20, 8
#: Items of one meeting on average; bytes of items that one pass broadcasts, and of terms by which an index is restricted.
ITEM_BLOCK, PASS_BYTES = 512, 32 << 20
#: Score constants: parts of one occurrence, length's share of the divisor, its scale.
UNIT, SATURATION, FLAT, SLOPE = 1_000_000_000, 8, 10, 90

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = "block string, ids binary, nulls binary, lengths binary, ends binary, held binary, tf binary, terms array<string>, df array<long>, n_docs long, n_terms long"
LAST = np.iinfo(np.int64).max


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order: stretches of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased."""
    return _TERM.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def terms_column(text: Column) -> Column:
    """:func:`terms_of` as a Column."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM_PATTERN), F.lit(0))


def _block(ids: list[int | None], texts: list[list[bytes]], wanted: set[bytes] | None) -> list:
    """One row of the index."""
    order = sorted(range(len(ids)), key=lambda i: LAST if ids[i] is None else ids[i])
    numbers: dict[bytes, int] = {}
    if wanted is None:
        found = [[numbers.setdefault(t, len(numbers)) for t in texts[i]] for i in order]
    else:
        found = [[numbers.setdefault(t, len(numbers)) for t in texts[i] if t in wanted] for i in order]
    sizes = np.array([len(f) for f in found], np.int64)
    flat = np.fromiter((x for f in found for x in f), np.int64, int(sizes.sum()))
    names = list(numbers)
    ranked = sorted(range(len(names)), key=names.__getitem__)
    place = np.empty(len(names), np.int64)
    place[ranked] = np.arange(len(names))
    width = max(1, len(names))
    keys, tf = np.unique(np.repeat(np.arange(len(order)), sizes) * width + place[flat] if len(flat) else flat, return_counts=True)
    doc, held = keys // width, keys % width
    ends = np.cumsum(np.bincount(doc, minlength=len(order)))
    lengths = np.array([len(texts[i]) for i in order], np.int64)
    mine = [ids[i] for i in order]
    return [
        uuid.uuid4().hex, np.array([0 if i is None else i for i in mine], np.int64).tobytes(), np.packbits([i is None for i in mine]).tobytes(),
        lengths.tobytes(), ends.astype(np.int64).tobytes(), held.astype(np.int32).tobytes(), tf.astype(np.int64).tobytes(),
        [names[i].decode("utf-8", "surrogatepass") for i in ranked], np.bincount(held, minlength=len(names)).tolist(), int((lengths > 0).sum()), int(lengths.sum()),
    ]


def index(docs: DataFrame, wanted: set[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all rows of ``docs``, written; where ``wanted`` is given, without the postings of other terms."""

    def run(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in BLOCK.split(", ")]
        kinds = [pa.string(), *[pa.binary()] * 6, pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), pa.int64()]
        row = lambda *a: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(_block(*a), kinds, strict=True)], names=names)
        ids, texts, total = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                terms = terms_of(text)
                if ids and (len(ids) >= BLOCK_DOCS or total + len(terms) > BLOCK_TERMS):
                    yield row(ids, texts, wanted)
                    ids, texts, total = [], [], 0
                ids.append(i)
                texts.append(terms)
                total += len(terms)
        if ids:
            yield row(ids, texts, wanted)

    return written(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, BLOCK))


class Searcher:
    """One block of documents with its lists sorted by impact, and the threshold algorithm over them."""

    def __init__(self, block, docs: int, terms: int):
        read = lambda column, kind: np.frombuffer(block[column], kind)
        self.ids = read("ids", np.int64)
        self.nulls = np.unpackbits(read("nulls", np.uint8), count=len(self.ids)).astype(bool)
        lengths, self.ends, self.held, tf = read("lengths", np.int64), read("ends", np.int64), read("held", np.int32), read("tf", np.int64)
        self.begins = np.concatenate(([0], self.ends[:-1]))
        self.numbers = {t: i for i, t in enumerate(block["terms"])}
        measure = (100 - SLOPE) + (SLOPE * lengths * docs) // max(1, terms)
        doc = np.repeat(np.arange(len(self.ids)), self.ends - self.begins)
        self.impact = (UNIT * tf) // (1000 * tf + SATURATION * measure[doc])
        order = np.lexsort((-self.impact, self.held))
        self.listed, self.listed_impact = doc[order], self.impact[order]
        self.list_ends = np.cumsum(np.bincount(self.held, minlength=len(self.numbers)))
        self.weights = np.zeros(len(self.numbers), np.int64)

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Whole scores of some documents, each of which has a term: their rows of the forward index."""
        sizes = self.ends[docs] - self.begins[docs]
        starts = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(self.begins[docs] - starts, sizes)
        return np.add.reduceat(self.impact[at] * self.weights[self.held[at]], starts)

    def best(self, terms: list[str], weights: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents with a score above 0, the smaller id first among equals, and their scores."""
        mine = [(self.numbers[t], w) for t, w in zip(terms, weights, strict=True) if w and t in self.numbers]
        empty = np.empty(0, np.int64)
        if not mine or k < 1:
            return empty, empty
        at, weight = np.array([m[0] for m in mine]), np.array([m[1] for m in mine], np.int64)
        self.weights[at] = weight
        ends = self.list_ends[at]
        begins = np.where(at > 0, self.list_ends[at - 1], 0)
        seen = np.zeros(len(self.ids), bool)
        top, top_scores, depth, step = empty, empty, 0, STEP
        while True:
            read = [self.listed[b + depth : min(e, b + depth + step)] for b, e in zip(begins, ends, strict=True)]
            depth += step
            step = min(2 * step, 1024)
            fresh = np.unique(np.concatenate(read))
            fresh = fresh[~seen[fresh]]
            seen[fresh] = True
            if len(fresh):
                docs, scores = np.concatenate((top, fresh)), np.concatenate((top_scores, self.scores(fresh)))
                order = np.lexsort((docs, -scores))[:k]  # places within the block ascend with ids
                top, top_scores = docs[order], scores[order]
            more = begins + depth < ends
            threshold = int((weight[more] * self.listed_impact[(begins + depth - 1)[more]]).sum())
            if not more.any() or (len(top) == k and threshold < top_scores[-1]):
                break
        self.weights[at] = 0
        some = top_scores > 0
        return top[some], top_scores[some]


def _meet(frames: Iterator[pd.DataFrame], docs: int, terms: int, k: int) -> Iterator[pd.DataFrame]:
    import pyarrow as pa

    for frame in frames:
        for block in frame.to_dict("records"):
            searcher = Searcher(block, docs, terms)
            items, ids, scores = [], [], []
            for item in block["items"]:
                found, score = searcher.best(list(item["terms"]), list(item["weights"]), k)
                items += [item["item_id"]] * len(found)
                ids += [None if searcher.nulls[d] else int(searcher.ids[d]) for d in found]
                scores += score.tolist()
            long = pd.ArrowDtype(pa.int64())
            yield pd.DataFrame({"item_id": pd.array(items, long), "doc_id": pd.array(ids, long), "score": pd.array(scores, long), "block": block["block"]})


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: of each item the k documents with the highest score above 0, equal scores by ascending id.

    Terms are ASCII letters and digits and anything beyond ASCII, A-Z lower-cased, over whole texts; a null text has
    none. With N documents that have a term, L terms in all, n terms in a document and df documents that hold a term: a
    term weighs floor(1000 * ln((2N + 2) / (2df + 1))), a document measures 10 + 90 * n * N div L, and it scores the sum,
    over the item's distinct terms, of weight * (10**9 * tf div (1000 * tf + 8 * measure)).

    Rows of one item_id are one item with all their terms; a null item_id is an item as well. Repeated documents count and
    rank each by itself; a null doc_id is last among equal scores. Items without a term that occurs give no rows; an
    empty table on either side gives an empty result. Further columns are ignored, whatever their names.
    """
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.explode(terms_column(F.col(item_text_col))).alias("term")).distinct()
    asked = written(asked)
    words = asked.select("term").distinct()
    size = words.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    wanted = {r[0].encode("utf-8", "surrogatepass") for r in words.toLocalIterator()} if size <= PASS_BYTES else None  # else all are kept
    blocks = index(docs, wanted, id_col, text_col)
    n, total = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    counts = blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy("x.terms").agg(F.sum("x.df").alias("df"))
    weight = F.floor(F.lit(1000) * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = asked.join(counts.withColumnRenamed("terms", "term"), "term").select("item_id", "term", weight.alias("weight"))
    listed = weighed.groupBy("item_id").agg(F.collect_list(F.struct("term", "weight")).alias("t"))
    listed = written(listed.select("item_id", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights")))
    n_items, size = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t) + 24)), F.lit(0))).first()
    groups, passes = max(1, -(-n_items // ITEM_BLOCK)), max(1, -(-size // PASS_BYTES))
    group = F.pmod(F.xxhash64("item_id"), F.lit(groups))
    packed = listed.groupBy(group.alias("group")).agg(F.collect_list(F.struct("item_id", "terms", "weights")).alias("items"))
    if passes > 1:
        packed = written(packed)
    out = None
    for i in range(passes):
        low, high = i * groups // passes, (i + 1) * groups // passes
        if low == high:
            continue
        every = F.explode(F.sequence(F.lit(low), F.lit(high - 1)).cast("array<long>"))
        here = packed.where((F.col("group") >= low) & (F.col("group") < high))
        met = blocks.drop("df", "n_docs", "n_terms").withColumn("group", every).join(F.broadcast(here), "group")  # some PASS_BYTES
        part = met.mapInPandas(lambda frames: _meet(frames, n, total, k), "item_id long, doc_id long, score long, block string")
        if passes > 1:
            part = written(part)
        out = part if out is None else out.union(part)
    # blocks grow with the documents: first the best of each of 256 shares of them
    shared = _ranked(out.withColumn("share", F.pmod(F.xxhash64("block"), F.lit(256))), ["item_id", "share"], k)
    return _ranked(shared.drop("rank"), ["item_id"], k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
