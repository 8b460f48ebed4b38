"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

Rows are dealt at random to blocks of bounded size, queries to blocks of their own, and every block of queries meets
every block of candidates in one task. There the candidates become postings (for each dimension, the rows that have
it and their weights). Each query takes its terms one at a time and scatters weight times posting into a dense array
of scores; a partition selects the k best, and the best of all blocks are merged by rank. A query travels once for
each block of candidates and the other way round; scores never leave a task but for k rows a query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block on average: together, a task's two sides are some tens of MB.
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 16_384


def _vectors(column, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists as one dense matrix of integers; shorter ones end in zeros."""
    out = np.zeros((len(column), length), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def best_of_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> pd.DataFrame:
    """The k best candidates of each query, ties to the smaller id, its own id left out; ids may repeat on either side."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))  # an id that repeats counts with its best row
    distinct = ids[starts]
    postings = []
    for d in range(vectors.shape[1]):
        rows = np.flatnonzero(vectors[:, d])
        weights = np.ascontiguousarray(vectors[rows, d])
        postings.append((slice(None) if len(rows) == len(ids) else rows, weights))
    out_query, out_id, out_score = [], [], []
    for query_id, query in zip(query_ids, queries, strict=True):
        scores = np.zeros(len(ids), np.int64)
        for d in np.flatnonzero(query):
            rows, weights = postings[d]
            scores[rows] += query[d] * weights
        if len(distinct) < len(ids):
            scores = np.maximum.reduceat(scores, starts)
        at = np.arange(len(distinct))
        own = np.searchsorted(distinct, query_id)
        if own < len(distinct) and distinct[own] == query_id:
            at = np.delete(at, own)
        if len(at) > k:
            edge = np.partition(scores[at], len(at) - k)[len(at) - k]
            above, level = at[scores[at] > edge], at[scores[at] == edge]  # ids ascend, so ties go to the smaller
            at = np.concatenate((above, level[: k - len(above)]))
        out_query.append(np.full(len(at), query_id))
        out_id.append(distinct[at])
        out_score.append(scores[at])
    join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    return pd.DataFrame({"query_id": join(out_query), "vec_id": join(out_id), "score": join(out_score)})


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each row whose id is divisible by ``every``.

    Components become floor(scale * x) with x as a double; the score is the integer inner product, a missing dimension
    of a shorter vector counting 0. Candidates are all rows but the query's own; ties go to the smaller id; with fewer
    candidates than k, all are returned. Rows whose id or vector is null, or whose vector holds a null, NaN or
    infinite component, take no part. An id that repeats counts once, with its best row on either side. Empty vectors
    score 0. Further columns are ignored; an empty table gives an empty result. Products must fit 64 bits.
    """
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale))
    finite = ~F.exists(F.col(vector_col), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), whole.cast("array<long>").alias("v"))
    asked = F.col("id") % every == 0
    n, n_asked, longest = rows.agg(F.count(F.lit(1)), F.count_if(asked), F.max(F.size("v"))).first()
    blocks, query_blocks = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-n_asked // QUERY_BLOCK))
    draw = F.xxhash64("id")  # rows of one id are in one block
    own, other = F.pmod(draw, F.lit(blocks)).cast("int"), F.pmod(draw, F.lit(query_blocks)).cast("int")
    all_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    queries = rows.where(asked).select("id", "v", other.alias("q"), all_of(blocks).alias("c"))
    candidates = rows.select("id", "v", own.alias("c"), all_of(query_blocks).alias("q"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = _vectors(left["v"], longest or 0), _vectors(right["v"], longest or 0)
        return best_of_block(left["id"].to_numpy(np.int64), a, right["id"].to_numpy(np.int64), b, k)

    found = queries.groupBy("q", "c").cogroup(candidates.groupBy("q", "c")).applyInPandas(meet, "query_id long, vec_id long, score long")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
