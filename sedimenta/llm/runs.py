"""Periodic runs of words: repeated k-gram masking, then Main-Lorentz on what survives.

A run is a stretch of words with smallest period q and at least max(least, times * q) words that no neighbouring word
extends. Its words at distance q are equal over length - q >= k words, where k follows from the least overlap that the
two bounds leave. So every word of a run lies in a k-gram that occurs twice in its document: from the start up to the
last q words those that occur q words later, from the first q words on those that occur q words earlier, and as a run
has two periods at least, these cover it. Words outside such k-grams can join no run; what is left are segments.

In each segment of ``least`` words or more, Main-Lorentz divides and conquers: a run that crosses the middle of a block is
found from four tables of common prefixes and suffixes with that middle, in time linear in the block. What a block's
border cuts is left to the block above, whose middle it crosses.

A k-gram is told by a 64-bit product hash: where two clash, a segment is longer than need be and nothing else changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text whose words are held as numbers at once; a longer text is by itself.
SLICE_BYTES = 4 << 20
#: An odd multiplier for the hash of k-grams.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = "{id} long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def least_overlap(least: int, times: int) -> int:
    """The fewest words over which a run equals itself one period later: length - period, for any period."""
    return min(max(least, times * q) - q for q in range(1, max(2, least // times + 2)))


def covered(words: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a k-gram that starts at two places at least of the same document."""
    n = len(words) - k + 1
    out = np.zeros(len(words), bool)
    if n <= 0:
        return out
    mixed = (words.astype(np.uint64) + np.uint64(1)) * MULTIPLIER
    mixed ^= mixed >> np.uint64(29)
    gram = np.zeros(n, np.uint64)
    for j in range(k):
        gram *= MULTIPLIER
        gram += mixed[j : j + n]
    gram ^= gram >> np.uint64(32)
    gram = (gram * MULTIPLIER) ^ (doc[:n].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])  # those within one document
    order = np.argsort(gram[at])
    sorted_ = gram[at][order]
    same = sorted_[1:] == sorted_[:-1]
    again = np.zeros(len(at), bool)
    again[:-1] |= same
    again[1:] |= same
    edges = np.zeros(len(words) + 1, np.int32)
    begins = at[order[again]]
    np.add.at(edges, begins, 1)
    np.add.at(edges, begins + k, -1)
    return np.cumsum(edges[:-1]) > 0


def _prefixes(s: list[int]) -> list[int]:
    """For each place, how far the list from there agrees with its beginning."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        length = z[i - left] if i < right else 0
        if i + length >= right:
            length = max(0, right - i)
            while i + length < n and s[i + length] == s[length]:
                length += 1
            left, right = i, i + length
        z[i] = length
    return z


def main_lorentz(w: list[int], least: int, times: int) -> dict[tuple[int, int], int]:
    """The runs of a list of numbers, (start, end) with their smallest period; ``times`` is 2 at least."""
    found: dict[tuple[int, int], int] = {}

    def keep(start: int, end: int, q: int, low: int, high: int) -> None:
        if end - start < max(least, times * q):
            return
        if start == low and low and w[low - 1] == w[low - 1 + q]:
            return  # goes on to the left of the block
        if end == high and high < len(w) and w[high] == w[high - q]:
            return
        if found.get((start, end), q) >= q:
            found[start, end] = q

    stack = [(0, len(w))]
    while stack:
        low, high = stack.pop()
        if high - low < least:
            continue
        middle = (low + high) // 2
        stack += [(low, middle), (middle, high)]
        left, right, whole = w[low:middle], w[middle:high], w[low:high]
        a, b = len(left), len(right)
        forward = _prefixes(right)  # from middle + q against from middle
        backward = _prefixes(left[::-1] + [-1] + whole[::-1])  # up to middle + q against up to middle
        for q in range(1, b):
            before, after = backward[a + 1 + b - q], forward[q]
            if before + after >= q:
                keep(middle - before, middle + q + after, q, low, high)
        backward = _prefixes(left[::-1])  # up to middle - q against up to middle
        forward = _prefixes(right + [-1] + whole)  # from middle - q against from middle
        for q in range(1, a + 1):
            before, after = backward[q] if q < a else 0, forward[b + 1 + a - q]
            if before + after >= q:
                keep(middle - q - before, middle + after, q, low, high)
    return found


def runs_of(words: np.ndarray, keep: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) by start, then period, of one document's words of which ``keep`` may join runs."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], keep, [False])).astype(np.int8)))
    out = []
    for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if end - begin >= least:
            out += [(begin + s, e - s, q) for (s, e), q in main_lorentz(words[begin:end].tolist(), least, times).items()]
    return sorted(out, key=lambda r: (r[0], r[2]))


def _slices(texts: list[str | None]) -> Iterator[list[list[bytes]]]:
    """The words of each text, as many texts at a time as fit ``SLICE_BYTES``."""
    held, size = [], 0
    for text in texts:
        body = text.encode("utf-8", "surrogatepass") if text else b""
        if held and size + len(body) > SLICE_BYTES:
            yield held
            held, size = [], 0
        held.append(body.split())  # bytes know the six ASCII spaces only, as wanted
        size += len(body)
    if held:
        yield held


def _found(texts: list[str | None], least: int, times: int) -> Iterator[tuple[int, list[tuple[int, int, int]], str]]:
    k = least_overlap(least, times)
    for docs in _slices(texts):
        numbers: dict[bytes, int] = {}
        sizes = np.array([len(d) for d in docs], np.int64)
        words = np.fromiter((numbers.setdefault(x, len(numbers)) for d in docs for x in d), np.int64, int(sizes.sum()))
        keep = covered(words, np.repeat(np.arange(len(docs)), sizes), k)
        ends = np.cumsum(sizes)
        for doc, begin, end in zip(docs, (ends - sizes).tolist(), ends.tolist(), strict=True):
            runs = runs_of(words[begin:end], keep[begin:end], least, times) if keep[begin:end].any() else []
            if runs:
                edges = np.zeros(len(doc) + 1, np.int64)
                for start, length, period in runs:
                    edges[start + period] += 1
                    edges[start + length] -= 1
                stays = np.cumsum(edges[:-1]) == 0
                doc = [doc[i] for i in np.flatnonzero(stays).tolist()]
            yield end - begin, runs, b" ".join(doc).decode("utf-8", "surrogatepass")


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs and the collapsed text of each row of ``docs``.

    Words are stretches without ASCII space; runs are (start, length, period) in words from 0, by start, then period.
    The collapsed text joins by one space the words that no run contains after its own first period. A null or empty
    text has no words, no runs and an empty collapsed text. Repeated rows and null ids give a row each; further columns are
    ignored, whatever their names; an empty table gives an empty result. A text is in one task, as whole as it comes;
    work is n log n in its words. ``times`` must be 2 or more.
    """
    if times < 2:
        raise ValueError("a run has two periods at least")

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            found = list(_found(batch.column(1).to_pylist(), least, times))
            runs = [[{"start": s, "length": n, "period": q} for s, n, q in f[1]] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array(runs, kind), pa.array([f[2] for f in found], pa.string())],
                names=[id_col, "n_words", "runs", "collapsed"],
            )

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA.format(id=id_col))


def with_loops(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text, where every tenth document, by crc32 of its id in decimal, ends in a loop of its own words.

    With h the crc32, g = h div 10 and n words: from word a = g mod n on, word i becomes word a + (i - a) mod p, where
    p = 1 + (n - a) div (3 + g mod 8). Such texts join their words by one space. A null id counts as the empty string.
    """
    h = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    marked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), h.alias("h"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    marked = marked.withColumn("words", F.when(F.col("h") % 10 == 0, words))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    marked = marked.withColumn("n", n).withColumn("g", g)
    marked = marked.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    period = F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8))
    marked = marked.withColumn("p", period.cast("int"))
    base = F.slice("words", F.col("a") + 1, F.col("p"))
    loop = F.flatten(F.array_repeat(base, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    looped = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(loop, F.lit(1), F.col("n") - F.col("a")))
    return marked.select("doc_id", F.when(F.col("n") > 0, F.array_join(looped, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Of :func:`periodic_runs`: the number of runs, the one with the greatest length / period, and hashes of all and of the text.

    Fractions are compared exactly, as integers across; ties go to the smallest start, then period.
    """

    def better(x: Column, y: Column) -> Column:
        left, right = x.length * y.period, y.length * x.period
        return F.when(left > right, x).when(left < right, y).when(F.struct(x.start, x.period) <= F.struct(y.start, y.period), x).otherwise(y)

    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    best = F.aggregate("runs", none, lambda acc, x: F.when(acc.isNull(), x).otherwise(better(acc, x)))
    line = lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))
    listed = F.array_join(F.transform("runs", line), "")
    out = found.withColumn("best", best).withColumn("listed", listed)
    milli = F.expr("1000 * best.length div best.period")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
