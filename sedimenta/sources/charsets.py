"""The character set of bytes by likelihood: how often one byte follows another in texts written in each, from a corpus.

Counts are of pairs of bytes of which one is beyond ASCII, which is where sets of one family differ, and of plain pairs, which
tell apart families. A text's likelihood under a set is the sum over its pairs; sets in which it cannot be read at all
are out. The surest wins if its share of the likelihood of all reaches a floor, else nothing is decided.
"""

from __future__ import annotations

import codecs

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.sources.files import encoding_of

#: Share of the likelihood from which on a set is taken; bytes of a text that are judged at once.
FLOOR, PIECE = 0.99, 1 << 20


def _pairs(content: bytes) -> np.ndarray:
    """Counts of pairs of bytes."""
    b = np.frombuffer(content, np.uint8).astype(np.int64)
    out = np.zeros(1 << 16, np.int64)
    for a in range(0, max(0, len(b) - 1), PIECE):
        part = b[a : a + PIECE + 1]
        out += np.bincount(part[:-1] << 8 | part[1:], minlength=1 << 16)
    return out


def _readable(content: bytes, charset: str) -> bool:
    try:
        codecs.decode(content, charset)
    except (UnicodeDecodeError, LookupError):
        return False
    return True


def fit_charsets(texts: DataFrame, text: str, charsets: list[str]) -> dict[str, np.ndarray]:
    """Log shares of pairs of bytes for each set, from all texts that it can write; counts meet as one row a task and set. A
    set is a table of 65 536 numbers, whatever the corpus."""
    for c in charsets:
        codecs.lookup(c)

    def count(frames):
        totals = {c: np.zeros(1 << 16, np.int64) for c in charsets}
        for f in frames:
            for t in f["t"].dropna():
                for c in charsets:
                    try:
                        totals[c] += _pairs(t.encode(c))
                    except UnicodeEncodeError:
                        continue
        for c, n in totals.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"charset": c, "pair": at, "n": n[at]})

    counted = texts.select(F.col(text).alias("t")).mapInPandas(count, "charset string, pair long, n long").groupBy("charset", "pair").agg(F.sum("n").alias("n"))
    whole = {c: np.zeros(1 << 16) for c in charsets}
    for r in counted.toLocalIterator():  # 65 536 rows a set at most
        whole[r["charset"]][r["pair"]] = r["n"]
    return {c: np.log((n + 0.01) / (n.sum() + 0.01 * len(n))) for c, n in whole.items()}


def charset_of(content: Column, fitted: dict[str, np.ndarray], floor: float = FLOOR) -> Column:
    """struct(encoding, confidence) of bytes: by their mark, else utf-8 where they are valid and not plain zeros, else the set of
    the greatest likelihood, null if its share is under ``floor``. Empty bytes are utf-8, null bytes nothing."""
    names = sorted(fitted)
    tables = np.stack([fitted[c] for c in names])

    @F.pandas_udf(T.StructType([T.StructField("encoding", T.StringType()), T.StructField("confidence", T.DoubleType())]))
    def likeliest(contents: pd.Series) -> pd.DataFrame:
        out = []
        for content in contents:
            able = [i for i, c in enumerate(names) if content is not None and _readable(content, c)]
            if not able:
                out.append((None, None))
                continue
            n = _pairs(content)
            at = np.flatnonzero(n)
            logs = tables[able][:, at] @ n[at]
            shares = np.exp(logs - logs.max())
            share = float(1 / shares.sum())
            out.append((names[able[int(logs.argmax())]] if share >= floor else None, share))
        return pd.DataFrame(out, columns=["encoding", "confidence"])

    known = encoding_of(content)
    guess = likeliest(F.when(known.isNull(), content))
    return F.struct(F.coalesce(known, guess["encoding"]).alias("encoding"), F.when(known.isNotNull(), 1.0).otherwise(guess["confidence"]).alias("confidence"))
