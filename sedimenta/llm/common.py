"""What the operators of this subpackage share: table access, lineage cuts, ASCII words, held-out folds."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.sources.shared import shared_dir, written

__all__ = ["WORD_PATTERN", "ascii_words", "fold", "fold_column", "numbered", "shared_dir", "table", "without", "written"]

#: A word is a run of anything but space and the five ASCII controls from tab to carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that one row of bits answers for, and bytes of such rows that one pass broadcasts at most.
CHUNK_ROWS, PASS_BYTES = 1 << 16, 32 << 20


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` written as ``row``, with a ``number`` that tells each row from any other, repeated ones too."""
    return written(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("number")))


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of a numbered table (row, number and more) but those whose number is in ``gone``.

    What goes is told by one bit a row, broadcast to where rows are read: rows are never shuffled. Where the bits are
    too many for one broadcast, which their measured size shows, rows are read in several passes over ranges of numbers.
    """
    chunk, bits = F.floor(F.col("number") / CHUNK_ROWS).cast("long"), F.pmod("number", F.lit(CHUNK_ROWS))
    word, bit = F.floor(bits / 64).cast("int"), F.pmod(bits, F.lit(64)).cast("int")
    of_word = gone.groupBy(chunk.alias("chunk"), word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    lookup = F.map_from_entries(F.collect_list(F.struct("word", "bits")))
    words = of_word.groupBy("chunk").agg(lookup.alias("w")).select("chunk", F.transform(F.sequence(F.lit(0), F.lit(CHUNK_ROWS // 64 - 1)), lambda i: F.coalesce(F.try_element_at("w", i), F.lit(0).cast("long"))).alias("words"))
    words = written(words)
    passes = max(1, -(-words.count() * (CHUNK_ROWS // 8) // PASS_BYTES))
    cuts = words.agg(F.percentile_approx("chunk", F.array(*[F.lit(i / passes) for i in range(1, passes)]))).first()[0] if passes > 1 else []
    out = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        mine = rows
        if low is not None:
            mine, words_here = mine.where(F.col("number") >= low * CHUNK_ROWS), words.where(F.col("chunk") >= low)
        else:
            words_here = words
        if high is not None:
            mine, words_here = mine.where(F.col("number") < high * CHUNK_ROWS), words_here.where(F.col("chunk") < high)
        met = mine.withColumn("chunk", chunk).join(F.broadcast(words_here), "chunk", "left")  # some PASS_BYTES
        dropped = F.getbit(F.get("words", word), bit) == 1
        part = met.where(~F.coalesce(dropped, F.lit(False))).select("row.*")
        if passes > 1:
            part = written(part)
        out = part if out is None else out.union(part)
    return out


def ascii_words(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, as UTF-8. ``bytes`` methods know ASCII only, as wanted here."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def fold(doc_id: int | None, folds: int = 5) -> int:
    """crc32 of the id in decimal, by which rows are held out. A null id counts as the empty string."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def fold_column(column: str, folds: int = 5):
    """``fold`` as a Column."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds
