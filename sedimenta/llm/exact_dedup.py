"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. A sender, a task's rows, hashes its normalised texts into a range of 64 values a row. It splits the range among
   owners and sends each one a sorted, Golomb-coded list of the hashes it has. So there are no more messages than a
   shuffle of as many tasks has blocks.
2. An owner decodes what all senders sent and answers each with a bitmap: which of its hashes occur again anywhere.
3. Only rows whose bit is set, the suspects, are grouped by their whole normalised text, so that a clash of
   fingerprints never joins two texts. Spark combines copies before that shuffle: a text that fills a third of the
   table leaves each task as one row.

Rows that are no suspects are groups of one. A sender turns its answers into one bit a row, and these meet the texts by
a broadcast of measured size: where they are too many for one, in several passes over ranges of senders, each of which
reads only its own row groups. Texts that are no suspects are never shuffled.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import numbered, without, written

#: Rows an owner answers for on average; values of the range for each row; rows of a sender; the largest block of texts.
ROWS_PER_OWNER, RANGE_PER_ROW, SENDER_ROWS = 1_000_000, 64, 1 << 20
BLOCK_ROWS, BLOCK_BYTES = 16_384, 8 << 20
#: Bytes of row bits that one pass broadcasts at most.
PASS_BYTES = 32 << 20


def golomb_encode(values: np.ndarray) -> tuple[bytes, int]:
    """Code the gaps of sorted integers >= 0, with 2**k (k is returned) near their mean as the parameter."""
    if not len(values):
        return b"", 0
    gaps = np.diff(values, prepend=0)
    k = max(0, int(gaps.mean()).bit_length() - 1)
    ones = gaps >> k
    ends = np.cumsum(ones + 1 + k)  # a code is some ones, a zero and k bits
    starts = ends - (ones + 1 + k)
    edges = np.zeros(int(ends[-1]) + 1, np.int32)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + ones, -1)
    bits = np.cumsum(edges[:-1]).astype(np.uint8)
    for j in range(k):
        bits[starts + ones + 1 + j] = (gaps >> (k - 1 - j)) & 1
    return np.packbits(bits).tobytes(), k


def golomb_decode(code: bytes, k: int, n: int) -> np.ndarray:
    """The ``n`` integers that :func:`golomb_encode` was given."""
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    zeros = np.flatnonzero(bits == 0)
    next_zero = zeros[np.minimum(np.searchsorted(zeros, np.arange(len(bits) + 1)), max(len(zeros) - 1, 0))].tolist() if n else []
    stops, at = [0] * n, 0
    for i in range(n):
        stops[i] = stop = next_zero[at]
        at = stop + 1 + k
    stops = np.array(stops, np.int64)
    ones = stops - np.concatenate(([0], stops[:-1] + 1 + k)) if n else stops
    low = bits[(stops + 1)[:, None] + np.arange(k)].astype(np.int64) @ (1 << np.arange(k - 1, -1, -1, dtype=np.int64)) if n and k else 0
    return np.cumsum((ones << k) + low)


def normalised(text: str | None) -> bytes:
    """A-Z lower-cased, UTF-8; null is empty."""
    return text.encode("utf-8", "surrogatepass").lower() if text else b""


STORED = "sender string, block int, ids binary, nulls binary, digests binary, sizes binary, bodies binary, prints binary"


def _stored(batches, sender_rows: int, block_rows: int):
    """Rows into blocks: ids (with a mask of nulls), digests, texts with their lengths. And for each sender a row without
    a block: the first 64 bits of all its digests, with the number of rows of each block as sizes."""
    import pyarrow as pa

    names = [f.split()[0] for f in STORED.split(", ")]
    kinds = [pa.string(), pa.int32(), *[pa.binary()] * 6]
    ids, bodies, total = [], [], 0
    sender, prints = uuid.uuid4().hex, []

    def row(*values):
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)

    def block():
        digests = b"".join(hashlib.sha256(b).digest() for b in bodies)
        prints.append(np.frombuffer(digests, "<u8")[::4])
        whole = np.array([0 if i is None else i for i in ids], np.int64)
        sizes = np.array([len(b) for b in bodies], np.int64)
        return row(sender, len(prints) - 1, whole.tobytes(), np.packbits([i is None for i in ids]).tobytes(), digests, sizes.tobytes(), b"".join(bodies), None)

    def end():
        return row(sender, None, None, None, None, np.array([len(p) for p in prints], np.int64).tobytes(), None, np.concatenate(prints).tobytes())

    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            body = normalised(text)
            if ids and (len(ids) >= block_rows or total + len(body) > BLOCK_BYTES):
                yield block()
                ids, bodies, total = [], [], 0
                if sum(map(len, prints)) >= sender_rows:
                    yield end()
                    sender, prints = uuid.uuid4().hex, []
            ids.append(i)
            bodies.append(body)
            total += len(body)
    if ids:
        yield block()
    if prints:
        yield end()


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. The row with the largest id
    stays. Rows repeated with id and text all count, and where they hold the kept id all of them are marked kept, as
    nothing tells them apart. A null id is below any other: it stays only where a group has no other id. Further
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    stored = written(docs.mapInArrow(lambda batches: _stored(batches, SENDER_ROWS, BLOCK_ROWS), STORED))
    blocks, senders = stored.where("block is not null").drop("prints"), stored.where("block is null").select("sender", "sizes", "prints")
    rows = (senders.agg(F.sum(F.length("prints"))).first()[0] or 0) // 8
    owners = max(1, -(-rows // ROWS_PER_OWNER))
    bits = max(16, (rows * RANGE_PER_ROW).bit_length())
    share = -(-(1 << bits) // owners)

    def in_range(prints: bytes) -> np.ndarray:
        return (np.frombuffer(prints, np.uint64) >> np.uint64(64 - bits)).astype(np.int64)

    def send(frames):
        for f in frames:
            for sender, prints in zip(f["sender"], f["prints"], strict=True):
                values, counts = np.unique(in_range(prints), return_counts=True)
                cuts = np.searchsorted(values, np.arange(owners + 1, dtype=np.int64) * share)
                out = []
                for owner in np.flatnonzero(np.diff(cuts)).tolist():
                    part = slice(cuts[owner], cuts[owner + 1])
                    code, k = golomb_encode(values[part] - owner * share)
                    out.append((owner, sender, code, k, cuts[owner + 1] - cuts[owner], np.packbits(counts[part] > 1).tobytes()))
                yield pd.DataFrame(out, columns=["owner", "sender", "code", "k", "n", "again"])

    def answer(key, group):
        lists = [golomb_decode(c, int(k), int(n)) for c, k, n in zip(group["code"], group["k"], group["n"], strict=True)]
        again = [np.unpackbits(np.frombuffer(a, np.uint8), count=int(n)).astype(bool) for a, n in zip(group["again"], group["n"], strict=True)]
        every = np.concatenate(lists)
        distinct, where, seen = np.unique(every, return_inverse=True, return_counts=True)
        flags = (seen[where] > 1) | np.concatenate(again)
        ends = np.cumsum([len(x) for x in lists])
        return pd.DataFrame({"sender": group["sender"], "owner": key[0], "bitmap": [np.packbits(x).tobytes() for x in np.split(flags, ends[:-1])], "n": group["n"]})

    def tell(frames):
        """Of each sender's answers, one bit for each row, by block."""
        for f in frames:
            for sender, sizes, prints, answers in zip(f["sender"], f["sizes"], f["prints"], f["answers"], strict=True):
                _, where = np.unique(in_range(prints), return_inverse=True)
                parts = sorted(answers, key=lambda x: x["owner"])
                flags = np.concatenate([np.unpackbits(np.frombuffer(p["bitmap"], np.uint8), count=p["n"]) for p in parts])[where]
                cut = np.split(flags, np.cumsum(np.frombuffer(sizes, np.int64))[:-1])
                yield pd.DataFrame({"sender": sender, "block": np.arange(len(cut), dtype=np.int32), "flags": [np.packbits(x).tobytes() for x in cut]})

    def unpack(suspects: bool):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for row in batch.to_pylist():
                    digests = row["digests"]
                    n = len(digests) // 32
                    flags = np.unpackbits(np.frombuffer(row["flags"], np.uint8), count=n).astype(bool)
                    nulls = np.unpackbits(np.frombuffer(row["nulls"], np.uint8), count=n).astype(bool)
                    ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=nulls)
                    at = np.flatnonzero(flags)
                    if suspects:
                        ends = np.cumsum(np.frombuffer(row["sizes"], np.int64))
                        begins, body = ends - np.frombuffer(row["sizes"], np.int64), row["bodies"]
                        for some in np.array_split(at, max(1, len(at) // 2000)):
                            yield pa.RecordBatch.from_arrays(
                                [ids.take(pa.array(some)), pa.array([body[begins[i] : ends[i]] for i in some], pa.binary())], names=["doc_id", "body"]
                            )
                    else:
                        yield pa.RecordBatch.from_arrays(
                            [ids, pa.array([digests[32 * i : 32 * i + 32].hex() for i in range(n)], pa.string()), pa.array(flags)], names=["doc_id", "text_sha256", "suspect"]
                        )

        return run

    sent = senders.mapInPandas(send, "owner int, sender string, code binary, k int, n int, again binary")
    answers = sent.groupBy("owner").applyInPandas(answer, "sender string, owner int, bitmap binary, n int")
    answers = answers.groupBy("sender").agg(F.collect_list(F.struct("owner", "bitmap", "n")).alias("answers"))
    flags = written(senders.join(answers, "sender").mapInPandas(tell, "sender string, block int, flags binary"))
    size = flags.agg(F.sum(F.length("flags") + 64)).first()[0] or 0
    passes = max(1, -(-size // PASS_BYTES))
    bounds = [f"{(i << 32) // passes:08x}" for i in range(passes)]

    def unpacked(suspects: bool, columns: list[str], schema: str) -> DataFrame:
        """Blocks with their rows' bits, unpacked; range after range of senders, so that one broadcast is there at a time."""
        out = None
        for low, high in zip(bounds, [*bounds[1:], "g"], strict=True):
            mine = (F.col("sender") >= low) & (F.col("sender") < high)
            met = blocks.where(mine).join(F.broadcast(flags.where(mine)), ["sender", "block"])  # some PASS_BYTES
            part = met.select(*columns, "flags").mapInArrow(unpack(suspects), schema)
            if passes > 1:
                part = written(part)
            out = part if out is None else out.union(part)
        return out

    groups = (
        unpacked(True, ["ids", "nulls", "digests", "sizes", "bodies"], "doc_id long, body binary")
        .groupBy("body")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select(F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    rows_told = unpacked(False, ["ids", "nulls", "digests"], "doc_id long, text_sha256 string, suspect boolean")
    found = rows_told.where("suspect").join(groups, "text_sha256", "left")
    alone = rows_told.where("not suspect").select("doc_id", "text_sha256", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    out = found.select("doc_id", "text_sha256", "keep_id", "group_size").unionByName(alone)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def without_exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each text that :func:`exact_duplicates` tells apart: the one with the largest id, of rows
    that have it too (repeated rows, null ids) any one. Columns as they are; an empty table gives an empty result.

    Rows are numbered, so that each goes for its own text's sake, whatever its id; texts are not shuffled, but for the
    suspects' in the search itself.
    """
    rows = numbered(docs)
    marks = written(exact_duplicates(rows.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text"))).where("group_size > 1").select(F.col("doc_id").alias("number"), "keep_id"))
    ids = rows.select("number", F.col("row.doc_id").cast("long").alias("id"))
    best = marks.join(ids, "number").groupBy("keep_id").agg(F.max(F.struct("id", "number")).alias("best"))
    return without(rows, marks.select("number").join(best.select("best.number"), "number", "left_anti"))
