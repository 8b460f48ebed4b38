"""Repeated substrings by suffix arrays of shards.

A window is a string of ``length`` bytes within a document. Every byte of a window that also starts elsewhere goes.

1. Each window names an anchor, the least hash among its grams, the first of equals. Equal windows have equal anchors at
   equal places, so windows of different anchors need no comparison. The windows of one anchor start side by side; with
   their bytes they are its context, and one anchor comes about once in two thirds of a window's grams.
2. Anchors are counted; those that occur once have only windows that occur once. Of the others' contexts digests are
   counted: a context that occurs twice is repeated whole, and one whose anchor has no other context needs no more.
3. The rest, different contexts of one anchor, are ranged by anchor and digest into shards of bounded bytes. Each shard
   gets its suffix array by Larsson-Sadakane refinement and common prefixes by Kasai's rule; suffixes side by side that
   agree over ``length`` bytes are equal windows.
4. Only a shard's first and last anchor may go on in other shards: a passage in a third of all documents has as many
   contexts at its edges and fills many shards. Each shard sends sorted digests of their windows to owners of ranges of
   digests, who merge the lists by binary search and answer with a bit for each: does another shard have it?
5. What repeats is told by document shard as spans of bytes, and these meet the texts.

Texts stay in the table that step 1 writes, in blocks. What they meet is broadcast where its measured size allows, and
joined by block otherwise. Digests are of 128 bits (BLAKE2b) where they stand for a text, of 64 bits where they only
say what is compared.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import written

#: Bytes of texts in a block (a longer text is one by itself), places hashed at once, bytes of a shard of contexts at most.
BLOCK_BYTES, PIECE, SHARD_BYTES = 4 << 20, 1 << 18, (1 << 21) - 1
#: Bytes broadcast at most, bytes of contexts of a task, digests an owner merges on average.
BROADCAST_BYTES, TASK_BYTES, OWNER_DIGESTS = 32 << 20, 8 << 20, 1_000_000
_PLACE = np.int64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15

BLOCK = "block string, ids binary, nulls binary, sizes binary, body binary, firsts binary, lasts binary, hashes binary"


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of bytes, and powers of an odd base and of its inverse modulo 2**64."""
    n = 2 * PIECE + 2
    inverse = pow(_BASE, -1, 1 << 64)

    def powers(base: int) -> np.ndarray:
        factors = np.full(n, base, np.uint64)
        factors[0] = 1
        return factors.cumprod(dtype=np.uint64)

    return np.random.default_rng(20).integers(1, 1 << 63, 256).astype(np.uint64), powers(_BASE), powers(inverse)


def _gram_hashes(t: np.ndarray, gram: int) -> np.ndarray:
    values, powers, inverses = _tables()
    n = len(t)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[t] * powers[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * inverses[: n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _sliding_least(a: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values side by side."""
    n = len(a)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.int64).max)
    padded[:n] = a
    table = padded.reshape(rows, width)
    before = np.minimum.accumulate(table, axis=1).ravel()
    after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def anchors(t: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start of each anchor of some texts side by side, and the anchor's hash."""
    width = length - gram + 1
    sizes = np.diff(ends, prepend=0)
    edges = np.zeros(len(t) + 1, np.int8)
    long = sizes >= length
    edges[(ends - sizes)[long]] += 1
    edges[(ends - length + 1)[long]] -= 1
    valid = np.cumsum(edges[:-1]).astype(bool)
    found = []
    step = max(PIECE, 4 * length)
    for begin in range(0, max(0, len(t) - length + 1), step):
        ok = valid[begin : begin + step]
        if not ok.any():
            continue
        part = t[begin : begin + step + length - 1]
        h = _gram_hashes(part, gram)
        key = (h >> np.uint64(1)).astype(np.int64) & ~_PLACE | np.arange(len(h))
        place = _sliding_least(key, width) & _PLACE
        ok = ok[: len(place)]
        new = np.ones(len(place), bool)
        new[1:] = place[1:] != place[:-1]
        starts = np.flatnonzero(ok & (new | ~np.concatenate(([False], ok[:-1]))))
        stops = np.flatnonzero(ok & (np.concatenate((new[1:], [True])) | ~np.concatenate((ok[1:], [False]))))
        found.append((starts + begin, stops + begin, place[starts] + begin, h[place[starts]]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    firsts, lasts, places, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = np.ones(len(firsts), bool)  # an anchor on both sides of a piece's border is one
    keep[1:] = (places[1:] != places[:-1]) | (lasts[:-1] + 1 != firsts[1:])
    at = np.flatnonzero(keep)
    return firsts[at], lasts[np.append(at[1:], len(firsts)) - 1], hashes[at].astype(np.int64)


def _words(t: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on as one number; beyond the end are zeros, and ``t`` holds none."""
    padded = np.concatenate((t, np.zeros(8, np.uint8)))
    out = np.zeros(len(t) + 1, np.uint64)
    for j in range(8):
        out <<= np.uint64(8)
        out |= padded[j : j + len(t) + 1]
    return out


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffixes of less than 2**21 bytes in order, by Larsson-Sadakane refinement.

    Suffixes are sorted by their first letters; then those that are still in a group with others are sorted within it by
    the group of the suffix that far behind, and the distance doubles. One number holds both groups and the place, so
    that whole numbers are sorted and nothing is looked up.
    """
    n, bits = len(t), 21
    if n >= 1 << bits:
        raise ValueError("too many bytes for one shard")
    if not n:
        return np.empty(0, np.int64)
    used = np.zeros(256, np.int64)
    used[t] = 1
    letters = np.cumsum(used)  # from 1; 0 is the end
    size = int(letters[-1]).bit_length()
    h = (63 - bits) // size
    padded = np.concatenate((letters[t], np.zeros(h, np.int64)))
    key = np.zeros(n, np.int64)
    for j in range(h):
        key = key << size | padded[j : j + n]
    mask = (1 << bits) - 1
    key = np.sort(key << bits | np.arange(n))
    order, key = key & mask, key >> bits
    new = np.concatenate(([True], key[1:] != key[:-1]))
    rank = np.empty(n + 1, np.int64)
    rank[n] = 0
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a group's number is the place of its first
    rank[order] = group
    while True:
        alone = new & np.concatenate((new[1:], [True]))
        at = np.flatnonzero(~alone)
        if not len(at):
            return order
        some = order[at]
        behind = np.where(some + h < n, rank[np.minimum(some + h, n)] + 1, 0)
        key = np.sort(rank[some] << 2 * bits | behind << bits | some)
        some = key & mask
        order[at] = some
        fresh = np.concatenate(([True], key[1:] >> bits != key[:-1] >> bits))
        new[at[fresh]] = True
        group[at] = np.maximum.accumulate(np.where(fresh, at, 0))
        rank[some] = group[at]
        h *= 2


def common_prefixes(t: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many bytes each suffix shares with the one before it in order, by Kasai's rule.

    Where the letters before two neighbours are equal, so are the pair's suffixes from there, and the suffix shares one
    byte less than the one that starts a place earlier. Only the others are compared, eight bytes at a time.
    """
    n = len(t)
    shared = np.zeros(n, np.int64)
    if n < 2:
        return shared
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    follows = (place > 0) & (before > 0) & (t[place - 1] == t[before - 1])
    words = _words(t + np.uint8(1))
    first = np.flatnonzero(~follows)
    active = first[before[first] >= 0]
    a, b = active.copy(), before[active]
    while len(active):
        differ = words[a] ^ words[b]
        going = differ == 0
        x = differ[~going]
        extra = np.zeros(len(x), np.int64)
        for j in range(1, 8):
            extra += x >> np.uint64(64 - 8 * j) == 0
        shared[active[~going]] = a[~going] - active[~going] + extra
        active, a, b = active[going], a[going] + 8, b[going] + 8
    start = np.maximum.accumulate(np.where(follows, 0, place))
    by_place = np.where(follows, shared[start] - (place - start), shared)
    return by_place[order]


def equal_windows(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts side by side: which places start a window, the class of equal suffixes of each place, and whether a
    window starts at another place too."""
    t = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts], np.int64)
    ends = np.cumsum(sizes)
    valid = np.zeros(len(t), bool)
    for begin, end in zip((ends - sizes).tolist(), (ends - length + 1).tolist(), strict=True):
        valid[begin:end] = True
    order = suffix_array(t)
    classes = np.empty(len(t), np.int64)
    classes[order] = np.cumsum(common_prefixes(t, order) < length)
    counts = np.bincount(classes[valid], minlength=len(t) + 1)
    return valid, classes, valid & (counts[classes] > 1)


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _blocks(batches, length: int, gram: int):
    import pyarrow as pa

    names = [c.split()[0] for c in BLOCK.split(", ")]
    kinds = [pa.string(), *[pa.binary()] * 7]

    def row(ids, bodies):
        body = b"".join(bodies)
        sizes = np.array([len(b) for b in bodies], np.int64)
        firsts, lasts, hashes = anchors(np.frombuffer(body, np.uint8), np.cumsum(sizes), length, gram)
        whole = np.array([0 if i is None else i for i in ids], np.int64)
        values = [uuid.uuid4().hex, whole.tobytes(), np.packbits([i is None for i in ids]).tobytes(), sizes.tobytes(), body, firsts.tobytes(), lasts.tobytes(), hashes.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)

    ids, bodies, total = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            body = text.encode("utf-8", "surrogatepass") if text else b""
            if ids and total + len(body) > BLOCK_BYTES:
                yield row(ids, bodies)
                ids, bodies, total = [], [], 0
            ids.append(i)
            bodies.append(body)
            total += len(body)
    if ids:
        yield row(ids, bodies)


def _met(blocks: DataFrame, told: DataFrame, size: int, how: str = "inner") -> DataFrame:
    """Blocks with what is told to them; texts are shuffled only where that is too much for a broadcast."""
    return blocks.join(F.broadcast(told) if size <= BROADCAST_BYTES else told, "block", how)


def _long(raw) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def _anchor_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for block, raw in zip(f["block"], f["hashes"], strict=True):
            values, counts = np.unique(_long(raw), return_counts=True)
            yield pd.DataFrame({"anchor": values, "block": block, "number": np.arange(len(values)), "again": counts > 1})


def _bits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for numbers in f["numbers"]:
            flags = np.zeros(max(numbers) + 1, bool)
            flags[np.asarray(numbers)] = True
            out.append(np.packbits(flags).tobytes())
        yield pd.DataFrame({"block": f["block"], "bits": out})


def _contexts(length: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for block, body, firsts, lasts, hashes, bits in zip(f["block"], f["body"], f["firsts"], f["lasts"], f["hashes"], f["bits"], strict=True):
                firsts, lasts, hashes = _long(firsts), _long(lasts), _long(hashes)
                values, where = np.unique(hashes, return_inverse=True)
                flags = np.zeros(len(values), bool)
                told = np.unpackbits(np.frombuffer(bits, np.uint8))[: len(values)].astype(bool)
                flags[: len(told)] = told
                at = np.flatnonzero(flags[where])
                held: dict[tuple[int, bytes], list[int]] = {}
                for i, first, last, anchor in zip(at.tolist(), firsts[at].tolist(), lasts[at].tolist(), hashes[at].tolist(), strict=True):
                    held.setdefault((anchor, hashlib.blake2b(body[first : last + length], digest_size=16).digest()), []).append(i)
                if held:
                    yield pd.DataFrame({"anchor": [k[0] for k in held], "digest": [k[1] for k in held], "block": block, "at": list(held.values())})

    return run


def _asked(length: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                firsts, lasts, hashes = _long(r["firsts"]), _long(r["lasts"]), _long(r["hashes"])
                for i in range(0, len(r["asked"]), 8192):
                    some = r["asked"][i : i + 8192]
                    at = [x["at"] for x in some]
                    texts = [r["body"][a : b + length] for a, b in zip(firsts[at].tolist(), lasts[at].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(hashes[at]), pa.array([x["digest"] for x in some], pa.binary()), pa.array(texts, pa.binary())], names=["anchor", "digest", "context"]
                    )

    return run


SHARD = "anchor long, digest binary, windows binary, shard string, number int, prints binary, refs binary"


def _sharded(length: int):
    """Shards of contexts in order: a row for each context with its repeated windows, and for each shard a row with the
    sorted digests of the windows of its first and last anchor, where each is found, and if it stands alone in the shard."""

    def rows(held):
        valid, classes, again = equal_windows([h[2] for h in held], length)
        shard = uuid.uuid4().hex
        text = b"".join(h[2] for h in held)
        prints, refs, begin = [], [], 0
        told: set[int] = set()
        edge = {held[0][0], held[-1][0]}
        for number, (anchor, digest, context) in enumerate(held):
            end = begin + len(context)
            windows = len(context) - length + 1
            yield anchor, digest, np.packbits(again[begin : begin + windows]).tobytes(), shard, number, None, None
            if anchor in edge:
                for j, c in enumerate(classes[begin : begin + windows].tolist()):
                    if c not in told:
                        told.add(c)
                        prints.append(hashlib.blake2b(text[begin + j : begin + j + length], digest_size=16).digest())
                        refs.append((number, j))
            begin = end
        order = sorted(range(len(prints)), key=prints.__getitem__)
        yield None, None, None, shard, None, b"".join(prints[i] for i in order), np.array([refs[i] for i in order], np.int64).tobytes()

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.int32(), pa.binary(), pa.binary()]
        names = [c.split()[0] for c in SHARD.split(", ")]
        batch_of = lambda found: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)
        held, total = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held and total + len(row[2]) > SHARD_BYTES:
                    yield batch_of(list(rows(held)))
                    held, total = [], 0
                held.append(row)
                total += len(row[2])
        if held:
            yield batch_of(list(rows(held)))

    return run


def _shared(lists: DataFrame) -> DataFrame:
    """shard, number and places of the windows that another shard has too: sorted lists, cut and merged by binary search."""
    total = (lists.agg(F.sum(F.octet_length("prints"))).first()[0] or 0) // 16
    owners = max(1, -(-total // OWNER_DIGESTS))
    cuts = np.array([((i << 64) // owners).to_bytes(8, "big") for i in range(1, owners)], "S16")

    def send(frames):
        for f in frames:
            for shard, raw in zip(f["shard"], f["prints"], strict=True):
                digests = np.frombuffer(raw, "S16")
                at = np.concatenate(([0], np.searchsorted(digests, cuts) if len(cuts) else [], [len(digests)])).astype(int)
                mine = np.flatnonzero(np.diff(at))
                yield pd.DataFrame({"owner": mine, "shard": shard, "begin": at[mine], "prints": [raw[16 * at[o] : 16 * at[o + 1]] for o in mine]})

    def merge(key, group):
        found = [np.frombuffer(p, "S16") for p in group["prints"]]
        merged = np.sort(np.concatenate(found))
        answers = [np.packbits(np.searchsorted(merged, x, "right") - np.searchsorted(merged, x) > 1).tobytes() for x in found]
        return pd.DataFrame({"shard": group["shard"], "begin": group["begin"], "n": [len(x) for x in found], "bits": answers})

    def tell(frames):
        for f in frames:
            for shard, raw, answers in zip(f["shard"], f["refs"], f["answers"], strict=True):
                flags = np.zeros(len(raw) // 16, bool)
                for a in answers:
                    flags[a["begin"] : a["begin"] + a["n"]] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=a["n"])
                refs = _long(raw).reshape(-1, 2)[flags]
                refs = refs[np.lexsort((refs[:, 1], refs[:, 0]))]
                numbers, starts = np.unique(refs[:, 0], return_index=True)
                if len(numbers):
                    yield pd.DataFrame({"shard": shard, "number": numbers.astype(np.int32), "places": [x.tolist() for x in np.split(refs[:, 1], starts[1:])]})

    sent = lists.select("shard", "prints").mapInPandas(send, "owner int, shard string, begin int, prints binary")
    answers = sent.groupBy("owner").applyInPandas(merge, "shard string, begin int, n int, bits binary")
    answers = answers.groupBy("shard").agg(F.collect_list(F.struct("begin", "n", "bits")).alias("answers"))
    return lists.select("shard", "refs").join(answers, "shard").mapInPandas(tell, "shard string, number int, places array<int>")


def _spans_of_contexts(length: int):
    def run(frames):
        for f in frames:
            out = []
            for raw, places in zip(f["windows"], f["places"], strict=True):
                flags = np.unpackbits(np.frombuffer(raw, np.uint8)).astype(bool)
                if places is not None:
                    flags[np.asarray(places)] = True
                out.append([x for begin, end in _runs(flags) for x in (begin, end - 1 + length)])
            if out:
                yield pd.DataFrame({"anchor": f["anchor"], "digest": f["digest"], "spans": out})

    return run


def _spans_of_blocks(length: int):
    """What goes of each block, in places of the block; spans may meet and cross."""

    def run(frames):
        for f in frames:
            out = []
            for firsts, lasts, told in zip(f["firsts"], f["lasts"], f["told"], strict=True):
                firsts, lasts = _long(firsts), _long(lasts)
                whole = np.array([i for x in told if x["spans"] is None for i in x["at"]], np.int64)
                begins, ends = [firsts[whole]], [lasts[whole] + length]
                for x in told:
                    if x["spans"] is not None:
                        for i in x["at"]:
                            part = np.asarray(x["spans"], np.int64).reshape(-1, 2) + firsts[i]
                            begins.append(part[:, 0])
                            ends.append(part[:, 1])
                begin, end = np.concatenate(begins), np.concatenate(ends)
                order = np.argsort(begin, kind="stable")
                begin, end = begin[order], np.maximum.accumulate(end[order])
                new = np.concatenate(([True], begin[1:] > end[:-1]))
                last = np.append(np.flatnonzero(new)[1:], len(begin)) - 1
                out.append(np.column_stack((begin[new], end[last])).astype(np.int64).tobytes())
            yield pd.DataFrame({"block": f["block"], "spans": out})

    return run


def _kept(batches):
    import pyarrow as pa

    for batch in batches:
        for k in range(batch.num_rows):
            r = batch.slice(k, 1).to_pylist()[0]
            body, sizes = r["body"], _long(r["sizes"])
            edges = np.zeros(len(body) + 1, np.int32)
            if r["spans"] is not None:
                spans = _long(r["spans"]).reshape(-1, 2)
                np.add.at(edges, spans[:, 0], 1)
                np.add.at(edges, spans[:, 1], -1)
            gone = np.cumsum(edges[:-1]) > 0
            letters = np.frombuffer(body, np.uint8)
            ends = np.cumsum(sizes)
            removed, spans, kept = [], [], []
            for begin, end in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
                mine = gone[begin:end]
                n = int(mine.sum())
                removed.append(n)
                spans.append(len(_runs(mine)) if n else 0)
                kept.append(letters[begin:end][~mine].tobytes() if n else body[begin:end])
            nulls = np.unpackbits(np.frombuffer(r["nulls"], np.uint8), count=len(sizes)).astype(bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_long(r["ids"]), mask=nulls), pa.array(sizes), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )


def repeated_substrings(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept, the bytes that stay, of each row of ``docs``.

    Texts are UTF-8 bytes, a null text none. A byte goes if some ``length`` bytes of its text that hold it also start
    anywhere else, in this text or another; overlaps count, matches never cross texts, and all is judged on the texts
    as they are given. Spans are maximal stretches of bytes that go. What stays may begin or end within a letter.
    Repeated rows are each other's copies; a null id gives a row as any other. Further columns are ignored, whatever
    their names; an empty table gives an empty result. ``length`` is from 16 to 100 000.
    """
    if not 16 <= length <= 100_000:
        raise ValueError("length must be from 16 to 100 000")
    gram = max(8, length // 4)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = written(given.mapInArrow(lambda batches: _blocks(batches, length, gram), BLOCK))
    where = blocks.select("block", "firsts", "lasts", "hashes", "body")
    size_of = lambda df, column: df.agg(F.sum(column)).first()[0] or 0

    counts = written(blocks.select("block", "hashes").mapInPandas(_anchor_counts, "anchor long, block string, number int, again boolean"))
    again = counts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again")).where("n > 1 or again").select("anchor")
    bits = counts.join(again, "anchor").groupBy("block").agg(F.collect_list("number").alias("numbers")).mapInPandas(_bits, "block string, bits binary")
    bits = written(bits)
    met = _met(where, bits, size_of(bits, F.octet_length("bits") + 64))
    contexts = written(met.mapInPandas(_contexts(length), "anchor long, digest binary, block string, at array<int>"))

    first = F.min(F.struct("block", F.col("at")[0].alias("at")))
    distinct = written(contexts.groupBy("anchor", "digest").agg(F.sum(F.size("at")).alias("n"), first.alias("held")))
    several = distinct.groupBy("anchor").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where("least < most").select("anchor")
    asked = distinct.join(several, "anchor", "left_semi").groupBy(F.col("held.block").alias("block")).agg(F.collect_list(F.struct(F.col("held.at").alias("at"), "digest")).alias("asked"))
    asked = written(asked)
    met = _met(where, asked, size_of(asked, F.size("asked") * 32 + 64))
    texts = written(met.mapInArrow(_asked(length), "anchor long, digest binary, context binary"))
    tasks = max(1, -(-size_of(texts, F.octet_length("context")) // TASK_BYTES))
    ranged = texts.repartitionByRange(tasks, "anchor", "digest").sortWithinPartitions("anchor", "digest")
    shards = written(ranged.mapInArrow(_sharded(length), SHARD))

    elsewhere = _shared(shards.where("prints is not null"))
    found = shards.where("windows is not null").select("anchor", "digest", "windows", "shard", "number").join(elsewhere, ["shard", "number"], "left")
    spans = found.mapInPandas(_spans_of_contexts(length), "anchor long, digest binary, spans array<int>").where(F.size("spans") > 0)
    told = distinct.join(spans, ["anchor", "digest"], "left").where("n > 1 or spans is not null")
    told = told.select("anchor", "digest", F.when(F.col("n") == 1, F.col("spans")).alias("spans"))
    of_block = contexts.join(told, ["anchor", "digest"]).groupBy("block").agg(F.collect_list(F.struct("at", "spans")).alias("told"))
    gone = blocks.select("block", "firsts", "lasts").join(of_block, "block").mapInPandas(_spans_of_blocks(length), "block string, spans binary")
    gone = written(gone)
    met = _met(blocks.select("block", "ids", "nulls", "sizes", "body"), gone, size_of(gone, F.octet_length("spans") + 64), "left")
    return met.mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
