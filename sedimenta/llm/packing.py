"""Packing documents into token sequences by linear grouping.

What a packing decides depends on lengths alone, and there are at most ``capacity`` of them. So the plan is made from
the histogram of piece lengths, whose size is fixed whatever the corpus: large lengths are cut into groups of equal
cardinality and rounded up to the largest of their group; configurations of the few rounded sizes are optimised by
column generation (the linear relaxation of bin packing over patterns); actual lengths, largest first, take the
places of the rounded ones; small lengths then go, largest first, into the fullest sequence that holds them.

Documents are dealt to the plan's places by their rank among the pieces of their length. Pieces are kept in blocks, each
with its histogram; where a block's ranks start is the sum of the histograms before it. So only histograms, one for some
ten thousand pieces, ever meet: a length that a third of all pieces has is no hot group.
"""

from __future__ import annotations

import uuid
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import written

CAPACITY, END_ID = 1024, 2
#: Lengths over this share of the capacity are large; groups of equal cardinality that they are cut into.
LARGE_SHARE, GROUPS = 1 / 16, 128
VOCABULARY = "byte_bpe_50k.json"
#: Pieces of a block, beyond which the next document starts another; parts that blocks are dealt to for sums before them.
BLOCK_PIECES, PARTS = 1 << 15, 256

_ENCODERS: dict = {}


def encoder(vocabulary: str):
    """text -> uint32 ids of a byte-level BPE of ``tokenizers``, special strings in a text being single tokens.

    ``tiktoken`` gives the same ids from the same ranks about four times as fast; a test holds the two together. What
    its regular expression cannot take (very long runs of white space) goes to ``tokenizers``.
    """
    if vocabulary not in _ENCODERS:
        import json

        import public_tokenizers as P
        import tiktoken
        from tokenizers import Tokenizer

        path = vocabulary if "/" in vocabulary else P.path(vocabulary)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # the 256 bytes as the printable characters that stand for them in the file: a fixed rule of byte-level BPE
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        to_byte = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in kept)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(to_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        fast = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        slow = Tokenizer.from_file(path)

        def encode(text: str) -> np.ndarray:
            if not text:
                return np.empty(0, np.uint32)
            try:
                return fast.encode_to_numpy(text, allowed_special="all")
            except BaseException as e:  # a panic of the regular expression is no Exception
                if type(e).__name__ != "PanicException" and not isinstance(e, ValueError):
                    raise
                return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

        _ENCODERS[vocabulary] = encode
    return _ENCODERS[vocabulary]


# ---- the plan: histogram of lengths -> groups of equal sequences


def _pattern(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """The multiset of ``sizes`` within the capacity that is worth most: an unbounded knapsack."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        k = int(np.searchsorted(sizes, c, "right"))
        worth = best[c - sizes[:k]] + prices[:k]
        j = int(worth.argmax())
        if worth[j] > best[c - 1] + 1e-12:
            best[c], last[c] = worth[j], j
        else:
            best[c] = best[c - 1]
    out, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if last[c] < 0 or best[c] == best[c - 1]:
            c -= 1
        else:
            out[last[c]] += 1
            c -= int(sizes[last[c]])
    return out


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """By elimination with row pivots. Plain array arithmetic: a driver that has started other processes must not enter
    the threads of a linear-algebra library, which may wait for ever there."""
    n = len(matrix)
    both = np.hstack((matrix.astype(float), np.eye(n)))
    for i in range(n):
        pivot = i + int(np.abs(both[i:, i]).argmax())
        both[[i, pivot]] = both[[pivot, i]]
        both[i] /= both[i, i]
        rest = both[:, i].copy()
        rest[i] = 0
        both -= rest[:, None] * both[i]
    return both[:, n:]


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 1000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often to use each, from column generation; ``sizes`` ascend and are few."""
    n = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(basis))
    for round_no in range(rounds):
        if round_no % 128 == 127:
            inverse = _inverse(basis)  # updates add up errors
        prices = np.maximum(inverse.sum(axis=0), 0)  # each pattern costs 1
        new = _pattern(sizes, prices, capacity)
        if (prices * new).sum() <= 1 + 5e-4:  # within 0.05 % of the relaxation's optimum
            break
        amount, step = (inverse * demand).sum(axis=1), (inverse * new).sum(axis=1)
        ratio = np.where(step > 1e-9, np.maximum(amount, 0) / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = new
        row = inverse[out] / step[out]
        inverse -= step[:, None] * row
        inverse[out] = row
    amount = np.maximum((_inverse(basis) * demand).sum(axis=1), 0)
    return [(basis[:, j].astype(np.int64), float(amount[j])) for j in range(n)]


class _Runs:
    """Lengths of a group, largest first, as runs (length, count)."""

    def __init__(self, runs):
        self.runs = [list(r) for r in runs if r[1]]

    def left(self) -> int:
        return sum(n for _, n in self.runs)


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths in one sequence, number of such sequences)] that take every piece of ``histogram`` once."""
    large = sorted((l for l, n in histogram.items() if n and l > capacity * LARGE_SHARE), reverse=True)
    small = {l: n for l, n in histogram.items() if n and l <= capacity * LARGE_SHARE}
    bins: dict[tuple[int, ...], int] = defaultdict(int)

    groups: list[list[list[int]]] = []  # linear grouping: equal numbers of pieces, largest lengths first
    share = max(1, -(-sum(histogram[l] for l in large) // GROUPS))
    room = 0
    for l in large:
        n = histogram[l]
        while n:
            if not room:
                groups.append([])
                room = share
            some = min(n, room)
            groups[-1].append([l, some])
            n, room = n - some, room - some
    merged: dict[int, _Runs] = {}
    for g in groups:  # groups that round up to the same size are one
        top = g[0][0]
        merged.setdefault(top, _Runs([])).runs.extend(g)
    sizes = np.array(sorted(merged), np.int64)
    if len(sizes):
        demand = np.array([merged[int(s)].left() for s in sizes], float)
        for pattern, times in sorted(configurations(sizes, demand, capacity), key=lambda x: -x[1]):
            slots = [int(s) for s, q in zip(sizes[::-1], pattern[::-1], strict=True) for _ in range(int(q))]
            _fill(bins, merged, slots, int(times + 1e-9))
    left: dict[int, int] = defaultdict(int)
    for runs in merged.values():
        for l, n in runs.runs:
            left[l] += n
    for l, n in small.items():
        left[l] += n
    return _best_fit(bins, left, capacity)


def _fill(bins, merged, slots: list[int], times: int) -> None:
    """Use a pattern ``times`` times, actual lengths in the places of rounded ones; split where a run ends."""
    while times > 0 and slots:
        taken: dict[int, int] = defaultdict(int)
        for s in slots:
            taken[s] += 1
        here, n = [], times
        for s, q in taken.items():
            runs = merged[s].runs
            if merged[s].left() < q:
                return
            if runs[0][1] >= q:
                here += [(s, runs[0][0], q)]
                n = min(n, runs[0][1] // q)
            else:  # the places of one sequence span runs
                n, need = 1, q
                for l, have in runs:
                    some = min(have, need)
                    here.append((s, l, some))
                    need -= some
                    if not need:
                        break
        for s, l, q in here:
            runs = merged[s].runs
            i = next(i for i, r in enumerate(runs) if r[0] == l)
            runs[i][1] -= q * n
            if not runs[i][1]:
                runs.pop(i)
        bins[tuple(sorted((l for _, l, q in here for _ in range(q)), reverse=True))] += n
        times -= n


def _best_fit(bins, left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, largest first, of lengths ``left`` into equal sequences taken together."""
    by_room: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    for content, n in bins.items():
        room = by_room[capacity - sum(content)]
        room[content] = room.get(content, 0) + n
    for l in sorted(left, reverse=True):
        n = left[l]
        while n:
            room = next((r for r in range(l, capacity) if by_room[r]), capacity)
            content, times = by_room[room].popitem() if by_room[room] else ((), n)
            fit = min(room // l, n)
            used = min(times, max(1, n // fit))
            if times > used and content:
                by_room[room][content] = times - used
            new = content + (l,) * fit
            rest = by_room[room - l * fit]
            rest[new] = rest.get(new, 0) + used
            n -= used * fit
    return [(content, n) for room in by_room for content, n in room.items() if content]


def slots_of(plan: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Places by length: pieces of rank first .. first + n * q - 1 go to sequence base + (rank - first) // q at
    offset + (rank - first) % q * length."""
    out, seen, base = [], defaultdict(int), 0
    for content, n in plan:
        offset, i = 0, 0
        while i < len(content):
            l, q = content[i], 1
            while i + q < len(content) and content[i + q] == l:
                q += 1
            out.append((l, seen[l], n * q, q, base, offset))
            seen[l] += n * q
            offset += l * q
            i += q
        base += n
    return pd.DataFrame(out, columns=["length", "first", "n", "q", "base", "offset"]).sort_values(["length", "first"], ignore_index=True)


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents and their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and ``end_id``; a null or empty text is ``end_id`` alone. Only documents longer than the
    capacity are cut, into full pieces and, first, what is over. Sequences are numbered from 0, those of the plan
    first; a full piece is a sequence of its own. Repeated rows and null ids are documents like any others; further
    columns are ignored; an empty table gives an empty result.
    """

    def tokenise(batches):
        encode = encoder(vocabulary)
        rows: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or min(capacity, len(ids))
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                rows += [(doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())) for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                if len(rows) >= BLOCK_PIECES:
                    yield _block(rows, capacity, PARTS)
                    rows = []
        if rows:
            yield _block(rows, capacity, PARTS)

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = written(docs.mapInArrow(tokenise, "block string, part int, histogram binary, pieces binary"))

    def before(key, group):
        """Of a part's blocks, each one's histogram of those before it; and the part's own, as a block without a name."""
        group = group.sort_values("block")
        own = np.stack([np.frombuffer(h, np.int64) for h in group["histogram"]])
        upto = np.cumsum(own, axis=0)
        told = pd.DataFrame({"block": group["block"], "part": int(key[0]), "before": [x.tobytes() for x in upto - own]})
        return pd.concat((told, pd.DataFrame({"block": [None], "part": [int(key[0])], "before": [upto[-1].tobytes()]})), ignore_index=True)

    starts = written(blocks.select("block", "part", "histogram").groupBy("part").applyInPandas(before, "block string, part int, before binary"))
    parts = np.zeros((PARTS, capacity + 1), np.int64)
    for r in starts.where("block is null").collect():  # PARTS histograms at most
        parts[r["part"]] = np.frombuffer(r["before"], np.int64)
    histogram = {int(l): int(n) for l, n in enumerate(parts.sum(axis=0)) if n}
    plan = {int(l): g for l, g in slots_of(plan_sequences(histogram, capacity)).groupby("length")}  # its size depends on the capacity, not on the corpus
    parts = np.cumsum(parts, axis=0) - parts

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            for part, first, pieces in zip(*(batch.column(c) for c in (0, 1, 2)), strict=True):
                ids, piece, start, length, crc, null = _pieces(pieces.as_py())
                rank = (parts[part.as_py()] + np.frombuffer(first.as_py(), np.int64))[length] + _own_ranks(length)
                sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
                for l, at in pd.Series(length).groupby(length).indices.items():
                    g = plan[int(l)]
                    row = np.searchsorted(g["first"].to_numpy(), rank[at], "right") - 1
                    begin, q, base, place_of = (g[c].to_numpy()[row] for c in ("first", "q", "base", "offset"))
                    sequence[at] = base + (rank[at] - begin) // q
                    offset[at] = place_of + (rank[at] - begin) % q * int(l)
                columns = [pa.array(ids, mask=null), *(pa.array(c) for c in (piece.astype(np.int32), start, length, crc, sequence, offset))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    told = blocks.select("block", "pieces").join(starts.where("block is not null"), "block").select("part", "before", "pieces")
    return told.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _block(rows: list[tuple], capacity: int, parts: int):
    """A block: its name, part, histogram of lengths, and its pieces' columns one after the other."""
    import pyarrow as pa

    ids = [r[0] for r in rows]
    table = np.array([(0 if i is None else i, *r[1:], i is None) for i, r in zip(ids, rows, strict=True)], np.int64).T
    name = uuid.uuid4()
    values = [[name.hex], pa.array([name.int % parts], pa.int32()), [np.bincount(table[3], minlength=capacity + 1).astype(np.int64).tobytes()], [table.tobytes()]]
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in values], names=["block", "part", "histogram", "pieces"])


def _pieces(table: bytes) -> tuple[np.ndarray, ...]:
    ids, piece, start, length, crc, null = np.frombuffer(table, np.int64).reshape(6, -1)
    return ids, piece, start, length, crc, null.astype(bool)


def _own_ranks(length: np.ndarray) -> np.ndarray:
    """How many earlier pieces of the block are as long, for each piece."""
    order = np.argsort(length, kind="stable")
    first = np.flatnonzero(np.diff(length[order], prepend=-1))
    out = np.empty(len(length), np.int64)
    out[order] = np.arange(len(length)) - np.repeat(first, np.diff(np.append(first, len(length))))
    return out
