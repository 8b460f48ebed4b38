"""Language-model scores of whole documents by a gated recurrent network.

Rows are kept in blocks of tokens. Vocabulary and counts come from all training tokens: each block sends its distinct
tokens with their counts, in order and cut by ranges of token numbers, to the owners of these ranges, who add up and answer
each block with the totals. So neither the counts nor the vocabulary are ever in one place, and a token travels once for
each block however often it occurs.

The network predicts the frequent tokens: those whose count is at least a fixed share of all, so that their number has
a bound whatever the corpus. All others are rare words by their last letters, within which a token has its smoothed
share of the counts, a token never seen in training that of half an occurrence. The output is factored: a softmax over
classes of about equal mass, then one over the words of a class. Output biases start at the counts, which makes the
untrained model the base model; training then moves away from it.

Training is truncated back-propagation through time in numpy, over every training document once, from its first token to
its last: the state is carried from window to window, gradients are not. Documents are dealt to lanes that go in step, one
document after the other in each. Blocks train side by side from the same weights, which are then averaged by parts in
a shuffle; each round takes its share of the documents. Scoring runs over whole documents in the same lanes.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import fold, written

HELD_OUT = 1
#: A token is frequent if it is at least one in so many, which is also the bound on the number of frequent ones.
FREQUENT = 4096
HIDDEN, CLASSES, WINDOW = 24, 64, 48
#: Lanes that training and scoring go in at most; a wider step costs less a token, a narrower one learns more from each.
#: Training takes as many as give a block so many steps.
LANES, SCORE_LANES, STEPS = 128, 256, 256
#: Rounds between which weights are averaged. A document is in one of them.
ROUNDS, RATE = 2, 0.08
#: Tokens of a block at most (a longer document is a block of its own).
BLOCK_TOKENS = 1 << 22
#: Bytes of texts that are split at once (a longer text by itself).
PIECE_BYTES = 32 << 20
#: Numbers of a part of the weights, the unit in which they are averaged; sums of a part that one task adds up at most.
PART, FAN_IN = 1 << 14, 64
#: Distinct tokens of blocks that an owner adds up on average.
OWNER_NUMBERS = 1 << 20
START = 0
#: Rare tokens by kind: the last letter; the last byte of another script; a digit; anything else.
KINDS = 44
_KIND_BITS = 63

# ---- blocks of tokens


def kind_of(word: bytes) -> int:
    """A number below KINDS, from the word's last letter."""
    last = word[-1:]
    if not last.isalpha():
        last = word.rstrip(b".,;:!?*%#$&|\"')")[-1:] or b"-"
    if last.isalpha():
        return last[0] - 97
    high = [b for b in word if b > 127] if not word.isascii() else ()
    return 26 + (high[-1] & 15) if high else 42 if last.isdigit() else 43


def _numbers(words: list[bytes]) -> list[int]:
    """64-bit numbers of words: the upper 58 bits of the word's XXH64 and its kind. The end is the empty word."""
    from xxhash import xxh64_intdigest

    return [h & ~_KIND_BITS | kind for h, kind in zip(map(xxh64_intdigest, words), map(kind_of, words), strict=True)]


class _Tokens(dict):
    """word -> its place among those asked for, of a few words; ``numbers`` has the number of each place."""

    def __init__(self):
        super().__init__()
        self.numbers: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self.numbers)
        self.numbers += _numbers([word])
        return place


def _split(texts):
    """Of stretches of some rows: the first row, tokens of all texts as places among the distinct words, the numbers of these
    (the end is the last), and the tokens of each text. Arrow's lower case and white space are ASCII's, as wanted here."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "")
    pieces = np.cumsum(pc.binary_length(texts).to_numpy()) // PIECE_BYTES
    bounds = [0, *(np.flatnonzero(np.diff(pieces)) + 1).tolist(), len(texts)]
    for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts[begin:end]))
        lengths = pc.list_value_length(split).to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        distinct, places = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        none = distinct.index(b"") if b"" in distinct else -1  # before leading and after trailing white space
        if none >= 0:
            empty = places == none
            lengths -= np.bincount(np.repeat(np.arange(len(lengths)), lengths)[empty], minlength=len(lengths))
            places = places[~empty]
        last = np.zeros(len(places) + len(lengths), bool)
        last[np.cumsum(lengths + 1) - 1] = True
        tokens = np.full(len(last), len(distinct), np.int32)
        tokens[~last] = places
        yield begin, tokens, np.array(_numbers([*distinct, b""]), np.uint64), lengths + 1


def _blocks(batches):
    """Rows into blocks: ids, fold marks, lengths in tokens (with the end), tokens as places among the distinct, and these in
    order with their counts in training rows."""
    import pyarrow as pa
    from pyspark import TaskContext

    name = TaskContext.get().partitionId() << 32
    names = [f.split()[0] for f in BLOCK_SCHEMA.split(", ")]

    def block(ids, texts, lengths, numbers):
        lengths = np.array(lengths, np.int64)
        held = np.array([fold(i) == HELD_OUT for i in ids], bool)
        distinct, place = np.unique(np.concatenate(numbers), return_inverse=True)
        every = place.astype("<u4")[np.concatenate(texts)]
        counts = np.bincount(every[np.repeat(~held, lengths)], minlength=len(distinct))
        whole = np.array([0 if i is None else i for i in ids], np.int64)
        values = [name, whole.tobytes(), np.packbits([i is None for i in ids]).tobytes(), held.tobytes(), lengths.tobytes(), every.tobytes(), distinct.tobytes(), counts.astype("<i8").tobytes(), len(distinct), int(counts.sum())]
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=names)

    def add(texts, tokens, numbers, piece):
        """Tokens as places among the numbers of a block, which are told apart when it ends."""
        if len(tokens):
            met = np.flatnonzero(np.bincount(tokens, minlength=len(piece)))
            place = np.zeros(len(piece), "<u4")
            place[met] = np.arange(len(met)) + sum(map(len, numbers))
            texts.append(place[tokens])
            numbers.append(piece[met])

    ids, texts, lengths, size, numbers = [], [], [], 0, []
    for batch in batches:
        every_id = batch.column(0).to_pylist()
        for first, tokens, piece, own in _split(batch.column(1)):
            begin = at = 0
            for k, length in enumerate(own.tolist()):
                if ids and size + length > BLOCK_TOKENS:
                    add(texts, tokens[begin:at], numbers, piece)
                    yield block(ids, texts, lengths, numbers)
                    ids, texts, lengths, size, numbers, name, begin = [], [], [], 0, [], name + 1, at
                ids.append(every_id[first + k])
                lengths.append(length)
                size += length
                at += length
            add(texts, tokens[begin:], numbers, piece)
    if ids:
        yield block(ids, texts, lengths, numbers)


BLOCK_SCHEMA = "block long, ids binary, nulls binary, held binary, lengths binary, tokens binary, distinct binary, train_counts binary, n_distinct long, n_train long"


def counted(docs: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Blocks; by block, the totals of its distinct tokens, in pieces that follow each other; tokens and distinct tokens of
    training rows by kind; and the frequent tokens (number, count)."""
    blocks = written(docs.mapInArrow(_blocks, BLOCK_SCHEMA))
    sums = blocks.agg(F.sum("n_distinct").alias("n_distinct"), F.sum("n_train").alias("n_train")).first()
    owners, n_train = max(1, -(-(sums["n_distinct"] or 0) // OWNER_NUMBERS)), sums["n_train"] or 0
    cuts = np.array([(i << 64) // owners for i in range(1, owners)], np.uint64)

    def send(batches):
        import pyarrow as pa

        for batch in batches:
            for block, distinct, counts in zip(*batch.columns, strict=True):
                numbers, counts = np.frombuffer(distinct.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), "<i8")
                at = np.concatenate(([0], np.searchsorted(numbers, cuts), [len(numbers)])).astype(int).tolist()
                mine = [o for o in range(owners) if at[o] < at[o + 1]]
                pieces = [pa.array([x[at[o] : at[o + 1]].tobytes() for o in mine], pa.binary()) for x in (numbers, counts)]
                yield pa.RecordBatch.from_arrays([pa.array(mine, pa.int32()), pa.array([block.as_py()] * len(mine), pa.int64()), *pieces], names=["owner", "block", "numbers", "counts"])

    def add(key, group):
        numbers = np.concatenate([np.frombuffer(x, np.uint64) for x in group["numbers"]])
        order = np.argsort(numbers, kind="stable")
        begins = np.flatnonzero(np.concatenate(([True], numbers[order[1:]] != numbers[order[:-1]])))
        sizes = np.diff(begins, append=len(order))
        own = np.add.reduceat(np.concatenate([np.frombuffer(x, "<i8") for x in group["counts"]])[order], begins)
        totals = np.empty(len(order), "<i8")
        totals[order] = np.repeat(own, sizes)
        ends = np.cumsum([len(x) // 8 for x in group["numbers"]])
        answers = pd.DataFrame({"owner": group["owner"], "block": group["block"], "totals": [x.tobytes() for x in np.split(totals, ends[:-1])]})
        distinct = numbers[order[begins]]
        kinds = (distinct & np.uint64(_KIND_BITS)).astype(np.int64)
        by_kind = np.zeros((2, KINDS), np.int64)
        np.add.at(by_kind[0], kinds, own)
        np.add.at(by_kind[1], kinds, own > 0)
        often = (own * FREQUENT >= n_train) & (own > 1)
        said = {"owner": int(key[0]), "by_kind": by_kind.tobytes(), "often": np.stack((distinct[often].view(np.int64), own[often])).tobytes()}
        return pd.concat([answers, pd.DataFrame([said])]).astype({"block": "Int64"})[["owner", "block", "totals", "by_kind", "often"]]

    sent = blocks.select("block", "distinct", "train_counts").mapInArrow(send, "owner int, block long, numbers binary, counts binary")
    owned = written(sent.groupBy("owner").applyInPandas(add, "owner int, block long, totals binary, by_kind binary, often binary"))
    by_kind, common = np.zeros((2, KINDS), np.int64), []
    for r in owned.where("block is null").select("by_kind", "often").collect():  # FREQUENT tokens at most in all
        by_kind += np.frombuffer(r["by_kind"], np.int64).reshape(2, KINDS)
        common += zip(*np.frombuffer(r["often"], np.int64).reshape(2, -1).tolist(), strict=True)
    ordered = F.sort_array(F.collect_list(F.struct("owner", "totals")))
    gathered = owned.where("block is not null").groupBy("block").agg(F.transform(ordered, lambda x: x["totals"]).alias("totals"))
    return blocks, gathered, *by_kind, sorted(common, key=lambda x: (-x[1], x[0]))


# ---- the network


@dataclass
class Shape:
    """Words and classes. Words are numbered from 1 by falling mass; a class is a run of them. START is word 0."""

    hashes: np.ndarray  # of the frequent words, sorted
    words: np.ndarray  # their numbers
    kind_words: np.ndarray  # of the rare kinds
    class_of: np.ndarray
    first: np.ndarray  # of each class
    size: np.ndarray
    logs: np.ndarray  # log mass of each word by counts
    rare: np.ndarray  # smoothed count of each rare kind


def shape_of(common: list[tuple[int, int]], tokens: np.ndarray, distinct: np.ndarray) -> Shape:
    """Classes of about equal mass of the frequent words and the rare kinds."""
    hashes = np.array([h for h, _ in common], np.int64).view(np.uint64)
    counts = np.array([c for _, c in common], float)
    kinds = (hashes & np.uint64(_KIND_BITS)).astype(np.int64)
    rare = tokens - np.bincount(kinds, counts, KINDS) + 0.5 * (distinct - np.bincount(kinds, minlength=KINDS) + 1)
    mass = np.concatenate((rare, counts + 0.5))
    mass /= mass.sum()
    order = np.argsort(-mass, kind="stable")
    word = np.empty(len(mass), np.int64)
    word[order] = np.arange(1, len(mass) + 1)
    mass = mass[order]
    cut = np.minimum((np.cumsum(mass) - mass) * CLASSES, CLASSES - 1).astype(np.int64)
    _, cut = np.unique(cut, return_inverse=True)
    size = np.bincount(cut)
    first = np.concatenate(([1], 1 + np.cumsum(size)[:-1]))
    sort = np.argsort(hashes)
    return Shape(hashes[sort], word[KINDS:][sort], word[:KINDS], np.concatenate(([-1], cut)), first, size, np.log(np.concatenate(([1], mass))), rare)


def start_weights(shape: Shape, hidden: int = HIDDEN, seed: int = 7) -> dict[str, np.ndarray]:
    rng, n = np.random.default_rng(seed), len(shape.class_of)
    of_class = np.bincount(shape.class_of[1:], weights=np.exp(shape.logs[1:]))
    g = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-1])).astype(np.float32)
    return {
        "E": g(n, hidden),  # inputs
        "W": g(3 * hidden, hidden), "U": g(3 * hidden, hidden), "b": np.zeros(3 * hidden, np.float32),  # update, reset, new
        "C": np.zeros((len(of_class), hidden), np.float32), "c": np.log(of_class).astype(np.float32),
        "O": np.zeros((n, hidden), np.float32), "o": np.concatenate(([0], shape.logs[1:])).astype(np.float32),
    }


@dataclass
class Steps:
    """What going back through a window needs: for each step the states before it, gates, new states and what the states
    gave to these, as (step, unit, lane)."""

    before: np.ndarray
    gates: np.ndarray
    new: np.ndarray
    from_state: np.ndarray


def run_window(p: dict, inputs: np.ndarray, h: np.ndarray, goes_on: np.ndarray | None = None, keep: bool = True) -> tuple[np.ndarray, Steps]:
    """States (step, lane, unit) after each step of inputs (step, lane), from states h (lane, unit). ``goes_on`` is 0 where
    a text begins, which is where the state before it does not count. Without ``keep``, of the steps only the last stays."""
    (steps, lanes), k, kind = inputs.shape, h.shape[1], p["U"].dtype
    half = np.repeat(np.array([0.5, 0.5, 1], kind), k)  # a sigmoid is a tanh of half its argument
    recur = p["U"] * half[:, None]
    table = (p["E"] @ p["W"].T + p["b"]) * half
    from_input = np.ascontiguousarray(table[inputs].transpose(0, 2, 1))
    out = Steps(*(np.empty((steps if keep else 1, n * k, lanes), kind) for n in (1, 2, 1, 1)))
    states = np.empty((steps, k, lanes), kind)
    h = np.ascontiguousarray(h.T)
    for t in range(steps):
        i, a = t if keep else 0, from_input[t]
        before, zr, new, un = out.before[i], out.gates[i], out.new[i], out.from_state[i]
        if goes_on is None:
            before[:] = h
        else:
            np.multiply(h, goes_on[t], out=before)
        u = recur @ before
        np.add(a[: 2 * k], u[: 2 * k], out=zr)
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        un[:] = u[2 * k :]
        np.multiply(zr[k:], un, out=new)
        new += a[2 * k :]
        np.tanh(new, out=new)
        h = states[t]
        np.subtract(before, new, out=h)
        h *= zr[:k]
        h += new
    return np.ascontiguousarray(states.transpose(0, 2, 1)), out


def _softmax(x: np.ndarray, at: np.ndarray, whole: bool) -> np.ndarray:
    """The logs of the probabilities ``at``, of rows of logits; if ``whole``, x becomes all the probabilities."""
    np.clip(x, -60, 60, out=x)
    told = x[np.arange(len(x)), at]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    if whole:
        x *= (1 / total)[:, None]
    return told - np.log(total)


def log_probabilities(p: dict, shape: Shape, h: np.ndarray, words: np.ndarray, slopes: dict | None = None, scale: float = 1.0):
    """Natural logs of the words' probabilities after states h; with ``slopes``, adds the losses' gradients to them and
    returns the one by h too."""
    of, train = shape.class_of[words], slopes is not None
    order = np.argsort(of.astype(np.uint16), kind="stable")
    h, words, of, ones = h[order], words[order], of[order], np.ones(len(words), h.dtype)
    x = h @ p["C"].T
    x += p["c"]
    logs = _softmax(x, of, train).astype(np.float64)
    if train:
        x[np.arange(len(words)), of] -= 1
        x *= scale
        slopes["C"] += x.T @ h
        slopes["c"] += ones @ x
        dh = x @ p["C"]
    ends = np.cumsum(np.bincount(of, minlength=len(shape.size)))
    within = words - shape.first[of]
    begin = 0
    for c, end in enumerate(ends.tolist()):
        if end > begin and shape.size[c] > 1:
            part, rows = slice(begin, end), slice(shape.first[c], shape.first[c] + shape.size[c])
            x = h[part] @ p["O"][rows].T
            x += p["o"][rows]
            logs[part] += _softmax(x, within[part], train)
            if train:
                x[np.arange(len(x)), within[part]] -= 1
                x *= scale
                slopes["O"][rows] += x.T @ h[part]
                slopes["o"][rows] += ones[part] @ x
                dh[part] += x @ p["O"][rows]
        begin = end
    out = np.empty_like(logs)
    out[order] = logs
    if not train:
        return out
    back = np.empty_like(dh)
    back[order] = dh
    return out, back


def back_through(p: dict, inputs: np.ndarray, kept: Steps, dh_out: np.ndarray, slopes: dict, goes_on: np.ndarray | None = None) -> np.ndarray:
    """Adds the gradients of a window, from those by its states (step, lane, unit), and gives the words that have been
    inputs; what flows into the state before the window is cut off."""
    k, u = dh_out.shape[2], np.ascontiguousarray(p["U"].T)
    z, r, new = kept.gates[:, :k], kept.gates[:, k:], kept.new
    to_new, to_z, to_r = (1 - z) * (1 - new * new), z * (1 - z) * (kept.before - new), kept.from_state * r * (1 - r)
    dh_out = np.ascontiguousarray(dh_out.transpose(0, 2, 1))
    d_in, d_un = np.empty((len(inputs), 3 * k, inputs.shape[1]), u.dtype), np.empty_like(new)
    du, dh = np.empty((3 * k, inputs.shape[1]), u.dtype), np.zeros_like(dh_out[0])
    for t in range(len(inputs) - 1, -1, -1):
        dh += dh_out[t]
        d = d_in[t]
        np.multiply(dh, to_z[t], out=d[:k])
        np.multiply(dh, to_new[t], out=d[2 * k :])
        np.multiply(d[2 * k :], to_r[t], out=d[k : 2 * k])
        np.multiply(d[2 * k :], r[t], out=d_un[t])
        du[: 2 * k], du[2 * k :] = d[: 2 * k], d_un[t]
        dh *= z[t]
        dh += u @ du
        if goes_on is not None:
            dh *= goes_on[t]
    by_row = lambda x: x.transpose(1, 0, 2).reshape(x.shape[1], -1)
    flat, before = by_row(d_in), by_row(kept.before)
    slopes["U"][: 2 * k] += flat[: 2 * k] @ before.T
    slopes["U"][2 * k :] += by_row(d_un) @ before.T
    order = np.argsort(inputs.ravel().astype(np.uint16), kind="stable")  # words are FREQUENT and KINDS at most
    ordered = inputs.ravel()[order]
    begins = np.flatnonzero(np.diff(ordered, prepend=-1))
    words = ordered[begins]
    by_word = np.add.reduceat(np.ascontiguousarray(flat.T)[order], begins)
    slopes["W"] += by_word.T @ p["E"][words]
    slopes["b"] += by_word.sum(axis=0)
    slopes["E"][words] += by_word @ p["W"]
    return words


# ---- lanes


class Lanes:
    """Texts (none is empty) dealt to lanes: the longest first to the lane that has least, then each lane in their order."""

    def __init__(self, texts: list[np.ndarray], lanes: int):
        lengths = np.array([len(t) for t in texts], np.int64)
        lanes = min(lanes, len(texts))
        heap, of = [(0, j) for j in range(lanes)], [[] for _ in range(lanes)]
        for i in np.argsort(-lengths, kind="stable").tolist():
            load, j = heapq.heappop(heap)
            of[j].append(i)
            heapq.heappush(heap, (load + int(lengths[i]), j))
        of = sorted((sorted(o) for o in of), key=lambda o: -int(lengths[o].sum()))
        order = np.array([i for o in of for i in o])
        self.loads = np.array([int(lengths[o].sum()) for o in of])
        self.starts = np.cumsum(self.loads) - self.loads
        self.words = np.concatenate([texts[i] for i in order.tolist()]).astype(np.int32)
        begins = np.cumsum(lengths[order]) - lengths[order]
        self.goes_on = np.ones(len(self.words), np.float32)
        self.goes_on[begins] = 0
        self.before = np.concatenate(([START], self.words[:-1]))
        self.before[begins] = START
        self.text = np.repeat(order, lengths[order])

    def windows(self):
        """Of each window, by (step, lane): inputs, words (0 where a lane has ended), goes_on (0 where a text begins) and
        whose words they are. Lanes that have ended are left out; the others come first."""
        least = int(self.loads.min())
        for a in range(0, int(self.loads[0]), WINDOW):
            live = int(np.searchsorted(-self.loads, -a, "left"))
            at = np.arange(a, min(a + WINDOW, int(self.loads[0])))[:, None]
            where = self.starts[:live] + at
            if at[-1, 0] < least:
                yield self.before[where], self.words[where], self.goes_on[where], self.text[where]
            else:
                real = at < self.loads[:live]
                where[~real] = 0
                yield np.where(real, self.before[where], START), np.where(real, self.words[where], START), self.goes_on[where], self.text[where]


def train(p: dict, shape: Shape, texts: list[np.ndarray]) -> dict:
    """Adagrad over whole texts window by window, a step for each. Only rows of E that a window has as inputs have
    gradients, so only these are updated."""
    p = {k: v.copy() for k, v in p.items()}
    past = {k: np.full_like(v, 1e-3) for k, v in p.items()}
    slopes = {k: np.zeros_like(v) for k, v in p.items()}
    lanes = min(LANES, max(1, sum(map(len, texts)) // (WINDOW * STEPS)))
    h = np.zeros((lanes, p["U"].shape[1]), np.float32)
    for x, y, goes_on, _ in Lanes(texts, lanes).windows():
        states, kept = run_window(p, x, h[: x.shape[1]], goes_on)
        real = y != START
        if real.all():
            dh = log_probabilities(p, shape, states.reshape(-1, h.shape[1]), y.ravel(), slopes, 1 / y.size)[1].reshape(states.shape)
        else:
            dh = np.zeros_like(states)
            dh[real] = log_probabilities(p, shape, states[real], y[real], slopes, 1 / int(real.sum()))[1]
        met = back_through(p, x, kept, dh, slopes, goes_on)
        rows = {k: met if k == "E" else slice(None) for k in p}
        own = {k: slopes[k][rows[k]] for k in p}
        scale = np.float32(1 / max(1.0, np.sqrt(sum(float(np.vdot(s, s)) for s in own.values()))))
        for k, s in own.items():
            s = s * scale
            more = past[k][rows[k]] + s * s
            past[k][rows[k]] = more
            s *= RATE
            s /= np.sqrt(more, out=more)
            p[k][rows[k]] -= s
            slopes[k][rows[k]] = 0
        h = states[-1]
    return p


def score_texts(p: dict, shape: Shape, texts: list[np.ndarray], lanes: int = SCORE_LANES) -> np.ndarray:
    """Natural log probabilities of whole texts, the state carried across windows from the first token to the last."""
    out = np.zeros(len(texts))
    h = np.zeros((lanes, p["U"].shape[1]), np.float32)
    for x, y, goes_on, text in Lanes(texts, lanes).windows():
        states, _ = run_window(p, x, h[: x.shape[1]], goes_on, keep=False)
        h, real = states[-1], y.ravel() != START
        states, y, text = states.reshape(-1, h.shape[1]), y.ravel(), text.ravel()
        if not real.all():
            states, y, text = states[real], y[real], text[real]
        out += np.bincount(text, log_probabilities(p, shape, states, y), len(texts))
    return out


def _words(shape: Shape, distinct: np.ndarray) -> np.ndarray:
    """Words of these token numbers: rare kinds for those that are not frequent."""
    rare = shape.kind_words[(distinct & np.uint64(_KIND_BITS)).astype(np.int64)]
    if not len(shape.hashes):
        return rare
    at = np.minimum(np.searchsorted(shape.hashes, distinct), len(shape.hashes) - 1)
    return np.where(shape.hashes[at] == distinct, shape.words[at], rare)


def _texts(row, shape: Shape):
    """Words of the distinct tokens; tokens as places among these; lengths and starts of texts; whether each is held out."""
    words = _words(shape, np.frombuffer(row["distinct"], np.uint64))
    tokens, lengths = np.frombuffer(row["tokens"], "<u4"), np.frombuffer(row["lengths"], np.int64)
    return words, tokens, lengths, np.cumsum(lengths) - lengths, np.frombuffer(row["held"], bool)


def _draws(row) -> np.ndarray:
    """A number for each text by its id, which does not depend on where it is."""
    x = np.frombuffer(row["ids"], np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):  # fixed values of a mixing function
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x


def _joined(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _parted(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def fit(blocks: DataFrame, shape: Shape) -> dict:
    """Weights after ROUNDS rounds, each over all tokens of its share of the training documents, in the order of a hash of
    their ids."""
    p = start_weights(shape)
    rows = blocks.select("block", "ids", "held", "lengths", "tokens", "distinct")
    for round_no in range(ROUNDS):

        def learn(frames, p=p, round_no=round_no):
            whole, weight, first = None, 0.0, 0
            for f in frames:
                for row in f.to_dict("records"):
                    words, tokens, lengths, starts, held = _texts(row, shape)
                    draws = _draws(row)
                    mine = np.flatnonzero(~held & (draws % np.uint64(ROUNDS) == round_no))
                    if not len(mine):
                        continue
                    mine = mine[np.argsort(draws[mine], kind="stable")]
                    flat = _joined(train(p, shape, [words[tokens[starts[i] : starts[i] + lengths[i]]] for i in mine.tolist()]))
                    own = float(lengths[mine].sum())
                    first = row["block"] if whole is None else first
                    whole = flat.astype("<f8") * own if whole is None else whole + flat.astype("<f8") * own
                    weight += own
            if whole is not None:
                parts = [whole[i : i + PART].tobytes() for i in range(0, len(whole), PART)]
                yield pd.DataFrame({"part": range(len(parts)), "block": first, "weight": weight, "numbers": parts})

        def add(key, group):
            group = group.sort_values("block")
            whole = sum(np.frombuffer(x, "<f8") for x in group["numbers"])
            return pd.DataFrame({"part": [int(key[0])], "block": [group["block"].iloc[0]], "weight": [group["weight"].sum()], "numbers": [whole.tobytes()], "task": [int(key[1])]})

        # blocks add up in their task, tasks in a tree: no task gets more than FAN_IN sums of a part at once
        sums = written(rows.mapInPandas(learn, "part int, block long, weight double, numbers binary").withColumn("task", F.spark_partition_id()))
        tasks = (sums.agg(F.max("task")).first()[0] or 0) + 1
        while True:
            sums = sums.groupBy("part", F.floor(F.col("task") / FAN_IN).cast("int").alias("task")).applyInPandas(add, "part int, block long, weight double, numbers binary, task int")
            tasks = -(-tasks // FAN_IN)
            if tasks == 1:
                break
        parts = sums.collect()  # the weights: their size is fixed
        if parts:
            parts.sort(key=lambda r: r["part"])
            p = _parted(np.concatenate([np.frombuffer(r["numbers"], "<f8") / r["weight"] for r in parts]), p)
    return p


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of the whole text, A-Z lower-cased, and one end; a null or empty text is the end alone. Only
    rows that are not held out are learnt from. base_score sums the smoothed log10 shares of counts; score is the
    network's log10 probability. Tokens are told apart by 58 bits of their XXH64 and their kind: two that agree in
    both would be counted as one. Repeated rows count each; a null id is in the fold of the empty string;
    further columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks, gathered, tokens_of, distinct_of, common = counted(docs)
    shape, total = shape_of(common, tokens_of, distinct_of), int(tokens_of.sum())
    weights = fit(blocks, shape)
    whole = total + 0.5 * (int(distinct_of.sum()) + 1)

    def within_kinds(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Log share of a rare token in its kind; 0 for frequent ones, which are words of their own."""
        rare = np.full(len(shape.class_of), np.nan)
        rare[shape.kind_words] = shape.rare
        own = rare[words]
        return np.where(np.isnan(own), 0.0, np.log((counts + 0.5) / np.where(np.isnan(own), 1.0, own)))

    def run(frames):
        import pyarrow as pa

        for batch in frames:
            for row in batch.to_pylist():
                words, tokens, lengths, starts, held = _texts(row, shape)
                counts = np.frombuffer(b"".join(row["totals"]), "<i8")
                base = np.log10((counts + 0.5) / whole)
                within = within_kinds(counts, words)
                texts = np.split(words[tokens], starts[1:])
                logs = score_texts(weights, shape, texts) + np.add.reduceat(within[tokens], starts)
                ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=np.unpackbits(np.frombuffer(row["nulls"], np.uint8), count=len(lengths)).astype(bool))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(held), pa.array(lengths), pa.array(np.add.reduceat((counts > 0)[tokens].astype(np.int64), starts)), pa.array(np.full(len(lengths), total, np.int64)), pa.array(np.add.reduceat(base[tokens], starts)), pa.array(logs / np.log(10))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    told = blocks.drop("train_counts", "n_distinct", "n_train").join(gathered, "block")
    return told.select("ids", "nulls", "held", "lengths", "tokens", "distinct", "totals").mapInArrow(run, schema)
