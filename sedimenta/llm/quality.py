"""Document quality by a linear-chain conditional random field over lines.

Every line of a document is good or bad. What speaks for either is read off the line and its two neighbours: how often
one kind of character follows another, its length, how its words repeat, and whether an earlier line of the document is the
same. Neighbour lines' labels are tied by transition weights. A document's quality is the mean of its lines' marginals, from the
forward-backward algorithm, weighted by length.

The field is fitted, by gradient ascent on the conditional likelihood, on a bounded sample of labelled documents whose
lines all carry the document's label. The sample is small enough for one task, which alone holds its features.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import fold, fold_column

#: The sample for fitting, the first by hash of the id: so many documents at most, of so many lines and characters each
#: at most, and so many lines in all. Longer documents are left out of it.
FIT_DOCS, FIT_LINES, FIT_CHARS, FIT_ALL = 4000, 400, 1 << 16, 100_000
STEPS, RATE, PENALTY = 150, 0.05, 1e-3
THRESHOLD = 0.3
#: Bytes and lines of texts that are judged at once (a longer one is by itself), lines whose features are held at once,
#: bytes that are counted at once, lines from which on a chain goes line by line.
CHUNK, CHUNK_LINES, SLICE, PIECE, LONG = 4 << 20, 100_000, 4096, 1 << 20, 20_000
_BLANK = re.compile(rb"\s")

# Kinds of bytes: lower, upper, digit, blank, end of sentence, comma and the like, bracket or quote, bar, mark-up
# signs, other punctuation, control, first byte of a longer character, its other bytes.
_KINDS = np.full(256, 9, np.int64)
for _kind, _bytes in enumerate(
    (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b".?!", b",;:-'", b"()[]{}\"", b"|", b"<>/=&")
):
    _KINDS[list(_bytes)] = _kind
_KINDS[:9], _KINDS[14:32], _KINDS[127], _KINDS[10] = 10, 10, 10, 10
_KINDS[128:192], _KINDS[192:] = 12, 11
N_KINDS = 13
N_FEATURES = N_KINDS * N_KINDS + 6


def _word_shares(line: bytes) -> tuple[float, float]:
    """Of a line's words, the share that repeat the one before, and the share that are not the first of their kind."""
    total, same, kinds, last, at = 0, 0, set(), None, 0
    while at < len(line):
        end = at + PIECE
        if end < len(line):
            blank = _BLANK.search(line, end)
            end = blank.start() if blank else len(line)
        words = line[at:end].split()
        if words:
            same += sum(map(eq, words, words[1:])) + (words[0] == last)
            last = words[-1]
            total += len(words)
            kinds.update(words)
        at = end
    return (same / total, 1 - len(kinds) / total) if total > 1 else (0.0, 0.0)


def _feature_slices(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of all lines (one row each) and their lengths in bytes, SLICE lines of a text at a time at most."""
    for text in texts:
        buffer = np.frombuffer(text, np.uint8)
        ends = np.concatenate([np.flatnonzero(buffer[a : a + PIECE] == 10) + a for a in range(0, len(buffer), PIECE)] + [[len(buffer)]]).astype(np.int64)
        starts = np.concatenate(([0], ends[:-1] + 1))
        seen: set[bytes] = set()
        for low in range(0, len(ends), SLICE):
            begins, stops = starts[low : low + SLICE], ends[low : low + SLICE]
            n = len(begins)
            lengths = stops - begins + 1  # with the line's end
            counts = np.zeros(n * N_KINDS * N_KINDS)
            for a in range(begins[0], stops[-1] + 1, PIECE):  # a text stands between two ends of line
                b = min(a + PIECE, stops[-1] + 1)
                kinds = np.full(b - a + 1, _KINDS[10])
                part = buffer[max(a - 1, 0) : b]
                kinds[a == 0 : (a == 0) + len(part)] = _KINDS[part]
                line = np.searchsorted(stops, np.arange(a, b))
                counts += np.bincount(line * (N_KINDS * N_KINDS) + kinds[:-1] * N_KINDS + kinds[1:], minlength=len(counts))
            same, twice, again = np.zeros(n), np.zeros(n), np.zeros(n)
            for k, (a, b) in enumerate(zip(begins.tolist(), stops.tolist(), strict=True)):
                content = text[a:b]
                if content in seen:
                    same[k] = 1
                seen.add(content)
                twice[k], again[k] = _word_shares(content)
            shares = np.sqrt(counts.reshape(n, -1) / lengths[:, None])
            extra = np.stack((np.ones(n), np.log1p(lengths) / 5, lengths < 20, same, np.sqrt(twice), again), axis=1)
            yield np.hstack((shares, extra)).astype(np.float32), lengths


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines at once, their lengths in bytes, and how many lines each text has."""
    parts, lengths = zip(*_feature_slices(texts), strict=True)
    return np.concatenate(parts), np.concatenate(lengths), np.array([t.count(b"\n") + 1 for t in texts])


@dataclass
class Field:
    """Weights for the label good against bad: of the line's, the previous and the next line's features; and of the
    four transitions."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    moves: np.ndarray

    def votes(self, x: np.ndarray) -> np.ndarray:
        """What each line says of itself, of the next line and of the one before."""
        return x @ np.stack((self.own, self.before, self.after), axis=1).astype(np.float32)

    def pull(self, x: np.ndarray, lines_of: np.ndarray) -> np.ndarray:
        """What speaks for good in each line, from the features of all lines."""
        return self.joined(self.votes(x), lines_of)

    def joined(self, votes: np.ndarray, lines_of: np.ndarray) -> np.ndarray:
        """What speaks for good in each line, from all lines' votes."""
        first = np.zeros(len(votes), bool)
        first[np.concatenate(([0], np.cumsum(lines_of)[:-1]))] = True
        out, before, after = votes.astype(np.float64).T
        out[1:] += np.where(first[1:], 0, before[:-1])
        out[:-1] += np.where(first[1:], 0, after[1:])
        return out


def forward_backward(pull: np.ndarray, lines_of: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of good for each line, and expected transitions (2 x 2, summed); all chains go in step."""
    order = np.argsort(-lines_of, kind="stable")
    start = (np.cumsum(lines_of) - lines_of)[order]
    many, longest = lines_of[order], int(lines_of.max(initial=0))
    alive = [int(np.searchsorted(-many, -t, "left")) for t in range(longest)]  # chains of more than t lines
    good = 1 / (1 + np.exp(-np.clip(pull, -60, 60)))
    local = np.stack((1 - good, good), axis=1) + 1e-30
    step = np.exp(moves - moves.max())
    alpha, beta = np.empty_like(local), np.ones_like(local)
    for t in range(longest):
        at = start[: alive[t]] + t
        a = local[at] if t == 0 else (alpha[at - 1] @ step) * local[at]
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    expected = np.zeros((2, 2))
    for t in range(longest - 1, 0, -1):
        at = start[: alive[t]] + t
        ahead = local[at] * beta[at]
        both = alpha[at - 1][:, :, None] * step * ahead[:, None, :]
        both /= both.sum(axis=(1, 2), keepdims=True)
        expected += both.sum(axis=0)
        b = ahead @ step.T
        beta[at - 1] = b / b.sum(axis=1, keepdims=True)
    joint = alpha * beta
    return joint[:, 1] / joint.sum(axis=1), expected


def chain_marginals(pull: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Marginals of good for the lines of one long chain, as :func:`forward_backward` gives them: both passes carry the
    odds of good against bad."""
    odds = np.exp(np.clip(pull, -60, 60)).tolist()
    (bad_bad, bad_good), (good_bad, good_good) = np.exp(moves - moves.max()).tolist()
    forward, x = [], None
    for own in odds:
        x = own if x is None else own * (bad_good + x * good_good) / (bad_bad + x * good_bad)
        forward.append(x)
    out, x = np.empty(len(odds)), 1.0
    for i in range(len(odds) - 1, -1, -1):
        both = forward[i] * x
        out[i] = both / (1 + both)
        ahead = odds[i] * x
        x = (good_bad + ahead * good_good) / (bad_bad + ahead * bad_good)
    return out


def _shifted(weights: np.ndarray, lines_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A value for each line, moved to its previous and to its next line."""
    first = np.zeros(len(weights), bool)
    first[np.concatenate(([0], np.cumsum(lines_of)[:-1]))] = True
    to_before, to_after = np.zeros_like(weights), np.zeros_like(weights)
    to_before[:-1] = np.where(first[1:], 0, weights[1:])
    to_after[1:] = np.where(first[1:], 0, weights[:-1])
    return to_before, to_after


def fit_field(x: np.ndarray, lines_of: np.ndarray, labels: np.ndarray) -> Field:
    """Maximum conditional likelihood with a quadratic penalty, by Adam over all chains; documents weigh alike."""
    field = Field(*(np.zeros(N_FEATURES) for _ in range(3)), np.zeros((2, 2)))
    if not len(labels):
        return field
    of_line = np.repeat(labels, lines_of).astype(float)
    share = np.repeat(1 / lines_of, lines_of)
    told = np.zeros((2, 2))
    for label in (0, 1):
        told[label, label] = (lines_of[labels == label] - 1).sum()
    vector = np.zeros(3 * N_FEATURES + 4)
    m, v = np.zeros_like(vector), np.zeros_like(vector)
    for step in range(1, STEPS + 1):
        good, expected = forward_backward(field.pull(x, lines_of), lines_of, field.moves)
        miss = (of_line - good) * share
        to_before, to_after = _shifted(miss, lines_of)
        slope = (x.T @ np.stack((miss, to_before, to_after), axis=1).astype(np.float32)).T.ravel().astype(np.float64) / len(labels)
        slope = np.concatenate((slope, ((told - expected) / max(1, told.sum())).ravel())) - PENALTY * vector
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        vector = vector + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        own, before, after, moves = np.split(vector, [N_FEATURES, 2 * N_FEATURES, 3 * N_FEATURES])
        field = Field(own, before, after, moves.reshape(2, 2))
    return field


def _chunks(texts: list[str | None]) -> Iterator[list[bytes]]:
    """Texts as UTF-8, null as empty, some at a time; one of many lines is by itself."""
    some, size, lines = [], 0, 0
    for t in texts:
        body = (t or "").encode("utf-8", "surrogatepass")
        n = body.count(b"\n") + 1
        if some and (size + len(body) > CHUNK or lines + n > CHUNK_LINES):
            yield some
            some, size, lines = [], 0, 0
        some.append(body)
        size += len(body)
        lines += n
    if some:
        yield some


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_DOCS, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """A field from at most ``limit`` documents that have a label (the least by hash of the id) and are not held out.

    Labels that are null, and ids that have several different labels, are left out, as are documents over FIT_LINES
    or FIT_CHARS; beyond FIT_ALL lines no more documents are taken. Without any label, the field gives every line 1/2.
    """
    told = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold_column("doc_id") != 0))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .where("quality = most")
        .select("doc_id", "quality")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.where((F.length("text") <= FIT_CHARS) & (F.size(F.split("text", "\n", -1)) <= FIT_LINES))
    sample = texts.join(F.broadcast(told), "doc_id")  # limit rows at most
    sample = sample.select(F.xxhash64("doc_id").alias("draw"), "doc_id", "text", F.col("quality").cast("int").alias("quality"))

    def learn(frames):
        import pandas as pd

        rows = sorted(r for f in frames for r in zip(f["draw"], f["doc_id"], f["quality"], f["text"], strict=True))  # the sum's order must not depend on tasks
        parts, sizes, marks = [], [], []
        for *_, quality, text in rows:
            if sum(sizes) > FIT_ALL:
                break
            x, _, lines_of = line_features([text.encode("utf-8", "surrogatepass")])
            parts.append(x)
            sizes.append(int(lines_of[0]))
            marks.append(quality)
        if parts:
            field = fit_field(np.concatenate(parts), np.array(sizes), np.array(marks))
            yield pd.DataFrame({"weights": [np.concatenate((field.own, field.before, field.after, field.moves.ravel())).tobytes()]})

    found = sample.repartition(1).mapInPandas(learn, "weights binary").collect()
    if not found:
        return fit_field(np.empty((0, N_FEATURES), np.float32), np.empty(0, np.int64), np.empty(0))
    own, before, after, moves = np.split(np.frombuffer(found[0]["weights"]), [N_FEATURES, 2 * N_FEATURES, 3 * N_FEATURES])
    return Field(own, before, after, moves.reshape(2, 2))


def text_scores(texts: list[str | None], field: Field) -> np.ndarray:
    """The quality of whole texts: the mean of their lines' marginals by length."""
    scores = []
    for chunk in _chunks(texts):
        lines_of = np.array([t.count(b"\n") + 1 for t in chunk])
        votes, lengths, at = np.empty((lines_of.sum(), 3), np.float32), np.empty(lines_of.sum()), 0
        for x, n in _feature_slices(chunk):
            votes[at : at + len(n)], lengths[at : at + len(n)] = field.votes(x), n
            at += len(n)
        pull = field.joined(votes, lines_of)
        if len(chunk) == 1 and len(pull) > LONG:
            good = chain_marginals(pull, field.moves)
        else:
            good, _ = forward_backward(pull, lines_of, field.moves)
        starts = np.cumsum(lines_of) - lines_of
        scores += (np.add.reduceat(good * lengths, starts) / np.add.reduceat(lengths, starts)).tolist()
    return np.clip(np.array(scores, float), 0, 1)


def score(docs: DataFrame, field: Field, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    Every line of the whole text counts, by its length with the line's end; a null or empty text is one empty line. Only
    the text decides the score. Repeated rows get a row each; further columns are ignored; an empty table gives an
    empty result.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            scores = text_scores(b.column(1).to_pylist(), field)
            held = [fold(i) == 0 for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(held, pa.bool_()), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    schema = "doc_id long, held_out boolean, score double, predicted int"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are predicted good; columns as they are. Rows are judged where they are read, so nothing
    is shuffled."""
    field, at = fit(docs, labels), docs.columns.index(text_col)

    def keep(batches):
        import pyarrow as pa

        for b in batches:
            yield b.filter(pa.array(text_scores(b.column(at).to_pylist(), field) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
