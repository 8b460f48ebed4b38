"""Personal data by patterns and a skip-chain conditional random field.

Four patterns give base spans. The field labels tokens O, email, ip, card or phone: a token's own shape and its
neighbours' give its potentials, consecutive tokens share one, and so does every two mentions, near or far in the
document, that are equal or similar (the same letters and digits once punctuation and case are taken off, or digits of
which one ends in the other). Loopy belief propagation makes the labels of such tokens agree: where one mention of a
number is plainly a phone or a card, a mention that the pattern missed becomes one too. Spans that the field adds never
touch a base span, and base spans all stay.

Only tokens with a digit or an @ can have a label other than O: for any other token the potentials of the four labels
are minus infinity. Such tokens cut the chain and need no messages, so inference is exact with them left out.
Mentions are linked in a star, all of a kind to one of them, the first that a pattern found if there is one: any two are
two links apart, and a number repeated a thousand times has a thousand links. Along links messages are maxima, not sums:
a hub gets nothing from mentions that clearly lean to O, however many there are.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# ip: [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), see ``addresses``
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MAY_HOLD = re.compile(r"[0-9@]")

_RUN = re.compile(r"\S*")
_NUMBERS = re.compile(r"[0-9.]+")
NEAR = 3  # characters between two tokens that the chain still joins
ROUNDS = 12  # of messages
THRESHOLD, ALONE = 0.5, 0.9  # of a marginal for a new span, with and without a linked mention
WHOLE = (0, 0, 16, 8)  # digits with which a token of each kind is whole
FIT_DOCS, FIT_TOKENS = 4000, 400


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches as the pattern defines them; searched only around each @, as a run of its first class may be long."""
    out, at = [], 0
    local = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
    sign = text.find("@")
    while sign >= 0:
        begin = sign
        while begin > at and text[begin - 1] in local:
            begin -= 1
        m = EMAIL.match(text, begin) if begin < sign else None
        if m:
            out.append(m.span())
            at = m.end()
            sign = text.find("@", at)
        else:
            sign = text.find("@", sign + 1)
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Matches of the ip pattern whose parts are at most 255. Read off runs of digits and dots part by part, as the
    expression itself would start anew at every digit of a long run."""
    out = []
    for m in _NUMBERS.finditer(text):
        if m[0].count(".") < 3:
            continue
        begin, four = m.start(), []
        for part in m[0].split("."):
            four = [*four, (begin, part)] if part else []
            if len(four) == 4:
                if all(len(p) <= 3 and int(p) <= 255 for p in (p.lstrip("0") or "0" for _, p in four)):
                    out.append((four[0][0], begin + len(part)))
                four = []
            begin += len(part) + 1
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; leftmost matches without overlap, failing ones dropped."""
    out = [(0, *s) for s in emails(text)] if "@" in text else []
    if not MAY_HOLD.search(text):
        return out
    out += [(1, *s) for s in addresses(text)]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# ---- the field


@lru_cache(100_000)
def _shape(token: str) -> tuple:
    """Features of a token: how many digits and letters, and its signs."""
    digits = "".join(c for c in token if c in "0123456789")
    return (
        ("digits", min(len(digits), 20)),
        ("letters", min(sum(c.isalpha() for c in token), 3)),
        ("at", "@" in token[1:-1]),
        ("dots", min(token.count("."), 4)),
        ("dashes", min(token.count("-"), 4)),
        ("plus", token.startswith("+")),
        ("bracket", "(" in token or ")" in token),
        ("luhn", 16 <= len(digits) <= 19 and luhn(digits)),
    )


def _tokens(text: str) -> list[tuple[int, int]]:
    """Runs of what is no white space that hold a digit or an @, without the punctuation around them."""
    out, at = [], 0
    while m := MAY_HOLD.search(text, at):
        a = m.start()
        while a > at and not text[a - 1].isspace():
            a -= 1
        b = at = _RUN.match(text, m.end()).end()
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        while b > a and not (text[b - 1].isalnum() or text[b - 1] == ")"):
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _key(token: str) -> str:
    return "".join(c for c in token.lower() if c.isalnum())


def _links(tokens: list[str], labels: list[int]) -> list[tuple[int, int]]:
    """Pairs of like mentions: all that are equal, and all number runs that end alike, each with one hub, which is the
    first of them with a base label, else the first."""
    like: dict[str, list[int]] = {}
    for i, t in enumerate(tokens):
        key = _key(t)
        digits = "".join(c for c in key if c.isdigit())
        if len(key) >= 5:
            like.setdefault(key, []).append(i)
        if len(digits) >= 7 and len(digits) >= len(key) - 1:
            like.setdefault("~" + digits[-7:], []).append(i)
    out = set()
    for same in like.values():
        hub = next((i for i in same if labels[i]), same[0])
        out |= {(min(i, hub), max(i, hub)) for i in same if i != hub}
    return sorted(out)


class SkipChain:
    """Weights of unary features, of consecutive labels and of linked mentions."""

    def __init__(self, unary: dict, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    def potentials(self, words: list[str], joined: list[bool]) -> np.ndarray:
        out = np.zeros((len(words), 5))
        for i, w in enumerate(words):
            for f in _features(w, words[i - 1] if i and joined[i] else None, words[i + 1] if i + 1 < len(words) and joined[i + 1] else None):
                v = self.unary.get(f)
                if v is not None:
                    out[i] += v
            shape = dict(_shape(w))
            if shape["digits"] >= WHOLE[2] and not shape["luhn"]:
                out[i, 3] -= 30  # a whole number that fails the check is no card
        return out

    def marginals(self, words: list[str], joined: list[bool], links: list[tuple[int, int]]) -> np.ndarray:
        """By loopy message passing over chain and skip links, sums along the chain and maxima along links; exact where
        there are no links."""
        own = self.potentials(words, joined)
        n = len(words)
        edges = [(i - 1, i, 0) for i in range(1, n) if joined[i]] + [(i, j, 1) for i, j in links if not (j == i + 1 and joined[j])]
        if not edges:
            return _normal(own)
        a, b, kind = (np.array(x) for x in zip(*edges, strict=True))
        tables = np.stack((self.chain, self.skip))[kind]
        source, target = np.concatenate((a, b)), np.concatenate((b, a))
        tables = np.concatenate((tables, tables.transpose(0, 2, 1)))
        back = np.concatenate((np.arange(len(a)) + len(a), np.arange(len(a))))
        skips = np.concatenate((kind, kind))[:, None] == 1
        messages = np.zeros((len(source), 5))
        for _ in range(ROUNDS):
            belief = own.copy()
            np.add.at(belief, target, messages)
            out = (belief[source] - messages[back])[:, :, None] + tables
            top = out.max(axis=1, keepdims=True)
            new = np.where(skips, top[:, 0], (top + np.log(np.exp(out - top).sum(axis=1, keepdims=True)))[:, 0])
            new -= new.max(axis=1, keepdims=True)
            if np.abs(new - messages).max() < 1e-4:
                break
            messages = 0.5 * messages + 0.5 * new
        belief = own.copy()
        np.add.at(belief, target, messages)
        return _normal(belief)


def _normal(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _features(word: str, before: str | None, after: str | None):
    own = _shape(word)
    yield from own
    yield ("both", own[0][1], own[3][1], own[1][1])
    yield ("bias",)
    for name, w in (("before", before), ("after", after)):
        yield (name, "none") if w is None else (name, *(x for _, x in _shape(w)[:2]))


class _Cover:
    """Whether a range touches any of some spans."""

    def __init__(self, spans):
        self.starts, self.ends, self.kinds = [], [], []
        for s, e, k in sorted(spans):
            if self.starts and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)
                self.kinds.append(k)

    def kind(self, a: int, b: int) -> int | None:
        i = bisect_right(self.starts, b - 1) - 1
        return self.kinds[i] if i >= 0 and self.ends[i] > a else None


def read(text: str):
    """Base spans; tokens (places, words, whether each is joined to the one before, links); their base labels, 0 for O."""
    base = base_spans(text)
    cover = _Cover((s, e, k + 1) for k, s, e in base)
    at = _tokens(text)
    words = [text[a:b] for a, b in at]
    joined = [i > 0 and at[i][0] - at[i - 1][1] <= NEAR for i in range(len(at))]
    labels = [cover.kind(a, b) or 0 for a, b in at]
    return base, at, words, joined, _links(words, labels), labels


def fit(samples: list, rounds: int = 8, rate: float = 0.3) -> SkipChain:
    """Weights from (words, joined, links, labels) of documents, by stochastic ascent on the pseudo-likelihood of each
    label given its neighbours' in chain and links. Links start at attracting equal labels, which is what they are for
    where base labels, the only ones there are, miss a mention."""
    unary: dict = {}
    chain, skip = np.zeros((5, 5)), np.diag([0.0, 6, 6, 6, 6])
    past = {"chain": np.full((5, 5), 0.1), "skip": np.full((5, 5), 10.0)}
    for _ in range(rounds):
        for words, joined, links, labels in samples:
            linked: dict[int, list[int]] = {}
            for i, j in links:
                linked.setdefault(i, []).append(j)
                linked.setdefault(j, []).append(i)
            for i, w in enumerate(words):
                if not labels[i] and any(labels[j] for j in linked.get(i, ())):
                    continue  # a mention that the patterns may have missed is no example of O
                before = i - 1 if joined[i] else None
                after = i + 1 if i + 1 < len(words) and joined[i + 1] else None
                features = list(_features(w, None if before is None else words[before], None if after is None else words[after]))
                x = sum((unary[f] for f in features if f in unary), np.zeros(5))
                x = x + (chain[labels[before]] if before is not None else 0) + (chain[:, labels[after]] if after is not None else 0)
                for j in linked.get(i, ()):
                    x = x + skip[labels[j]]
                p = np.exp(x - x.max())
                slope = -p / p.sum()
                slope[labels[i]] += 1
                for f in features:
                    if f not in unary:
                        unary[f], past[f] = np.zeros(5), np.full(5, 0.1)
                    past[f] += slope**2
                    unary[f] += rate * (slope / np.sqrt(past[f]) - 1e-2 * unary[f])
                if before is not None:
                    past["chain"][labels[before]] += slope**2
                    chain[labels[before]] += rate * slope / np.sqrt(past["chain"][labels[before]])
                for j in linked.get(i, ()):
                    past["skip"][labels[j]] += slope**2
                    skip[labels[j]] += rate * slope / np.sqrt(past["skip"][labels[j]])
    return SkipChain(unary, chain, (skip + skip.T) / 2)


def all_spans(text: str, field: SkipChain, threshold: float = THRESHOLD) -> tuple[list, list]:
    """Base spans, and base with added ones, both (kind, start, end) by kind and start.

    A token without a base label is added where the marginal of a kind reaches the threshold, a higher one if no other
    mention is linked to it. Neighbours of that kind join it unless it is whole by itself; what touches a base span is
    left.
    """
    if not MAY_HOLD.search(text):
        return [], []
    base, at, words, joined, links, labels = read(text)
    out = list(base)
    if not all(labels):
        p = field.marginals(words, joined, links)
        linked, cover = {i for pair in links for i in pair}, _Cover((s, e, k + 1) for k, s, e in base)
        need = np.array([threshold if i in linked else ALONE for i in range(len(words))])
        kinds = np.where(p.max(axis=1) >= need, p.argmax(axis=1), 0)
        i = 0
        while i < len(words):
            k = int(kinds[i])
            if labels[i] or not k:
                i += 1
                continue
            j = i
            while j + 1 < len(words) and joined[j + 1] and not labels[j + 1] and kinds[j + 1] == k and _shape(words[j])[0][1] < WHOLE[k - 1]:
                j += 1
            if cover.kind(at[i][0], at[j][1]) is None:
                out.append((k - 1, at[i][0], at[j][1]))
            i = j + 1
    return base, sorted(out)


def _said(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def fit_field(docs: DataFrame, limit: int = FIT_DOCS, id_col: str = "doc_id", text_col: str = "text") -> SkipChain:
    """A field from ``limit`` documents at most, the least by hash of the id, with FIT_TOKENS tokens at most each; their
    labels are those of the base patterns."""
    some = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("i")).orderBy(F.xxhash64("i"), "i").limit(limit).distinct()
    texts = docs.join(F.broadcast(some), F.col(id_col) == F.col("i"), "left_semi").select(F.col(text_col).alias("text"))  # limit rows at most

    def label(batches):
        import pyarrow as pa

        for b in batches:
            out = [read(t)[2:] for t in b.column(0).to_pylist() if t and MAY_HOLD.search(t)]
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(x) for x in out if x[0] and len(x[0]) <= FIT_TOKENS], pa.string())], names=["sample"])

    return fit([json.loads(s) for s in sorted(r["sample"] for r in texts.mapInArrow(label, "sample string").collect())])


def find(docs: DataFrame, field: SkipChain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone (base matches), base_sha256, spans, n_added.

    spans are "kind:start:end", by kind and start, comma-joined, in code points, the end exclusive; base_sha256 is the
    hash of the base spans so written. Whole texts are read; a null text counts as empty and has no spans. Repeated rows
    get a row each; further columns are ignored; an empty table gives an empty result.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [all_spans(t, field) if t else ([], []) for t in b.column(1).to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(4)]
            hashes = [hashlib.sha256(_said(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *counts, pa.array(hashes, pa.string()), pa.array([_said(s) for _, s in found], pa.string()), pa.array([len(s) - len(base) for base, s in found], pa.int64())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
            )

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
