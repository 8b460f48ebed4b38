"""Exact token counts of every prefix of a text by dynamic programming.

A sequence of byte-pair tokens is an encoding exactly if every two neighbours are the encoding of their concatenation
and every token is that of itself. So the last token of a prefix of a word is the one token that ends there and fits
the last token of the prefix before it, and a table filled from left to right has the encoding of all prefixes at once:
one number and one token for each. Words are independent, so the table of a text is the running sum of its words'.

Tables of words are kept for as long as the memory set aside for them lasts, then started anew.
"""

from __future__ import annotations

import json
import re
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY, LIMIT = "word_bpe_49k.json", 2048
#: Words, and pairs of tokens, remembered by a worker.
KEPT_WORDS, KEPT_PAIRS = 400_000, 1_000_000

_COUNTERS: dict = {}


class PrefixCounter:
    """Counts of a BPE vocabulary file of ``tokenizers`` whose words end in a suffix mark."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.mark = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        made = {left + right for left, right in merges}
        assert len(made) == len(merges), "a token is made by several merges"
        # numbers in the order in which tokens come to be: first those that no merge makes, then by rank
        self.ids = {t: i for i, t in enumerate([*(t for t in model["vocab"] if t not in made), *(a + b for a, b in merges)])}
        self.merges = {(self.ids[a], self.ids[b]): self.ids[a + b] for a, b in merges}
        self.halves = {t: pair for pair, t in self.merges.items()}
        self.longest = max(map(len, self.ids))
        # the 256 bytes as the printable characters that stand for them in the file: a fixed rule of byte-level BPE
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in kept]
        self.letters = str.maketrans({chr(b): chr(b) if b in kept else chr(256 + rest.index(b)) for b in range(256)})
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.first_of_special = special[0][:2] if special else "\0"
        # Where every character is plain Latin or common punctuation, lower-casing and this pattern cut words as the
        # library does; other texts are cut by the library.
        self.plain = re.compile(r"[\x00-\x08\x0e-\x1f\x7f-\xa0\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbeİ]|[^\x00-ſ‐-‧€]")
        self.word = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
        self.words: dict[str, int] = {}
        self.back = {ord(v): chr(k) for k, v in self.letters.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.selves: dict[int, bool] = {}

    def _fits(self, left: int, right: int, below: int = 1 << 60) -> bool:
        """Whether two encodings that meet here stay apart: of the tokens on either side of the border, from the whole
        ones down to single letters, no two are merged before they are themselves taken up by a merge."""
        merges, halves = self.merges, self.halves
        while True:
            if merges.get((left, right), below) < below:
                return False
            # go back to before the later of the two came to be
            if (left > right and left in halves) or right not in halves:
                if left not in halves:
                    return True
                below, left = left, halves[left][1]
            else:
                below, right = right + 1, halves[right][0]

    def _self(self, token: int) -> bool:
        """Whether a token is the encoding of its own letters."""
        ok = self.selves.get(token)
        if ok is None:
            pair = self.halves.get(token)
            ok = self.selves[token] = pair is None or (self._self(pair[0]) and self._self(pair[1]) and self._fits(*pair, below=token))
        return ok

    def word_table(self, letters: str, whole_only: bool = False) -> list[int]:
        """Token counts of the prefixes of a word (in the file's letters) of 1, 2, ... letters, each taken as a whole
        word; only of the word itself if ``whole_only``."""
        known, pairs, n = self.ids.get, self.pairs, len(letters)
        counts, ends, out = [0] * (n + 1), [-1] * (n + 1), []
        for i in range(1, n + 1):
            for mark in (self.mark, "") if self.mark else ("",):
                if (mark and whole_only and i < n) or (not mark and self.mark and i == n):
                    continue
                for j in range(max(0, i - self.longest), i):
                    token = known(letters[j:i] + mark if mark else letters[j:i])
                    if token is None or not self._self(token):
                        continue
                    if j:
                        pair = (ends[j], token)
                        fits = pairs.get(pair)
                        if fits is None:
                            if len(pairs) >= KEPT_PAIRS:
                                pairs.clear()
                            fits = pairs[pair] = self._fits(*pair)
                        if not fits:
                            continue
                    break
                else:
                    raise ValueError(f"no token ends {letters[:i]!r}")
                if mark or not self.mark:
                    out.append(counts[j] + 1)
                if not mark:
                    ends[i], counts[i] = token, counts[j] + 1
        return out

    def word_count(self, word: str) -> int:
        n = self.words.get(word)
        if n is None:
            if len(self.words) >= KEPT_WORDS:
                self.words.clear()
            letters = word if word.isascii() and word.isprintable() else word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
            n = self.words[word] = self.word_table(letters, True)[-1]
        return n

    def pieces(self, text: str) -> list[str | None]:
        """Words of a text as the library cuts them; None stands for a special string, a token by itself."""
        if self.special and self.first_of_special in text:
            found = list(self.special.finditer(text))
            if found:
                out, at = [], 0
                for m in found:
                    out += [*self.pieces(text[at : m.start()]), None]
                    at = m.end()
                return out + self.pieces(text[at:])
        if not self.plain.search(text):
            return self.word.findall(text.lower())
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [w.translate(self.back).encode("latin-1").decode() for w, _ in cut]

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        known, total = self.words.get, 0
        for w in self.pieces(text):
            n = 1 if w is None else known(w)
            total += self.word_count(w) if n is None else n
        return total

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of the prefixes of a text that end after each of its words."""
        return list(accumulate((1 if w is None else self.word_count(w) for w in self.pieces(text)), initial=0))[1:]

    def words_within(self, text: str, limit: int) -> int:
        """How many of the text's leading words fit in ``limit`` tokens."""
        from bisect import bisect_right

        return bisect_right(self.prefix_counts(text), limit)


def counter(vocabulary: str = VOCABULARY) -> PrefixCounter:
    """The counter of a vocabulary file, by name or path; one in each worker."""
    if vocabulary not in _COUNTERS:
        import public_tokenizers as P

        _COUNTERS[vocabulary] = PrefixCounter(vocabulary if "/" in vocabulary else P.path(vocabulary))
    return _COUNTERS[vocabulary]


def token_counts(docs: DataFrame, limit: int = LIMIT, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit, words_in_limit.

    words_in_limit: how many leading words of the text fit in ``limit`` tokens, read off the table of prefixes. A null
    text counts as empty: no bytes, no tokens. Whole texts are read, however long; repeated rows and null ids are rows
    like any others; further columns are ignored; an empty table gives an empty result.
    """

    def run(batches):
        import pyarrow as pa

        count = counter(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tables = [count.prefix_counts(t) for t in texts]
            from bisect import bisect_right

            tokens = [t[-1] if t else 0 for t in tables]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_()), pa.array([bisect_right(t, limit) for t in tables], pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "words_in_limit"],
            )

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, words_in_limit long"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
