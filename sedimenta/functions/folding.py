"""Texts as they are compared: Unicode compatibility form without case and without what has no width, and where each letter
of that form stands in the text."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

# Characters without width, which may stand within a word unseen.
NO_WIDTH = "­​‌‍⁠﻿"
#: A stretch that folding may change beyond case, with the letter before it, which marks may join.
_STRETCH = re.compile(r"[\x00-\x7f]?[^\x00-\x7f]+")
#: What belongs to the letter before it: combining marks, and vowels and finals of Hangul.
_JOINS = re.compile("[ᅠ-ᇿ]")


def _clusters(stretch: str) -> list[str]:
    """A stretch cut before each letter that begins anew."""
    out: list[str] = []
    for c in stretch:
        if out and (unicodedata.combining(c) or _JOINS.match(c)):
            out[-1] += c
        else:
            out.append(c)
    return out


def folded(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The folded text, and for each of its letters where its source begins and ends in the text.

    Letters that become several, or several that become one, share one source. Time and memory are linear in the text.
    """
    if text.isascii():
        places = np.arange(len(text))
        return text.lower(), places, places + 1
    parts, begins, ends, at = [], [], [], 0

    def plain(upto: int) -> None:
        parts.append(text[at:upto].lower())
        begins.append(np.arange(at, upto))
        ends.append(np.arange(at + 1, upto + 1))

    for m in _STRETCH.finditer(text):
        if m.start() > at:
            plain(m.start())
        place, own, first, last = m.start(), [], [], []
        for cluster in _clusters(m[0]):
            seen = cluster.translate(_GONE)
            form = unicodedata.normalize("NFKC", seen).casefold() if seen else ""
            own.append(form)
            first += [place] * len(form)
            last += [place + len(cluster)] * len(form)
            place += len(cluster)
        parts.append("".join(own))
        begins.append(np.array(first, np.int64))
        ends.append(np.array(last, np.int64))
        at = m.end()
    if at < len(text):
        plain(len(text))
    return "".join(parts), np.concatenate(begins), np.concatenate(ends)


_GONE = {ord(c): None for c in NO_WIDTH}
