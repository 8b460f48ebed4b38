"""Lines by slices equal lines at once, long chains equal short ones, and memory stays bounded."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from sedimenta.llm import quality

TEXTS = ["", "one line", "a\n\nb b b\na\n", "words and words, and 1 2 3\n" * 30 + "end", "x" * 3000, "é\n\n\nmany | bars | here\t\t\n" * 9, None, "last word word word word other"]


def some_field(seed=1):
    rng = np.random.default_rng(seed)
    return quality.Field(*(rng.normal(size=quality.N_FEATURES) for _ in range(3)), rng.normal(size=(2, 2)))


@pytest.mark.parametrize(("chunk", "lines", "slice_", "piece"), [(1, 1, 1, 1), (100, 7, 3, 10), (4 << 20, 100_000, 2, 64)])
def test_a_score_depends_on_the_text_alone(monkeypatch, chunk, lines, slice_, piece):
    whole = quality.text_scores(TEXTS, some_field())
    for name, value in (("CHUNK", chunk), ("CHUNK_LINES", lines), ("SLICE", slice_), ("PIECE", piece)):
        monkeypatch.setattr(quality, name, value)
    assert np.allclose(quality.text_scores(TEXTS, some_field()), whole, rtol=1e-5, atol=1e-7)
    assert np.allclose(quality.text_scores(TEXTS[::-1], some_field())[::-1], whole, rtol=1e-5, atol=1e-7)


def test_a_score_from_the_text_to_the_end_by_plain_python():
    """Features letter by letter, marginals by summing over all labellings."""
    field, text = some_field(3), "Good line, it is.\nx x x y\nx x x y\n|||"
    rows, seen = [], []
    before = "\n"
    for line in text.split("\n"):
        pairs = np.zeros((quality.N_KINDS, quality.N_KINDS))
        for c in line + "\n":
            pairs[quality._KINDS[ord(before)], quality._KINDS[ord(c)]] += 1
            before = c
        words, n = line.split(), len(line) + 1
        twice = sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words) if len(words) > 1 else 0
        again = 1 - len(set(words)) / len(words) if len(words) > 1 else 0
        rows.append([*np.sqrt(pairs.ravel() / n), 1, np.log1p(n) / 5, n < 20, line in seen, np.sqrt(twice), again])
        seen.append(line)
    x = np.array(rows)
    pull = x @ field.own
    pull[1:] += x[:-1] @ field.before
    pull[:-1] += x[1:] @ field.after
    total, good = 0, np.zeros(4)
    for labels in np.ndindex(2, 2, 2, 2):
        weight = np.exp(sum(p * y for p, y in zip(pull, labels, strict=True)) + sum(field.moves[a, b] for a, b in zip(labels, labels[1:], strict=False)))
        total += weight
        good += weight * np.array(labels)
    lengths = np.array([len(line) + 1 for line in text.split("\n")])
    assert np.isclose(quality.text_scores([text], field)[0], (good / total) @ lengths / lengths.sum(), rtol=1e-4)


def test_long_chains_equal_chains_in_step():
    rng = np.random.default_rng(0)
    for n in (1, 2, 500):
        pull, moves = rng.normal(size=n) * 4, rng.normal(size=(2, 2))
        assert np.allclose(quality.chain_marginals(pull, moves), quality.forward_backward(pull, np.array([n]), moves)[0])


def test_two_million_lines_under_a_gigabyte():
    code = """
import resource, numpy as np
from sedimenta.llm import quality
field = quality.Field(*(np.ones(quality.N_FEATURES) for _ in range(3)), np.zeros((2, 2)))
quality.text_scores(["".join(f"{i % 900001}\\n" for i in range(2_000_000))], field)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    found = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).resolve().parents[2], timeout=600)
    assert int(found.stdout) < 1000
