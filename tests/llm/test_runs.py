"""Periodic runs against a plain search of every period, and the query against SQL."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sedimenta.llm import runs
from sedimenta.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.frames import ROWS, SMALL, documents
from tests.oracle import spark_rows, sql_rows


def plain(words, least, times):
    """Every period in turn: maximal stretches that equal themselves one period later."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@st.composite
def looping_words(draw):
    words = draw(st.lists(st.integers(0, draw(st.sampled_from([0, 1, 2, 40]))), max_size=120))
    for _ in range(draw(st.integers(0, 2))):
        if len(words) > 6:
            p, start = draw(st.integers(1, len(words) // 3)), draw(st.integers(0, len(words) - 3))
            for i in range(start + p, min(len(words), start + draw(st.integers(p, 3 * p + 40)))):
                words[i] = words[i - p]
    return words


@settings(max_examples=400, deadline=None)
@given(looping_words(), st.sampled_from([(24, 3), (6, 2), (4, 2), (10, 3), (12, 5)]))
def test_runs_equal_plain_search(words, bounds):
    least, times = bounds
    array = np.array(words, np.int64)
    keep = runs.covered(array, np.zeros(len(words), np.int64), runs.least_overlap(least, times))
    assert runs.runs_of(array, keep, least, times) == plain(words, least, times)


@pytest.mark.parametrize(("least", "times", "k"), [(24, 3, 16), (6, 2, 3), (2, 2, 1), (10, 5, 8)])
def test_least_overlap(least, times, k):
    assert runs.least_overlap(least, times) == k
    assert all(max(least, times * q) - q >= k for q in range(1, 200))


def test_masking_never_crosses_documents():
    """Two documents with the same words have no repeated gram of their own."""
    words = np.tile(np.arange(40), 2)
    assert not runs.covered(words, np.repeat([0, 1], 40), 16).any()
    assert runs.covered(words, np.zeros(80, np.int64), 16).all()


def test_query_equals_sql(spark):
    assert spark_rows(QUERIES["op11_periodic_runs"](spark, SMALL)) == sql_rows(ORACLE_SQL["op11_periodic_runs"])


def test_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(runs, "SLICE_BYTES", 64)
    found = runs.periodic_runs(documents(spark)).collect()
    want = []
    for i, text, *_ in ROWS:
        words = (text or "").encode().split()
        spans = plain(words, 24, 3)
        stays = [w for j, w in enumerate(words) if not any(s + q <= j < s + n for s, n, q in spans)]
        want.append((i, len(words), spans, b" ".join(stays).decode()))
    assert sorted([(r[0], r[1], [tuple(x) for x in r[2]], r[3]) for r in found], key=repr) == sorted(want, key=repr)
    assert runs.periodic_runs(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(documents(spark), times=1)


def test_best_run_by_exact_fraction_then_place(spark):
    a, b, c = "a b c d e f g h", "x y z", "p q"
    rows = [(1, f"{' '.join([a] * 3)} , {' '.join([b] * 9)} ! {' '.join([b] * 9)}", "en", "s"), (2, f"{' '.join([b] * 9)} {' '.join([c] * 14)}", "en", "s"), (None, " ".join([c] * 12), None, None)]
    found = {r["doc_id"]: r for r in runs.digests(runs.periodic_runs(documents(spark, rows))).collect()}
    assert (found[1]["n_runs"], found[1]["start"], found[1]["length"], found[1]["period"], found[1]["exponent_milli"]) == (3, 25, 27, 3, 9000)
    assert (found[2]["n_runs"], found[2]["start"], found[2]["period"], found[2]["exponent_milli"]) == (2, 27, 2, 14000)
    assert found[None]["collapsed_sha256"] == hashlib.sha256(b"p q").hexdigest()
    assert found[None]["runs_sha256"] == hashlib.sha256(b"0,24,2\n").hexdigest()
