"""Ranked lexical search against scores of every pair by plain Python, and the query against SQL."""

import math
import random
import re

import pytest

from sedimenta.llm import lexical
from sedimenta.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.frames import CLASHING, ROWS, SMALL, documents
from tests.oracle import spark_rows, sql_rows


def plain(docs, items, k):
    terms = lambda t: re.findall(lexical.TERM_PATTERN, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, terms(t)) for i, t, *_ in docs]
    n_docs, n_terms = sum(bool(t) for _, t in held), sum(len(t) for _, t in held)
    of_item = {}
    for item, text in items:
        of_item.setdefault(item, set()).update(terms(text))
    out = []
    for item, asked in of_item.items():
        scored = []
        for i, t in held:
            score = 0
            for x in asked & set(t):
                df = sum(x in u for _, u in held)
                measure = 10 + 90 * len(t) * n_docs // n_terms
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (10**9 * t.count(x) // (1000 * t.count(x) + 8 * measure))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank + 1, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def items_frame(spark, rows):
    return spark.createDataFrame([(*r, *(["x"] * len(CLASHING))) for r in rows], "item_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING))


ITEMS = [(1, "hello WORLD, of text"), (2, None), (3, ""), (4, "straße あい 🙂 ٣ äÖ"), (5, "nowhere-else"), (6, "word"), (7, "no"), (7, "id here"), (None, "one hello"), (8, "555-7713 +1 doe")]


@pytest.mark.parametrize(("block", "passes"), [(16_384, False), (2, True)])
def test_edge_cases(spark, monkeypatch, block, passes):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
    if passes:
        monkeypatch.setattr(lexical, "ITEM_BLOCK", 2)
        monkeypatch.setattr(lexical, "PASS_BYTES", 300)
    for k in (2, 10):
        found = lexical.search(documents(spark), items_frame(spark, ITEMS), k)
        assert sorted(map(tuple, found.collect()), key=repr) == plain(ROWS, ITEMS, k)


def test_empty_tables(spark):
    assert lexical.search(documents(spark, []), items_frame(spark, ITEMS)).count() == 0
    assert lexical.search(documents(spark), items_frame(spark, [])).count() == 0
    assert lexical.search(documents(spark, [(1, " .,", "en", "a")]), items_frame(spark, ITEMS)).count() == 0


def test_threshold_stops_early_and_keeps_ties():
    rng = random.Random(5)
    words = [f"w{i}".encode() for i in range(60)]
    texts = [[rng.choice(words[: rng.choice([3, 60])]) for _ in range(rng.randrange(0, 30))] for _ in range(3000)]
    ids = list(range(3000))
    rng.shuffle(ids)
    names = [c.split()[0] for c in lexical.BLOCK.split(", ")]
    block = dict(zip(names, lexical._block(ids, texts, None), strict=True))
    searcher = lexical.Searcher(block, block["n_docs"], block["n_terms"])
    looked = []
    whole = searcher.scores
    searcher.scores = lambda docs: (looked.append(len(docs)), whole(docs))[1]
    for terms, weights in [(["w1", "w30"], [5, 900]), (["w59"], [7]), (["w0", "w1", "w2"], [1, 1, 1]), (["absent"], [3]), (["w4"], [0])]:
        found, scores = searcher.best(terms, weights, 10)
        every = []
        for i, t in zip(ids, texts, strict=True):
            measure = 10 + 90 * len(t) * block["n_docs"] // block["n_terms"]
            tf = [t.count(x.encode()) for x in terms]
            s = sum(w * (10**9 * f // (1000 * f + 8 * measure)) for w, f in zip(weights, tf, strict=True) if f)
            every += [(-s, i)] if s else []
        assert [(-s, int(searcher.ids[d])) for s, d in zip(scores, found, strict=True)] == sorted(every)[:10]
    assert sum(looked) < 3 * 3000  # not every document of every item was looked at


def test_query_equals_sql(spark):
    assert spark_rows(QUERIES["op13_lexical"](spark, SMALL)) == sql_rows(ORACLE_SQL["op13_lexical"])
