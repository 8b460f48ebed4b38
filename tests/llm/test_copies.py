"""Exact and near duplicates against brute force."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sedimenta.llm import exact_dedup, simhash
from sedimenta.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.frames import ROWS, SMALL, documents
from tests.oracle import spark_rows, sql_rows


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=200))
def test_golomb_round_trip(values):
    values = np.sort(np.array(values, np.int64))
    code, k = exact_dedup.golomb_encode(values)
    assert (exact_dedup.golomb_decode(code, k, len(values)) == values).all()


def test_exact_duplicates_equal_sql(spark):
    assert spark_rows(QUERIES["op8_exact_dedup"](spark, SMALL)) == sql_rows(ORACLE_SQL["op8_exact_dedup"])


def test_exact_duplicates_edge_cases(spark):
    found = exact_dedup.exact_duplicates(documents(spark)).collect()
    want = []
    body = lambda t: (t or "").encode().lower()
    for i, t, *_ in ROWS:
        same = [r[0] for r in ROWS if body(r[1]) == body(t)]
        keep = max((x for x in same if x is not None), default=None)
        want.append((i, keep, len(same), i == keep, hashlib.sha256(body(t)).hexdigest()))
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    assert exact_dedup.exact_duplicates(documents(spark, [])).count() == 0


def test_small_owners_and_blocks(spark, monkeypatch):
    """Many owners and many senders give the same result."""
    monkeypatch.setattr(exact_dedup, "ROWS_PER_OWNER", 7)
    monkeypatch.setattr(exact_dedup, "BLOCK_ROWS", 5)
    assert spark_rows(QUERIES["op8_exact_dedup"](spark, SMALL)) == sql_rows(ORACLE_SQL["op8_exact_dedup"])


def _components(prints, ids):
    values = np.array(prints, np.uint64)
    label = np.arange(len(values))
    i, j = np.nonzero(np.bitwise_count(values[:, None] ^ values) <= 3)
    while True:
        before = label.copy()
        np.minimum.at(label, label[i], label[j])
        label = label[label]
        if (label == before).all():
            break
    return pd.Series(ids).groupby(label).transform("min").tolist()


def _plain_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    rows = [(r["doc_id"], _plain_fingerprint(r["text"])) for r in docs.collect()]
    want = _components([p for _, p in rows], [i for i, _ in rows])
    assert found == {i: (f"{p:016x}", c) for (i, p), c in zip(rows, want, strict=True)}


def test_near_duplicates_edge_cases(spark):
    found = simhash.near_duplicates(documents(spark)).collect()
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert len(found) == len(ROWS)
    assert by_id[3]["fingerprint"] == by_id[4]["fingerprint"] == by_id[5]["fingerprint"] == "0" * 16
    assert {by_id[i]["component_id"] for i in (3, 4, 5)} == {3} and {by_id[i]["component_id"] for i in (1, 2, 7)} == {1}
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_deep_tree_of_clustered_prints(spark):
    rng = np.random.default_rng(0)
    flip = lambda n: np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    prints = np.unique(np.concatenate([rng.integers(0, 2**64, 300, dtype=np.uint64), *(b ^ flip(30) ^ flip(30) for b in rng.integers(0, 2**63, 12, dtype=np.uint64))]))
    frame = spark.createDataFrame(pd.DataFrame({"print": prints.view(np.int64)}))
    found = {r["node"]: r["component"] for r in simhash.components(simhash.links(frame, leaf=32)).collect()}
    own = prints.view(np.int64).tolist()
    assert [found.get(p, p) for p in own] == _components(prints, own)


MIXED = [(1, "a", "en", "x"), (2, "a", "en", "x"), (1, "b", "en", "x"), (None, "c", "en", "x"), (3, "C", "en", "x"), (None, "d", "en", "x"), (None, "D", "en", "y"), (5, "e", "en", "x"), (5, "e", "en", "x"), (5, "e", "en", "z"), (6, "", "en", "x"), (7, None, "en", "x"), (None, None, None, None)]


@pytest.mark.parametrize("rows", [ROWS, MIXED, []])
def test_one_row_of_each_text_stays(spark, rows):
    found = [(r["doc_id"], r["text"]) for r in exact_dedup.without_exact_duplicates(documents(spark, rows)).collect()]
    body = lambda t: (t or "").encode().lower()
    keep = {}
    for i, t, *_ in rows:
        keep[body(t)] = max((x for x in (keep.get(body(t)), i) if x is not None), default=None)
    assert sorted(((i, body(t)) for i, t in found), key=repr) == sorted(((i, b) for b, i in keep.items()), key=repr)
    assert all((i, t) in [r[:2] for r in rows] for i, t in found)


@pytest.mark.parametrize("rows", [ROWS, MIXED, [(None, " ".join(f"w{i}" for i in range(60)), "en", "x")] * 3 + [(9, "one", "en", "x"), (9, "two three", "en", "x")], []])
def test_one_row_of_each_component_stays(spark, rows):
    found = [(r["doc_id"], r["text"]) for r in simhash.without_near_duplicates(documents(spark, rows)).collect()]
    prints = [_plain_fingerprint(t) for _, t, *_ in rows]
    label = _components(prints, list(range(len(rows)))) if rows else []
    groups = {}
    for (i, t, *_), p, c in zip(rows, prints, label, strict=True):
        groups.setdefault(c, []).append((i is None, i or 0, p, i, t))
    assert len(found) == len(groups)
    for members in groups.values():
        least = min(m[:2] for m in members)
        assert len([x for x in found if x in [m[3:] for m in members if m[:2] == least]]) >= 1


def test_bits_go_out_in_passes(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "PASS_BYTES", 200)
    monkeypatch.setattr(exact_dedup, "SENDER_ROWS", 20)
    monkeypatch.setattr(exact_dedup, "BLOCK_ROWS", 6)
    assert spark_rows(QUERIES["op8_exact_dedup"](spark, SMALL)) == sql_rows(ORACLE_SQL["op8_exact_dedup"])


@pytest.mark.parametrize("rows", [1000, 1 << 30, 1 << 45])
def test_linked_prints_agree_in_a_table(spark, rows, monkeypatch):
    """However many parts must agree, no link is lost; fingerprints with up to three flipped bits, and some with four."""
    tables = simhash.parts_of(rows, 3, simhash.LEAF)
    assert all(sum(w for _, w in parts) == 64 and len({s for s, _ in parts}) == len(parts) for _, parts in tables)
    monkeypatch.setattr(simhash, "parts_of", lambda *_: tables)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    flips = [sum(np.uint64(1) << np.uint64(b) for b in rng.choice(64, n, replace=False)) for n in (1, 2, 3, 3, 4)]
    prints = np.unique(np.concatenate([base, *(base ^ np.uint64(f) for f in flips)]))
    frame = spark.createDataFrame(pd.DataFrame({"print": prints.view(np.int64)}))
    found = {r["node"]: r["component"] for r in simhash.components(simhash.links(frame)).collect()}
    own = prints.view(np.int64).tolist()
    assert [found.get(p, p) for p in own] == _components(prints, own)
