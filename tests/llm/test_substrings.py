"""Repeated substrings against a plain table of every window."""

import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sedimenta.llm import substrings
from sedimenta.llm.queries import QUERIES
from tests.llm.frames import ROWS, SMALL, documents

LETTERS = st.binary(max_size=120) | st.lists(st.sampled_from([97, 98, 0, 255]), max_size=150).map(bytes)


def plain(rows, length):
    """(doc_id, n_bytes, n_removed, n_spans, kept) with every window of every text in one table."""
    bodies = [(t or "").encode() for _, t, *_ in rows]
    seen = {}
    for b in bodies:
        for i in range(len(b) - length + 1):
            w = hashlib.blake2b(b[i : i + length], digest_size=16).digest()
            seen[w] = seen.get(w, 0) + 1
    out = []
    for (doc_id, *_), b in zip(rows, bodies, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[hashlib.blake2b(b[i : i + length], digest_size=16).digest()] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((doc_id, len(b), sum(gone), sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone)), kept))
    return sorted(out, key=repr)


@settings(max_examples=300, deadline=None)
@given(LETTERS, st.integers(1, 4))
def test_suffix_array_and_common_prefixes(text, times):
    text *= times
    t = np.frombuffer(text, np.uint8)
    order = substrings.suffix_array(t)
    want = sorted(range(len(text)), key=lambda i: text[i:])
    assert order.tolist() == want
    if 255 in text:
        return  # no letter of UTF-8
    shared = []
    for a, b in zip([None, *want], want, strict=False):
        n = 0
        while a is not None and max(a, b) + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        shared.append(n)
    assert substrings.common_prefixes(t, order).tolist() == shared


@pytest.mark.parametrize("piece", [1 << 18, 700])
def test_equal_windows_have_equal_anchors(monkeypatch, piece):
    """Each window has one anchor, the same number of bytes from its start wherever the window is."""
    monkeypatch.setattr(substrings, "PIECE", piece)
    substrings._tables.cache_clear()
    rng = random.Random(2)
    part = bytes(rng.choice(b"abcdef ") for _ in range(900))
    texts = [part[:300] + part, bytes(rng.choice(b"xyz") for _ in range(400)) + part[100:], part[:59], b"", b"a" * 500, b"ab" * 300]
    whole, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    firsts, lasts, hashes = substrings.anchors(whole, ends, 60, 15)
    starts = [i for end, t in zip(ends.tolist(), texts, strict=True) for i in range(end - len(t), end - 60 + 1)]
    assert [i for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True) for i in range(a, b + 1)] == starts
    of = {}
    for a, b, h in zip(firsts.tolist(), lasts.tolist(), hashes.tolist(), strict=True):
        for i in range(a, b + 1):
            of.setdefault(whole[i : i + 60].tobytes(), set()).add(h)
    assert max(map(len, of.values())) == 1
    substrings._tables.cache_clear()


def some_rows(rng):
    """Texts with shared passages, some of them in many texts, loops, copies and letters of several bytes."""
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 6)))
    passage = lambda n: " ".join(word() for _ in range(n))
    shared = [passage(rng.randrange(10, 60)) for _ in range(4)]
    rows = [(i, " ".join(rng.choice([passage(rng.randrange(0, 12)), shared[0], rng.choice(shared)]) for _ in range(rng.randrange(0, 5))), "en", "s") for i in range(150)]
    return [*rows, (200, "x" * 700, None, None), (201, "xy" * 200, None, None), (202, rows[3][1], "en", "s"), (203, None, "en", "s"), (None, shared[0], "en", "s"), (204, "\x00" * 90, "en", "s")]


@pytest.mark.parametrize(("length", "shard", "owner", "sent"), [(40, 1 << 20, 1_000_000, 1 << 25), (40, 600, 50, 0), (64, 2000, 7, 1 << 25)])
def test_equals_plain_table(spark, monkeypatch, length, shard, owner, sent):
    """In shards and blocks so small that a passage's edges fill many of them, with and without broadcasts."""
    for name, value in (("SHARD_BYTES", shard), ("OWNER_DIGESTS", owner), ("BROADCAST_BYTES", sent), ("BLOCK_BYTES", 3000), ("TASK_BYTES", 5000)):
        monkeypatch.setattr(substrings, name, value)
    rows = some_rows(random.Random(length + shard))
    found = substrings.repeated_substrings(documents(spark, rows), length)
    assert sorted([(*r[:4], bytes(r[4])) for r in found.collect()], key=repr) == plain(rows, length)


def test_edge_cases(spark):
    found = substrings.repeated_substrings(documents(spark), 16)
    assert sorted([(*r[:4], bytes(r[4])) for r in found.collect()], key=repr) == plain(ROWS, 16)
    assert substrings.repeated_substrings(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        substrings.repeated_substrings(documents(spark), 3)


def test_query_equals_plain_table(spark):
    t = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    want = [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in plain(list(zip(t["doc_id"], t["text"], strict=True)), 400)]
    assert sorted(map(tuple, QUERIES["op12_substrings"](spark, SMALL).collect()), key=repr) == sorted(want, key=repr)
