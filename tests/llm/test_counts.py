"""Top-k search, token counts, mixing and packing."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from sedimenta.llm import mixing, packing, tokens, topk
from sedimenta.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.frames import ROWS, SMALL, documents
from tests.oracle import spark_rows, sql_rows


def test_topk_equals_sql(spark):
    assert spark_rows(QUERIES["op1_topk"](spark, SMALL)) == sql_rows(ORACLE_SQL["op1_topk"])


@pytest.mark.parametrize("blocks", [(2048, 16_384), (2, 3)])
def test_topk_edge_cases(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", blocks[1])
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("rank", T.LongType()), T.StructField("v", T.StringType())])
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (50, [0.0, -1.0]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, [-1.0]), (4, None), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (None, [1.0, 1.0]), (8, []), (9, [0.25, 0.25]), (9, [2.0, 0.0]), (100, [1.0, 0.5])]
    found = sorted(map(tuple, topk.top_k(spark.createDataFrame([(*r, 1, "x") for r in rows], schema)).collect()))
    valid = [(i, [int(np.floor(256.0 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q in (0, 50, 100):
        vq = next(v for i, v in valid if i == q)
        best: dict = {}
        for i, v in valid:
            if i != q:
                best[i] = max(best.get(i, -(10**18)), sum(a * b for a, b in zip(vq, v, strict=False)))
        top = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5]
        want += [(q, r, i, s) for r, (i, s) in enumerate(top, 1)]
    assert found == sorted(want)
    assert topk.top_k(spark.createDataFrame([], schema)).count() == 0


ODD = ["", "a", "  x ", "It's don't '''ll 'S", "x<|endoftext|>y <|startoftext|>", "naïve ŠČ ß é É µ ² ½ ª", "日本語 テスト ١٢٣", "é Å", "\x1c a\x1db \x85 c", "a" * 3000, "!?" * 500, "1234567", "_a_b__", "ﬁ ﬁ", "İstanbul ſ K", "👍🏽👍", "a b c"]


def test_token_counts_equal_the_library(spark):
    count = tokens.counter()
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()] + ODD
    assert [count.count(t) for t in texts] == [len(count.library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_prefix_table_holds_every_prefix():
    count = tokens.counter()
    for word in ("unbelievablething", "thtionhea", "aaaaaaaa"):
        assert count.word_table(word) == [len(count.library.encode(word[:i], add_special_tokens=False).ids) for i in range(1, len(word) + 1)]
    text = "The quick brown foxes jumped, didn't they?"
    table = count.prefix_counts(text)
    assert table[-1] == count.count(text) and count.words_within(text, table[3]) == 4


@pytest.mark.parametrize("rows", [ROWS, [(i, t, "en", "a") for i, t in enumerate(ODD)]])
def test_token_counts_of_the_query_equal_the_library(spark, rows):
    library = tokens.counter().library
    found = tokens.token_counts(documents(spark, rows)).collect()
    size = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in found) == Counter((r[0], size(r[1])) for r in rows)


def test_token_counts_edge_cases(spark):
    found = tokens.token_counts(documents(spark)).collect()
    assert len(found) == len(ROWS)
    want = Counter((r[0], len((r[1] or "").encode())) for r in ROWS)
    assert Counter((r["doc_id"], r["n_bytes"]) for r in found) == want
    assert all((r["n_tokens"] > 2048) == r["over_limit"] for r in found) and any(r["over_limit"] for r in found)
    assert tokens.token_counts(documents(spark, [])).count() == 0


def _targets(sizes: dict):
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = {s for s in sizes if s not in fixed}
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("small", [True, False])
def test_mix_meets_its_targets(spark, small):
    docs = documents(spark) if small else spark.read.parquet(f"{SMALL}/documents.parquet")
    found = mixing.mix(docs).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in found:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = _targets(dict(sizes))
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 1
        assert all(r["source_size"] == sizes[s] for r in found if r["source"] == s)
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((r["doc_id"], len((r["text"] or "").encode().split())) for r in docs.collect())
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=repr) == sorted(map(tuple, found), key=repr)


def test_mixed_documents_hold_what_was_taken(spark):
    docs = documents(spark)
    rows = mixing.mixed_documents(docs)
    assert rows.columns == docs.columns
    want = Counter()
    for d, m in zip(sorted(docs.collect(), key=_identity), sorted(_with_texts(docs), key=_identity), strict=True):
        want[_identity(d)] += 1 if not m["size"] else (2 * m["taken"] + m["size"]) // (2 * m["size"])
    assert Counter(map(_identity, rows.collect())) == +want
    assert mixing.mix(documents(spark, [])).count() == 0 and mixing.mixed_documents(documents(spark, [])).count() == 0


def _identity(row):
    return str(row["doc_id"]), str(row["source"]), str(row["text"])


def _with_texts(docs):
    """What the mix takes of each row, beside its text; rows that agree in id, source and size are interchangeable here."""
    mixed = mixing.mix(docs).withColumnsRenamed({"doc_id": "i", "source": "s"})
    size = F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0))
    on = F.col("i").eqNullSafe(F.col("doc_id")) & F.col("s").eqNullSafe(F.col("source")) & (mixed["size"] == size)
    return docs.select("doc_id", "source", "text").distinct().join(mixed, on).collect()


def _check_packing(spark, docs):
    library = Tokenizer.from_file(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    found = packing.pack(docs).toPandas()
    want = Counter()
    for r in docs.collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or min(1024, len(ids))
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want.update((r["doc_id"], p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    ids = [None if x != x or x is None else int(x) for x in found["doc_id"].tolist()]
    assert Counter(zip(ids, found["piece"].tolist(), found["start"].tolist(), found["length"].tolist(), found["ids_crc32"].tolist(), strict=True)) == want
    placed = found.sort_values(["sequence_id", "offset"])
    end = placed.groupby("sequence_id")["length"].cumsum()
    assert (placed["offset"] == end - placed["length"]).all() and end.max() <= 1024
    return found


def test_packing_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_PIECES", 3)
    monkeypatch.setattr(packing, "PARTS", 5)
    _check_packing(spark, spark.read.parquet(f"{SMALL}/documents.parquet").repartition(7))


def test_inverse_needs_pivots():
    a = np.random.default_rng(0).integers(-3, 9, (30, 30)).astype(float)
    a[0, 0] = 0
    assert np.abs(packing._inverse(a) @ a - np.eye(30)).max() < 1e-9


def test_packing_round_trip(spark):
    found = _check_packing(spark, spark.read.parquet(f"{SMALL}/documents.parquet"))
    assert found["sequence_id"].nunique() <= 1.03 * -(-found["length"].sum() // 1024)


def test_packing_edge_cases(spark):
    _check_packing(spark, documents(spark))
    _check_packing(spark, documents(spark, [(i, t, "en", "a") for i, t in enumerate([*ODD, " " * 70_000 + "x", "<|endoftext|>" * 2000])]))
    assert packing.pack(documents(spark, [])).count() == 0


def test_plan_takes_every_piece_once():
    rng = np.random.default_rng(1)
    lengths = np.minimum(1024, np.maximum(1, rng.lognormal(6, 1.1, 50_000).astype(int)))
    histogram = {int(l): int(n) for l, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    plan, taken = packing.plan_sequences(histogram), Counter()
    for content, n in plan:
        assert sum(content) <= 1024 and n > 0
        for l in content:
            taken[l] += n
    assert taken == histogram
    assert sum(n for _, n in plan) <= 1.02 * lengths.sum() / 1024


def test_rows_without_an_id_are_dealt_apart(spark):
    """Many rows with a null id, or one and the same, fall into many parts, and the mix still meets its targets."""
    rows = [(None if i % 2 else 7, f"text number {i} " + "word " * (i % 5), "en", "ab"[i % 3 == 0]) for i in range(3000)]
    keyed = mixing._keyed(documents(spark, rows), 0, "doc_id", "text", "source")
    assert keyed.select("range", "part").distinct().count() > 2500
    for source, took, target in mixing.mix(documents(spark, rows)).groupBy("source").agg(F.sum("taken"), F.first("target")).collect():
        assert abs(took - target) <= 1, source
