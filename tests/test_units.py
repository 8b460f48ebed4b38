"""Parts that no query shows: dialects, readers, edge cases of plans and streams."""

import functools
import hashlib
import json
import random
import time
from decimal import Decimal, localcontext
from fractions import Fraction
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta import queries
from sedimenta.functions import folding, forms
from sedimenta.functions import normalize as N
from sedimenta.functions import text as X
from sedimenta.operators import matching, physical, profile, rules, schema, structure
from sedimenta.plans import load, parse, records
from sedimenta.sources import charsets, files, tables
from sedimenta.sources.dialect import detect
from sedimenta.sources.shared import shared_dir, tidied
from sedimenta.streaming import streams
from tests.oracle import SMALL, rows_of, spark_rows


def test_dialects():
    assert detect(["a,b,c", "1,2,3", '4,"5,6",7']).delimiter == ","
    assert detect(["a;b", "1,5;2", "3;4,5"]).delimiter == ";"
    assert detect(["one", "two"]) is None and detect(["a,b;c", "1,2;3"]) is None
    assert detect(["a|b", "1|2"]).confidence == pytest.approx(0.9)


def test_readers(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,text\n1,"a\nb"\n2,"say ""hi"""\n')
    assert [tuple(r) for r in tables.delimited(spark, str(tmp_path / "t.csv")).collect()] == [("1", "a\nb"), ("2", 'say "hi"')]
    (tmp_path / "t.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert [r["a"] for r in tables.json_lines(spark, str(tmp_path / "t.jsonl")).orderBy("a").collect()] == [1, 2]
    (tmp_path / "t.txt").write_bytes(b"x\r\ny\n\nz")
    found = files.artifacts(spark, str(tmp_path / "t.txt"), 7).first()
    with pytest.raises(Exception, match="too large"):
        files.artifacts(spark, str(tmp_path / "t.txt"), 6).collect()
    assert found["length"] == 7 and found["sha256"] == hashlib.sha256(b"x\r\ny\n\nz").hexdigest()


@pytest.mark.parametrize("split", [7, 1 << 20])
def test_physical_lines_keep_their_ends(spark, tmp_path, split):
    """Whatever the splits, lines and ends make up each file again, in order."""
    texts = {"a": "x\r\ny\n\nz", "b": "\r\r\n\n", "c": "one\rtwo\r", "d": "last\n", "e": "long line of text\nand more of it\r\nend\r"}
    for name, t in texts.items():
        (tmp_path / f"{name}.txt").write_bytes(t.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = files.physical_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, t in texts.items():
        mine = sorted((r["line_no"], r["line"], r["terminator"]) for r in rows if r["path"].endswith(f"/{name}.txt"))
        assert [n for n, *_ in mine] == list(range(len(mine))) and "".join(a + b for _, a, b in mine) == t


def test_trees(spark):
    docs = spark.createDataFrame([(1, '{"a": [1, 2.50], "a": null, "b/c": {"x": true}}'), (2, "{bad"), (3, None)], "id int, t string")
    found = [(r["key"], r["path"], r["kind"], r["value"], r["occurrence"]) for r in files.nodes(docs, "id", "t", "json").orderBy("key", "ordinal").collect()]
    assert found == [(1, "", "object", None, 0), (1, "/a", "array", None, 0), (1, "/a/0", "integer", "1", 0), (1, "/a/1", "decimal", "2.50", 0), (1, "/a#1", "null", None, 1), (1, "/b~1c", "object", None, 0), (1, "/b~1c/x", "boolean", "true", 0), (2, "", "malformed", "JSONDecodeError", 0)]
    docs = spark.createDataFrame([(1, '<a xmlns="u"><b i="1">x</b><b/>tail</a>'), (2, '<!DOCTYPE a [<!ENTITY e "x">]><a>&e;</a>'), (3, "<a>")], "id int, t string")
    found = [(r["key"], r["path"], r["kind"], r["value"]) for r in files.nodes(docs, "id", "t", "xml").orderBy("key", "ordinal").collect()]
    assert found == [(1, "/a[1]", "element", None), (1, "/a[1]/b[1]", "element", None), (1, "/a[1]/b[1]/@i", "attribute", "1"), (1, "/a[1]/b[1]/text()[1]", "text", "x"), (1, "/a[1]/b[2]", "element", None), (1, "/a[1]/text()[1]", "text", "tail"), (2, "", "malformed", "ValueError"), (3, "", "malformed", "ExpatError")]
    docs = spark.createDataFrame([(1, "<p>a<b>c</p><script>x</script>")], "id int, t string")
    found = [(r["path"], r["kind"]) for r in files.nodes(docs, "id", "t", "html").orderBy("ordinal").collect()]
    assert found == [("/p:nth-child(1)", "element"), ("/p:nth-child(1)/text()[1]", "text"), ("/p:nth-child(1)/b:nth-child(1)", "element"), ("/p:nth-child(1)/b:nth-child(1)/text()[1]", "text"), ("/script:nth-child(2)", "active"), ("/script:nth-child(2)/text()[1]", "active")]


@pytest.mark.parametrize("parts", [1, 4])
def test_sketch_estimates_within_its_error(spark, parts):
    df = spark.range(0, 20_000, 1, parts).select((F.col("id") % 9000).alias("a"), (F.col("id") % 50).alias("b"))
    found = {r["field"]: r for r in profile.distinct_sketch(df, ["a", "b"], 512).collect()}
    assert found["b"]["estimate"] == 50 and found["b"]["kept"] == 50
    assert abs(found["a"]["estimate"] - 9000) < 9000 * 0.2


def test_unique_by_null_policies(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None)], "id int, k string")
    count = lambda nulls: {r["id"]: r["dup_count"] for r in rules.unique_by(df, ["k"], nulls=nulls).collect()}
    assert count("distinct") == {1: 2, 2: 2, 3: 1, 4: 1} and count("equal") == {1: 2, 2: 2, 3: 2, 4: 2} and count("reject") == {1: 2, 2: 2, 3: None, 4: None}


def test_missing_cells_are_told_from_nulls(spark):
    df = spark.createDataFrame([(1, 1, 2, True), (2, None, 2, True), (3, None, 2, False)], "id int, a int, b int, there boolean")
    rows = df.select("id", rules.compare("lt", F.col("a"), F.col("b"), present=F.col("there")).alias("c")).orderBy("id").collect()
    assert [(r["c"]["outcome"], r["c"]["code"]) for r in rows] == [("pass", None), ("indeterminate", "RULE_NULL_OPERAND"), ("indeterminate", "RULE_MISSING_OPERAND")]


def test_poisoned_sums_are_indeterminate(spark):
    parents = spark.createDataFrame([(1, "6.00"), (2, "1.00"), (3, "0.00")], "id int, total string").withColumn("total", F.col("total").cast("decimal(18,4)"))
    children = spark.createDataFrame([(1, 2.0, 3.0), (2, None, 1.0), (2, 1.0, 1.0)], "pid int, a double, b double")
    found = rules.sum_equals(parents, children, "id", "pid", F.col("total"), ["a", "b"]).orderBy("id").collect()
    assert [r["check"]["outcome"] for r in found] == ["pass", "indeterminate", "pass"]


def test_rejection_spreads_along_chains(spark):
    for length in (6, 40):
        edges = spark.createDataFrame([(i, i + 1) for i in range(length)] + [(100, 101)], "a int, b int")
        found = load.rejection_closure(edges, spark.createDataFrame([(3,), (200,)], "n int")).collect()
        assert sorted(r["node"] for r in found) == [*range(length + 1), 200] and {r["node"] for r in found if r["direct"]} == {3, 200}


def test_load_order_and_cycles():
    assert load.load_order(["b", "a", "c"], [("c", "a"), ("a", "b")]) == ["c", "a", "b"]
    assert load.load_order(["a", "b"], [("a", "b"), ("b", "a")]) is None and load.load_order(["a"], [("a", "a")]) is None


def test_required_cells_raise(spark):
    cells = spark.createDataFrame([(0, 0, "x"), (1, 1, "y")], "row_index int, column_index int, value string")
    with pytest.raises(Exception, match="row without a"):
        parse.tabular(cells, parse.TabularPlan({"a": 0}, 0, required=("a",))).collect()


def test_redaction_keeps_equal_values_equal(spark):
    df = spark.createDataFrame([("mail a.b@c.org, again a.b@c.org; token = \"0123456789abcdef\"",)], "t string")
    out = df.select(X.redacted(F.col("t")).alias("t")).first()["t"]
    assert "a.b@c.org" not in out and out.count("[email:") == 2


def test_spans_equal_regular_expressions(spark):
    """Personal and secret spans of all documents and some odd texts against the patterns, run one after the other."""
    import regex

    odd = ["-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY----- tail", "-----BEGIN PRIVATE KEY----- no end", "Authorization: Bearer abc.def;x", "pwd='a\\'b' token", "ftp://u:p@host/x y://z@", "sk-" + "a" * 20 + " sk-short", "eyJabcd.efgh.ijkl eyJa.b.c", "🙂 a.b@c.org 🙂 7707083893 112-233-445 95 45 10 123456", "4111-1111-1111-1111 +1 (555) 123-45-67", None, ""]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("text").union(spark.createDataFrame([(t,) for t in odd], "text string"))
    for r in docs.select("text", X.all_spans(F.col("text")).alias("s")).collect():
        text, want = r["text"], []
        for k, p in (X.PERSONAL | X.SECRETS).items():
            for m in regex.finditer(p, text or ""):
                start, end, value = *m.span(), m[0]
                digits = regex.sub("[^0-9]", "", value)
                if k in X._BEFORE:
                    start += regex.match(X._BEFORE[k], value).end()
                fine = start < end
                if k == "card":
                    total = sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 * (int(c) > 4)) for i, c in enumerate(reversed(digits)))
                    fine = 13 <= len(digits) <= 19 and len(set(digits)) > 1 and total % 10 == 0
                elif k == "inn":
                    check = lambda w: sum(int(c) * x for c, x in zip(value, w, strict=False)) % 11 % 10
                    ten, w = (2, 4, 10, 3, 5, 9, 4, 6, 8), (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
                    fine = check(ten) == int(value[9]) if len(value) == 10 else check(w[1:]) == int(value[10]) and check(w) == int(value[11])
                elif k == "phone":
                    fine = value.startswith("+") or len(digits) >= 10
                if fine:
                    want.append((start, end, k))
        assert [(s["start"], s["end"], s["category"]) for s in r["s"] or ()] == sorted(want), text


def test_masks_of_overlapping_spans(spark):
    df = spark.createDataFrame([(1, "4111 1111 1111 1111 and a@b.org, a@b.org"), (2, None), (3, "nothing")], "id int, t string")
    masked = df.withColumn("t", X.redacted(F.col("t"), "salt"))
    out = {r["id"]: r["t"] for r in masked.collect()}
    assert out[2] is None and out[3] == "nothing" and "1111" not in out[1] and out[1].count("[email:") == 2
    assert sorted(map(tuple, X.restored(masked, X.placeholders(df, "id", "t", "salt"), "id", "t").collect())) == sorted(map(tuple, df.collect()))


def test_patterns_run_once(spark, tmp_path):
    """Each pattern goes over a text once; the letter that marks matches may be in the text; rows of one key stay apart."""
    df = spark.createDataFrame([("a\x1fb.c@d.org\x1f pwd=1\x1f2 +49 30 1234567",)], "t string")
    out = df.select(X.redacted(F.col("t")).alias("t"), X.all_spans(F.col("t")).alias("s"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 2 * len(X.PERSONAL | X.SECRETS)
    assert [(s["category"], s["start"], s["end"]) for s in out.first()["s"]] == [("email", 2, 11), ("assignment", 17, 20), ("phone", 21, 35)]
    assert X.restored(df.select(F.lit(1).alias("id"), X.redacted(F.col("t")).alias("t")), X.placeholders(df.withColumn("id", F.lit(1)), "id", "t"), "id", "t").first()["t"] == df.first()["t"]
    spark.createDataFrame([(7,), (7,), (8,)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    found = queries.QUERIES["sensitive_masked"](spark, str(tmp_path)).collect()
    assert sorted(r["c_custkey"] for r in found) == [7, 7, 8] and all(r["restored"] for r in found)


def test_numbers_that_do_not_fit(spark):
    from sedimenta.operators import constraints

    df = spark.createDataFrame([(999.994999,), (1e31,), (float("nan"),), (None,), (12.5,), (-1000.0,)], "x double")
    assert [r[0] for r in df.select(constraints.out_of_range(F.col("x"), 5, 2)).collect()] == ["DB_NUMERIC_SCALE", "DB_NUMERIC_RANGE", "DB_NUMERIC_RANGE", None, None, "DB_NUMERIC_RANGE"]
    parents = spark.createDataFrame([(1, "0.25"), (2, "0"), (3, "0")], "id int, total string").withColumn("total", F.col("total").cast("decimal(18,4)"))
    children = spark.createDataFrame([(1, 0.125, 2.0, 1.0), (2, 1e12, 1e12, 1e12)], "pid int, a double, b double, c double")
    found = {r["id"]: (r["check"]["outcome"], r["check"]["code"]) for r in rules.sum_equals(parents, children, "id", "pid", F.col("total"), ["a", "b", "c"]).collect()}
    assert found == {1: ("pass", None), 2: ("indeterminate", "RULE_NUMERIC_RANGE"), 3: ("pass", None)}


def test_upsert_takes_one_row_of_an_identity(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    incoming = spark.createDataFrame([(2, "x"), (2, "y"), (None, "n"), (None, "m")], "id int, v string")
    assert sorted(map(tuple, load.merged(stored, incoming, ["id"]).collect()), key=repr) == sorted([(1, "a"), (2, "y"), (None, "n")], key=repr)


def test_names(spark):
    pairs = [("customerName", "customer_name"), ("order_date", "order_date"), ("quantity", "quantiy"), ("id", "code")]
    found = matching.candidates(spark.createDataFrame([(a,) for a, _ in pairs], "source string"), spark.createDataFrame([(b,) for _, b in pairs], "target string"))
    score = {(r["source"], r["target"]): r["score"] for r in found.collect()}
    assert score["customerName", "customer_name"] == 0.98 and score["order_date", "order_date"] == 1.0 and 0.7 < score["quantity", "quantiy"] < 0.9


def test_ranking_equals_brute_force(spark):
    names = ["quantity", "cuantity", "order_date", "ab", "aB", "__", "--", "id", "customerName", "xame", "name", "zustomername", "total_price", "priceTotal", "fabcdefgh", "abcdefghi"]
    left, right = (spark.createDataFrame([(n,) for n in names], f"{side} string") for side in ("source", "target"))
    every = left.crossJoin(right).withColumn("score", matching.similarity(F.col("source"), F.col("target")))
    rows = lambda df: sorted(map(tuple, df.select("source", "target", "score", "rank", "gap", "status").collect()))
    found = rows(matching.best_matches(matching.candidates(left, right)))
    assert found == rows(matching.best_matches(every)) and len(found) == 3 * len(names)
    assert ("quantity", "cuantity", 0.7875, 2, "review") in {(a, b, s, r, t) for a, b, s, r, _, t in found}


def test_trim_takes_unicode_space(spark):
    assert spark.createDataFrame([("  x ",)], "t string").select(N.trim(F.col("t"))).first()[0] == "x"


def test_first_seen_rows(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 00:00:00", 1), ("2024-01-01 00:10:00", 1), ("2024-01-01 00:20:00", 2)], "t string, k int").withColumn("t", F.col("t").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    found = streams.run_to_table(streams.first_seen(streams.events_stream(spark, str(tmp_path / "in")), "t", ["k"]), "append")
    assert sorted(r["k"] for r in found.collect()) == [1, 2]


def _packed(sizes, budget, overlap):
    """What chunks must be, by the rule: fill, then begin with the last ones as far as they leave room."""
    out, held, fresh = [], [], False
    for at, n in enumerate(sizes):
        if held and sum(sizes[i] for i in held) + n > budget:
            if fresh:
                out.append(held)
            held, fresh = held[len(held) - overlap :] if overlap else [], False
            while held and sum(sizes[i] for i in held) + n > budget:
                held = held[1:]
        held, fresh = [*held, at], True
    return [(c[0], c[-1], sum(sizes[i] for i in c)) for c in ([*out, held] if fresh else out)]


@pytest.mark.parametrize("overlap", [0, 1, 3])
def test_chunks_equal_the_rule(spark, overlap):
    rng = random.Random(1)
    docs = {i: [rng.randint(0, 60) for _ in range(rng.randint(1, 40))] for i in range(12)}
    rows = spark.createDataFrame([(i, j, "x" * n) for i, sizes in docs.items() for j, n in enumerate(sizes)], "id int, line_no int, line string")
    found = structure.chunks(rows, 100, overlap).orderBy("id", "chunk").collect()
    for i, sizes in docs.items():
        assert [(r["first"], r["last"], r["bytes"]) for r in found if r["id"] == i] == _packed(sizes, 100, overlap)


def test_name_distances_equal_their_definition():
    @functools.cache
    def steps(a, b):
        if not a or not b:
            return len(a) + len(b)
        best = min(steps(a[:-1], b) + 1, steps(a, b[:-1]) + 1, steps(a[:-1], b[:-1]) + (a[-1] != b[-1]))
        if len(a) > 1 and len(b) > 1 and a[-1] == b[-2] and a[-2] == b[-1]:
            best = min(best, steps(a[:-2], b[:-2]) + 1)
        return best

    rng = random.Random(2)
    pairs = [["".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(2)] for _ in range(2000)] + [["", ""], ["ab", "ba"], ["żółw", "żóław"]]
    for most in (1, 3):
        assert forms.band_distances(*map(list, zip(*pairs, strict=True)), most).tolist() == [min(most + 1, steps(a, b)) for a, b in pairs]
    assert forms.band_distances([], []).tolist() == []


#: Pairs of names, and how alike they are: exact, normalized, compact, token, transliterated, edit, alias.
NAMES = [
    ("customerName", "customer_name", 0, 0.98, 0.95, 0.9, 0, 0, 0), ("order_id", "order_id", 1, 0.98, 0.95, 0.9, 0, 0, 0), ("OrderDate", "orderdate", 0, 0, 0.95, 0, 0, 0, 0), ("quantity", "quanttiy", 0, 0, 0, 0, 0, 0.7875, 0),
    ("адрес", "adres", 0, 0, 0, 0, 0.8, 0, 0), ("сумма", "amount", 0, 0, 0, 0, 0, 0, 0.85), ("Дата заказа", "ordered_at", 0, 0, 0, 0, 0, 0, 0.85), ("address1", "address2", 0, 0, 0, 0.45, 0, 0, 0), ("id", "code", 0, 0, 0, 0, 0, 0, 0),
    ("ｔｏｔａｌ", "total", 0, 0.98, 0.95, 0.9, 0, 0, 0), ("shipment status", "status", 0, 0, 0, 0.6, 0, 0, 0), ("клиент", "customer", 0, 0, 0, 0, 0, 0, 0.85), ("сумма сумма", "amount", 0, 0, 0, 0, 0, 0, 0.85),
    ("XMLParser", "xml parser", 0, 0.98, 0.95, 0.9, 0, 0, 0), ("ёлка", "елка", 0, 0, 0, 0, 0.8, 0.675, 0), ("", "x", 0, 0, 0, 0, 0, 0, 0), (None, "x", 0, 0, 0, 0, 0, 0, 0), ("shсhema", "schema", 0, 0, 0, 0, 0.0, 0, 0),
]


def test_name_evidence(spark):
    rows = spark.createDataFrame([(i, *p[:2]) for i, p in enumerate(NAMES)], "i int, _x string, target string")
    found = forms.with_evidence(rows, "_x", "target").orderBy("i").collect()
    assert [tuple(round(r["evidence"][n], 6) for n in forms.EVIDENCE) for r in found] == [p[2:] for p in NAMES]


def test_free_swaps_equal_sql():
    rng = random.Random(4)
    pairs = [["".join(rng.choice("abcd") for _ in range(rng.randint(0, 8))) for _ in range(2)] for _ in range(3000)] + [["ca", "abc"], ["einchst", "enlichst"], ["", "a"]]
    con = duckdb.connect()
    for most in (1, 3, 4):
        told = con.execute("SELECT [least(damerau_levenshtein(x[1], x[2]), ?) FOR x IN ?]", [most + 1, pairs]).fetchall()[0][0]
        assert forms.band_distances(*map(list, zip(*pairs, strict=True)), most, free=True).tolist() == told


def test_name_evidence_of_odd_texts(spark, tmp_path):
    """No text, no word, one word; swaps with a letter between; shares that end between two sixth places."""
    texts = [None, "", "?", "one", "einchst enlichst, eintesch einstch", "a1b2c3d4e5f6g7h8i9j10k a1b2c3d4e5f6g7h8i9j10kLMNOPQRSTUVWX"]
    texts += [" ".join("".join(f"{chr(97 + i % 26)}{i}" for i in range(a, a + n)) for a, n in ((0, 20), (10, 49), (30, 40), (49, 20)))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = con.execute(queries.ORACLE_SQL["name_evidence"])
    assert spark_rows(queries.QUERIES["name_evidence"](spark, str(tmp_path))) == rows_of([c[0] for c in found.description], found.fetchall())


def test_loads_that_conflict(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "uid string, g int")
    bad = spark.createDataFrame([("a", "X")], "uid string, code string")
    with pytest.raises(records.LoadConflict, match="rejected"):
        records.load_once(spark, rows, str(tmp_path / "t"), str(tmp_path / "l"), "k", "b1", bad, atomic=True)
    first = records.load_once(spark, rows, str(tmp_path / "t"), str(tmp_path / "l"), "k", "b1", bad)
    assert first == {"key": "k", "rows": 2, "quarantined": 1, "replayed": False}
    with pytest.raises(records.LoadConflict, match="another load"):
        records.load_once(spark, rows, str(tmp_path / "t"), str(tmp_path / "l"), "k", "b2")
    assert records.load_once(spark, rows, str(tmp_path / "t"), str(tmp_path / "l"), "k2", "b1", bad, "g")["rows"] == 1


@pytest.mark.parametrize("n", [0, 1, 12, 40])
def test_components_of_any_graph(spark, n):
    """Chains, hubs, pairs, loops, edges said twice, nulls: the least node of each component, as by merging sets."""
    rng = random.Random(n)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(n)] + [("p1", "p2"), ("q1", "q2"), ("q2", "q1"), ("loop", "loop"), ("hub", None), (None, None)] * (n > 0)
    edges += [(f"a{i}", "hub") for i in range(n)] + [(f"c{i:02}", f"c{i + 1:02}") for i in range(n)] + [("hub", "z1"), ("z1", "z2"), ("z2", "A")] * (n > 1)
    least = {x: x for e in edges if None not in e for x in e}
    for _ in least:
        for a, b in (e for e in edges if None not in e):
            least[a] = least[b] = min(least[a], least[b])
    found = load.connected(spark.createDataFrame(edges, "a string, b string")).collect()
    assert len(found) == len(least) and {r["node"]: r["component"] for r in found} == least


def test_groups_leave_one_table(spark):
    """Rows that depend on one other go through no round, and of what is written on the way only the groups stay."""
    rows = spark.createDataFrame([(f"l{i}", f"l{i}") for i in range(50)] + [("o1", "r"), ("o2", "r"), ("x", "x"), ("y", None), ("y2", None)], "uid string, record_id string")
    edges = spark.createDataFrame([(f"l{i}", f"o{i % 2 + 1}") for i in range(50)], "a string, b string")
    tables = lambda: {p.name for p in Path(shared_dir(spark).removeprefix("file:"), "sedimenta").glob("*")}
    sizes, before = [], tables()
    found = {r["uid"]: r["group"] for r in records.dependency_groups(rows, edges).collect()}
    assert found == {f"l{i}": "l0" for i in range(50)} | {"o1": "l0", "o2": "l0", "x": "x", "y": "y", "y2": "y2"}
    assert len(tables() - before) == 1

    def cut(df):
        out = tidied(df)
        sizes.append(out.count())
        return out

    assert load.connected(edges, cut).where("component = 'l0'").count() == 26 and sizes[2:-2] == [0] * len(sizes[2:-2])


def test_fingerprints_of_records_in_one_place(spark):
    """Records that their order does not tell apart: neither their names nor how they are dealt matter, an order that does tell still counts."""
    of = lambda rows, parts: records.dataset_fingerprint(spark.createDataFrame(rows, "r string, place long, field string, kind string, value string").repartition(parts), "r", ["place"]).first()
    rows = lambda name, place, n=300: [(name(i), place(i), "f", "string", f"v{i // 2}") for i in range(n)]
    one = of(rows(lambda i: f"r{i}", lambda i: 0), 1)
    assert one["records"] == 300 and of(rows(lambda i: f"other{1000 - i}", lambda i: 0)[::-1], 3) == one
    assert of(rows(lambda i: f"r{i}", lambda i: 0, 299), 1)["fingerprint"] != one["fingerprint"]
    assert len({of(rows(lambda i: f"r{i}", place), 2)["fingerprint"] for place in (lambda i: 0, lambda i: i, lambda i: -i)}) == 3


def test_matching_context(spark):
    scored = spark.createDataFrame([("a", "x", 0.98), ("a", "y", 0.5), ("b", "x", 0.96), ("b", "y", 0.9), ("c", "z", 0.94)], "source string, target string, score double")
    assert [tuple(r) for r in matching.anchors(scored).collect()] == [("a", "x", 0.98)]
    tables = spark.createDataFrame([("e", "a", "t", 0.9), ("e", "b", "t", 0.5), ("e", "a", "u", 1.0)], "entity string, source string, table string, score double")
    assert [tuple(r) for r in matching.table_scores(tables).orderBy("rank").collect()] == [("e", "t", 0.7, 1), ("e", "u", 0.5, 2)]
    patterns = spark.createDataFrame([("f", "email", 9, 10), ("f", "url", 1, 10)], "field string, pattern string, n long, non_null long")
    assert [tuple(r) for r in matching.pattern_share(patterns, spark.createDataFrame([("mail", "email")], "kind string, pattern string")).collect()] == [("f", "mail", 0.9)]
    pairs = spark.createDataFrame([("s", "x", "parent"), ("s", "y", "child"), ("s", "z", "other")], "source string, target string, table string")
    edges, found = spark.createDataFrame([("parent", "child")], "parent string, child string"), spark.createDataFrame([("parent",)], "table string")
    assert {(r["target"], r["support"]) for r in matching.graph_support(pairs, edges, found).collect()} == {("x", 0.0), ("y", 0.5), ("z", 0.0)}


def test_explicit_groups_lack_nothing(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 3, "d")], "id int, line_no int, line string")
    group = lambda a, b: spark.createDataFrame([(1, 7, a, b)], "id int, record_no int, first int, last int")
    assert [tuple(r) for r in structure.explicit_groups(rows, group(0, 1)).collect()] == [(1, 7, "a\nb")]
    with pytest.raises(Exception, match="lacks a line"):
        structure.explicit_groups(rows, group(1, 3)).collect()


def test_safe_patterns():
    assert schema.safe_pattern("^[a-z]{1,5}$") and schema.safe_pattern("[0-9]+x")
    assert not any(map(schema.safe_pattern, ("(a+)+", "(?=x)a", r"(a)\1", "a*b*", "x" * 300, "(", "(?<n>a)")))


def test_copies_convert_nothing(spark):
    df = spark.createDataFrame([(1, b"x", 1.0)], "a int, b binary, c double")
    assert schema.typed_copies(df, {"a": "integer"}).columns == ["a"]
    for f, kind in (("b", "bytes"), ("c", "money")):
        with pytest.raises(ValueError, match="cannot be copied"):
            schema.typed_copies(df, {f: kind})


def test_physical_parts(spark):
    cells = spark.createDataFrame([("a", 0, 0, " id "), ("b", 0, 0, "key"), ("a", 0, 1, "name"), ("a", 1, 0, "7")], "key string, row_index int, column_index int, value string")
    assert {r["column_index"]: r["labels"] for r in physical.labels(cells, 0).collect()} == {0: ["id", "key"], 1: ["name"]}
    refs = lambda *xs: spark.createDataFrame([(x,) for x in xs], "ref string")
    assert [r["ref"] for r in physical.missing_refs(refs("a", "b", "b"), refs("a", "c")).collect()] == ["b"]
    rows = spark.createDataFrame([(i, f"u{i}@x.org", None if i == 3 else i) for i in range(30)], "id int, email string, other int")
    found = profile.profile_table(rows)
    assert {r["field"]: (r["identity"], r["strength"]) for r in found.collect()} == {"id": ("identifier", "candidate"), "email": ("natural_key", "candidate"), "other": ("identifier", "none")}
    assert {r["entity"]: r["supported"] for r in physical.identity_supported(found, {"a": ["id", "email"], "b": ["other"], "c": ["none"]}).collect()} == {"a": True, "b": False, "c": False}
    assert profile.profile_table(rows.limit(0)).count() == 0


def test_plans_that_cannot_run():
    assert physical.plan_faults(parse.TabularPlan({"a": 0}, 0)) == [] and len(physical.plan_faults(parse.TabularPlan({"a": 0, "b": 0}, 5, 2, required=("c",)))) == 3
    assert physical.plan_faults(parse.TreePlan({"a": ("$.a", "int")})) == [] and physical.plan_faults(parse.TreePlan({"a": ("$.a[0]", "int")}, "$.x", {"k": ("$.x", {})}))
    assert physical.plan_faults(parse.LogPlan({"a": (0, 0, "tab")})) == [] and physical.plan_faults(parse.LogPlan({"a": (1, 0, "tab")})) and physical.plan_faults(parse.LogPlan({}, "other"))


def test_trees_of_plans(spark):
    """A hand-made table of header, numbers and a wider row: widths, headers, sections."""
    cells = spark.createDataFrame([(0, 0, "name"), (0, 1, "n"), (1, 0, "a"), (1, 1, "1"), (2, 0, "b"), (2, 1, "2")], "row_index int, column_index int, value string")
    assert [tuple(r) for r in structure.header_candidates(cells).collect()] == [(0, 0.85)]
    candidates = spark.createDataFrame([("d", "log", "x", 0.5), ("d", "table", "y", 0.9), ("d", "log", "a", 0.5)], "doc string, kind string, id string, confidence double")
    assert [(r["id"], r["rank"]) for r in structure.ranked_candidates(candidates, "doc", 2).orderBy("rank").collect()] == [("y", 1), ("a", 2)]
    assert spark.range(1).select(structure.confidence(F.lit(0.9), F.lit(0.7), F.lit(1.0))).first()[0] == 0.7
    assert [r["record_no"] for r in structure.grouped_blocks(spark.createDataFrame([(0,), (3,), (4,)], "block_no int"), 2).collect()] == [0, 1, 2]


@pytest.mark.parametrize(
    ("text", "keywords"),
    [
        ("1e40", "maximum"), ("12345678901234567890123", "maximum multipleOf"), ("123456789012345678901", "maximum multipleOf"), ("6", "maximum multipleOf"), ("5.0", ""), ("5.000000000000000000000000000000000000000000001", "maximum type multipleOf"), ("-3", "multipleOf minimum"), ("4e-1", "type multipleOf"), ("2.5e0", "type"),
        ("25e-1", "type"), ("-0", ""), ("0e999999", ""), ("1e999999999999999999", "maximum"), ("1e9999999999999999999999", "number type"), ("-1e-40", "minimum type multipleOf"), ("01", "json"), ("1.", "json"), ("{1: 2}", "json"), ("[1 2]", "json"), ('"5"', "type"), ('"\\u00015"', "type"), ("1 5", "json"),
    ],
)
def test_json_numbers_are_exact(spark, text, keywords):
    df = spark.createDataFrame([(1, text)], "k int, t string")
    found = schema.json_schema_issues(df, "k", "t", {"type": "integer", "minimum": 0, "maximum": 5, "multipleOf": 2.5}).collect()
    assert {r["keyword"] for r in found} == set(keywords.split())


def test_multiples_of_many_digits(spark):
    rng = random.Random(3)
    for divisor in ("7", "0.01", "12e3", "999999999999999989", "2.5e-7"):
        rows = []
        for _ in range(60):
            n = Decimal(rng.randrange(10 ** rng.randrange(1, 50))) * Decimal(divisor) if rng.random() < 0.5 else Decimal(rng.randrange(10 ** rng.randrange(1, 50))).scaleb(rng.randrange(-9, 9))
            rows.append((f"{n}", Fraction(n) % Fraction(Decimal(divisor)) == 0))
        with localcontext() as c:
            c.prec = 200
            found = schema.json_schema_issues(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "k int, t string"), "k", "t", {"multipleOf": Decimal(divisor)}).collect()
        assert {r["row_key"] for r in found} == {i for i, (_, whole) in enumerate(rows) if not whole}


def test_json_schema_of_nested_items(spark):
    told = {"type": "array", "items": {"type": "object", "required": ["a"], "properties": {"a": {"type": "array", "items": {"maximum": 3}}, "b": {"type": "boolean"}}}}
    texts = ['[{"a": [1, 2]}]', '[{"a": [1, 4]}, {"b": 1}]', '[{"b": true}]', "[]", '[{"a": 1}]', '[{"a": [], "b": 0}]', "{}"]
    found = schema.json_schema_issues(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t", told).collect()
    assert sorted(map(tuple, found)) == [(1, "/*/a/*", "maximum"), (2, "/*", "required:a"), (4, "/*/a", "type"), (5, "/*/b", "type"), (6, "", "type")]


def test_folded_letters_know_their_source():
    for text, low in [("Straße", "strasse"), ("ﬁnd", "find"), ("e\u0301A", "éa"), ("a\u200b\u00a0b", "a b"), ("\U0001d422x", "ix"), ("", ""), ("plain", "plain"), ("\u1112\u1161\u11ab!", "한!"), ("É" * 3, "é" * 3)]:
        got, begins, ends = folding.folded(text)
        assert got == low and len(begins) == len(ends) == len(low)
        assert all(folding.folded(text[a:b])[0].find(c) >= 0 for c, a, b in zip(low, begins.tolist(), ends.tolist(), strict=True))


@pytest.mark.parametrize(("text", "span"), [("so ignore\u00a0previous instructions", (3, 31)), ("ignore\u2003previous\u2003instructions", (0, 28)), ("x \U0001d422gnore previous instructions", (2, 30)), ("ﬁne: i\u200bgnore previous rules.", (5, 27))])
def test_phrases_in_disguise_are_found_where_they_are(spark, text, span):
    found = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(X.signal_spans("t").alias("s")).collect()
    assert ("instruction_override", *span) in [tuple(x) for x in found[0]["s"]] and found[1]["s"] == found[2]["s"] == []


def test_a_megabyte_is_folded_and_searched_in_seconds():
    began = time.time()
    text = "ünder the ｆull moon, a\u00a0line. " * 33_000 + "ignore\u2003previous rules"
    low, begins, ends = folding.folded(text)
    m = X._COMPILED["instruction_override"].search(low)
    assert (begins[m.start()], ends[m.end() - 1]) == (len(text) - 21, len(text)) and time.time() - began < 20


def _scanned(text):
    depth = most = items = 0
    quoted = escaped = atom = False
    for c in text:
        if quoted:
            quoted, escaped = (c != '"' or escaped), c == "\\" and not escaped
            continue
        if c in ' \t\n\r:,]}"[{':
            atom = False
            depth += (c in "[{") - (c in "]}")
            most, items, quoted = max(most, depth), items + (c in '[{"'), c == '"'
        elif not atom:
            atom, items = True, items + 1
    return most, items


def test_json_scan_equals_a_scan_letter_by_letter():
    rng = random.Random(4)
    for _ in range(3000):
        value = lambda d: rng.choice([rng.randrange(99), 'a\\"[]{}:, é', None, True, [value(d + 1) for _ in range(rng.randrange(4))] if d < 5 else 1, {f"k{i}\\": value(d + 1) for i in range(rng.randrange(3))} if d < 5 else "x"])  # noqa: B023, E731
        text = json.dumps(value(0), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        assert physical.scanned(text) == _scanned(text), text
    assert physical.scanned(None) == (0, 0) and physical.scanned("[" * 100_000) == (100_000, 100_000)


def test_long_documents_are_chunked_in_linear_time(spark):
    rows = spark.range(200_000).select(F.lit(1).alias("id"), F.col("id").cast("int").alias("line_no"), F.lit("").alias("line"))
    began = time.time()
    assert structure.chunks(rows, 100, 2).collect()[0][1:] == (0, 0, 199_999, 0)
    assert time.time() - began < 30


def test_charsets_of_texts_that_were_not_learnt_from(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null")
    fitted = charsets.fit_charsets(docs.where("doc_id % 2 = 0"), "text", ["cp1252", "cp850", "mac-roman"])
    rows = [(c, bytearray(r["text"].encode(c))) for r in docs.where("doc_id % 2 = 1").collect() if not r["text"].isascii() for c in fitted]
    found = spark.createDataFrame([*rows, ("none", bytearray(b"\xe9")), ("empty", bytearray()), ("null", None)], "written string, content binary").withColumn("c", charsets.charset_of(F.col("content"), fitted)).collect()
    judged = [r for r in found if r["written"] in fitted]
    right, wrong = (sum(r["c"]["encoding"] is not None and (r["written"] == r["c"]["encoding"]) is same for r in judged) for same in (True, False))
    assert right >= 0.98 * len(judged) and wrong <= 0.01 * len(judged)
    odd = {r["written"]: r["c"] for r in found}
    assert odd["none"]["encoding"] is None and odd["empty"]["encoding"] == "utf-8" and odd["null"]["encoding"] is None


def test_ranges_equal_sets():
    rng = random.Random(6)
    for _ in range(300):
        ranges, seen = streams.Ranges([], []), set()
        for _ in range(rng.randrange(1, 6)):
            numbers = [rng.randrange(40) for _ in range(rng.randrange(0, 15))]
            twice = sum(n in seen or numbers.index(n) < i for i, n in enumerate(numbers))
            assert ranges.add(np.array(numbers, np.int64)) == twice
            seen |= set(numbers)
            assert [x for a, b in zip(ranges.begins, ranges.ends, strict=True) for x in range(a, b)] == sorted(seen)
            assert ranges.count() == len(seen) and ranges.end() == max(seen, default=-1) + 1
            assert all(ranges.covers(t) == set(range(t)).issubset(seen) for t in range(5))
