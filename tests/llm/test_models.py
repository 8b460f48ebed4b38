"""Language model, personal data, quality, pages and the pipeline."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from sedimenta.llm import html, lm, mixing, pii, quality
from sedimenta.llm.common import fold, written
from sedimenta.llm.queries import QUERIES
from tests.llm.frames import CLASHING, ROWS, SMALL, documents
from tests.llm.test_copies import _components, _plain_fingerprint
from tests.llm.test_counts import _check_packing


def test_network_is_a_distribution_with_right_gradients():
    tokens = np.full(lm.KINDS, 2000)
    shape = lm.shape_of([(i * 7919 * 64 + i % lm.KINDS, 500 // (i + 1) + 2) for i in range(60)], tokens, tokens // 8)
    p = {k: v.astype(float) + 0.1 * np.random.default_rng(0).standard_normal(v.shape) for k, v in lm.start_weights(shape, 8).items()}
    words = np.arange(1, len(shape.class_of))
    h = np.random.default_rng(1).standard_normal((1, 8))
    assert np.exp(lm.log_probabilities(p, shape, np.repeat(h, len(words), 0), words)).sum() == pytest.approx(1, abs=1e-6)
    rng = np.random.default_rng(2)
    y = rng.integers(1, len(shape.class_of), (5, 3))
    x, h0 = np.vstack((np.zeros((1, 3), int), y[:-1])), np.zeros((3, 8))

    def loss():
        return -lm.log_probabilities(p, shape, lm.run_window(p, x, h0)[0].reshape(-1, 8).astype(float), y.ravel()).sum()

    states, kept = lm.run_window(p, x, h0)
    slopes = {k: np.zeros_like(v) for k, v in p.items()}
    _, d = lm.log_probabilities(p, shape, states.reshape(-1, 8), y.ravel(), slopes)
    lm.back_through(p, x, kept, d.reshape(5, 3, 8), slopes)
    for k in p:
        at = (int(y[0, 0]), *(0 for _ in p[k].shape[1:])) if k in "EOo" else tuple(n // 2 for n in p[k].shape)
        p[k][at] += 1e-2
        up = loss()
        p[k][at] -= 2e-2
        assert slopes[k][at] == pytest.approx((up - loss()) / 2e-2, abs=2e-3), k
        p[k][at] += 1e-2


def test_state_is_carried_across_windows():
    shape = lm.shape_of([(i * 64 + i, 100) for i in range(20)], np.full(lm.KINDS, 200), np.full(lm.KINDS, 20))
    p = {k: v + np.float32(0.2) for k, v in lm.start_weights(shape).items()}
    words = np.random.default_rng(0).integers(1, 60, 5 * lm.WINDOW + 7)
    whole = lm.score_texts(p, shape, [words])
    states, _ = lm.run_window(p, np.concatenate(([0], words[:-1]))[:, None], np.zeros((1, p["U"].shape[1]), np.float32))
    assert whole[0] == pytest.approx(lm.log_probabilities(p, shape, states[:, 0], words).sum(), rel=1e-5)


def test_texts_in_one_lane_do_not_touch():
    """However texts are dealt to lanes, each is scored as if alone; the network's own arithmetic, step by step, agrees."""
    shape = lm.shape_of([(i * 64 + i, 100 + i) for i in range(20)], np.full(lm.KINDS, 200), np.full(lm.KINDS, 20))
    rng = np.random.default_rng(0)
    p = {k: v + 0.3 * rng.standard_normal(v.shape).astype(np.float32) for k, v in lm.start_weights(shape).items()}
    texts = [rng.integers(1, 60, n) for n in (1, 130, 7, 300, 49, 48, 1, 90)]
    want = []
    for words in texts:
        h, total = np.zeros(lm.HIDDEN), 0.0
        for before, word in zip([lm.START, *words[:-1]], words, strict=True):
            a, u = p["W"] @ p["E"][before] + p["b"], p["U"] @ h
            z, r = (1 / (1 + np.exp(-(a + u)[i * lm.HIDDEN : (i + 1) * lm.HIDDEN])) for i in (0, 1))
            new = np.tanh(a[2 * lm.HIDDEN :] + r * u[2 * lm.HIDDEN :])
            h = (1 - z) * new + z * h
            c = shape.class_of[word]
            rows = slice(shape.first[c], shape.first[c] + shape.size[c])
            for x, at in ((p["C"] @ h + p["c"], c), (p["O"][rows] @ h + p["o"][rows], word - shape.first[c])):
                total += x[at] - np.log(np.exp(x).sum())
        want.append(total)
    for lanes in (1, 3, 256):
        assert lm.score_texts(p, shape, texts, lanes) == pytest.approx(want, rel=1e-4)


def test_training_reads_whole_documents(spark):
    """Every word of a long document is learnt from, wherever it stands; short ones beside it are so too."""
    said = [f"w{i}a" for i in range(700)]
    rows = [(2, " ".join(said + said), "en", "a"), *((i, f"s{i}b s{i}b", "en", "a") for i in (4, 6, 9, 11))]
    assert all(fold(i) != lm.HELD_OUT for i, *_ in rows)
    blocks, _, tokens, distinct, common = lm.counted(documents(spark, rows).select("doc_id", "text"))
    shape = lm.shape_of(common, tokens, distinct)
    assert len(shape.words) == 705
    before, after = lm.start_weights(shape), lm.fit(blocks, shape)
    assert (np.abs(after["O"] - before["O"]).max(axis=1)[shape.words] > 1e-6).all()  # all are learnt as what follows
    places = lm._Tokens()
    as_input = [int(shape.words[shape.hashes == np.uint64(places.numbers[places[w.encode()]])][0]) for w in said]
    assert (np.abs(after["E"] - before["E"]).max(axis=1)[as_input] > 1e-6).all()  # and the long one's as what stands before


def _base(rows):
    tokens = [[*(t or "").encode().lower().split(), b""] for _, t in rows]
    held = [fold(i) == 1 for i, _ in rows]
    counts = Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [(i, h, len(ws), sum(counts[w] > 0 for w in ws), n, sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for (i, _), ws, h in zip(rows, tokens, held, strict=True)]


def test_language_model_scores(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = {r["doc_id"]: r for r in lm.score(docs).collect()}
    want = _base([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert len(found) == len(want)
    for i, *exact, base in want:
        r = found[i]
        assert [r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]] == exact and r["base_score"] == pytest.approx(base)
        assert r["score"] < 0
    held = [r for r in found.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize("size", [1 << 20, 40])
def test_counts_come_in_pieces(spark, monkeypatch, size):
    """Blocks get the totals of their distinct tokens from the owners of ranges: a row for a piece, not one for a token."""
    monkeypatch.setattr(lm, "OWNER_NUMBERS", size)
    rows = [(i, " ".join(f"{'abc.7é'[j % 6]}{j * j % 97}{'xyz'[i % 3]}" for j in range(i)), "en", "a") for i in range(60)]
    docs = documents(spark, rows).select("doc_id", "text").repartition(3)
    blocks, gathered, tokens, distinct, common = lm.counted(docs)
    train = Counter(w for i, t, *_ in rows if fold(i) != lm.HELD_OUT for w in [*t.encode().split(), b""])
    places = lm._Tokens()
    number = {w: np.uint64(places.numbers[places[w]]) for _, t, *_ in rows for w in [*t.encode().split(), b""]}
    by_number = {number[w]: n for w, n in train.items()}
    told = blocks.join(gathered, "block").collect()
    assert len(told) == blocks.count() > 1
    for r in told:
        totals = np.frombuffer(b"".join(r["totals"]), "<i8")
        assert totals.tolist() == [by_number.get(x, 0) for x in np.frombuffer(r["distinct"], np.uint64)]
        assert len(r["totals"]) <= -(-sum(x["n_distinct"] for x in told) // size)
    assert (len(told[0]["totals"]) > 1) == (size == 40)
    assert (tokens.sum(), distinct.sum()) == (train.total(), len(train))
    assert tokens.tolist() == [sum(n for w, n in train.items() if lm.kind_of(w) == k) for k in range(lm.KINDS)]
    assert {np.int64(n).view(np.uint64): c for n, c in common} == {x: n for x, n in by_number.items() if n > 1 and n * lm.FREQUENT >= train.total()}


@pytest.mark.parametrize("size", [1, 50, 1 << 25])
def test_pieces_of_texts_hold_their_words(monkeypatch, size):
    monkeypatch.setattr(lm, "PIECE_BYTES", size)
    rng = np.random.default_rng(4)
    texts = [None, "", " \t", *("".join(rng.choice(list("aB c\t\n\x0b\x0c\r\x1c\x85\xa0\u3000Éß. 7\x00🙂 "), n)) for n in range(40))]
    found = []
    for first, tokens, numbers, lengths in lm._split(pa.array(texts)):
        assert first == len(found)
        found += [numbers[x].tolist() for x in np.split(tokens, np.cumsum(lengths)[:-1])]
    assert found == [lm._numbers([*(t or "").encode().lower().split(), b""]) for t in texts]


def test_language_model_edge_cases(spark):
    found = lm.score(documents(spark)).collect()
    want = _base([(r[0], r[1]) for r in ROWS])
    key = lambda r: (str(r[0]), r[2], r[3], round(r[5], 6))
    assert sorted(key(r) for r in found) == sorted(key(r) for r in want)
    assert lm.score(documents(spark, [])).count() == 0


_E, _I = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def _plain_spans(t):
    digits = lambda x: re.sub("[^0-9]", "", x)
    out = [(0, *m.span()) for m in _E.finditer(t)] + [(1, *m.span()) for m in _I.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in pii.CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [(3, *m.span()) for m in pii.PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(5)
    for _ in range(20_000):
        t = "".join(rng.choice("1205.@a-+ ().x\n") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == _plain_spans(t), t


def test_long_runs_take_no_quadratic_time():
    text = "1" * 200_000 + " " + "x" * 200_000 + "@" + "a." * 50_000 + " +1" + " " * 100_000
    assert isinstance(pii.base_spans(text), list) and pii.read(text)


def test_personal_data(spark):
    found = QUERIES["op6_pii"](spark, SMALL).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in found:
        base = _plain_spans(texts[r["doc_id"]])
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert set(said.split(",")) - {""} <= set(r["spans"].split(","))
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[0] == k for s in base) for k in range(4)]


def test_linked_mentions_are_found(spark):
    docs = documents(spark)
    found = [r for r in pii.find(docs, pii.fit_field(docs)).collect() if r["doc_id"] == 11][0]
    text = dict((r[0], r[1]) for r in ROWS)[11]
    spans = [s.split(":") for s in found["spans"].split(",")]
    assert [text[int(a) : int(b)] for k, a, b in spans if k == "phone"] == ["+1 (017) 555-7713", "555-7713"] and found["n_added"] == 1
    assert pii.find(docs, pii.fit_field(docs)).count() == len(ROWS)
    empty = documents(spark, [])
    assert pii.find(empty, pii.fit_field(empty)).count() == 0


def test_hundreds_of_mentions_are_linked():
    """Mentions that by themselves lean to O get the full one's label however many there are; without it, none does."""
    unary = {("bias",): np.array([5.5, 0, 0, 0, 0]), ("before", 3, 0): np.array([0, 0, 0, 0, 30.0])}  # after "(017)", a phone
    field = pii.SkipChain(unary, np.zeros((5, 5)), np.diag([0.0, 6, 6, 6, 6]))
    full, short = " call +1 (017) 555-7713 now", " and then some more words, later 555-7713" * 300
    for text in (full + short, short + full):
        base, found = pii.all_spans(text, field)
        assert len(base) == 1 and [text[a:b] for k, a, b in found if k == 3].count("555-7713") == 300
    numbers = " and then some more words, later 20417-23"
    field.unary["bias",] = np.array([9.0, 0, 0, 0, 0])
    assert pii.all_spans(numbers * 300, field) == ([], [])


def test_forward_backward_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    pull, moves = rng.standard_normal(9), rng.standard_normal((2, 2))
    lines_of = np.array([4, 1, 3, 1])
    good, expected = quality.forward_backward(pull, lines_of, moves)
    at, want, pairs = 0, [], np.zeros((2, 2))
    for n in lines_of:
        total, ones, own = 0.0, np.zeros(n), np.zeros((2, 2))
        for path in product((0, 1), repeat=int(n)):
            w = np.exp(sum(pull[at + i] * y for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
            total += w
            ones += w * np.array(path)
            for a, b in zip(path, path[1:], strict=False):
                own[a, b] += w
        want += (ones / total).tolist()
        pairs += own / total
        at += n
    assert np.allclose(good, want) and np.allclose(expected, pairs)


def test_quality_separates_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    found = {r["doc_id"]: r for r in QUERIES["op7_quality"](spark, sf).collect()}
    labels = [(r["quality"], found[r["doc_id"]]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if found[r["doc_id"]]["held_out"]]
    good, bad = [r["score"] for q, r in labels if q == 1], [r["score"] for q, r in labels if q == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (fold(r["doc_id"]) == 0) for r in found.values())


def test_quality_edge_cases(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 0), (6, 0, 0), (7, 0, 1), (7, 1, 1)], "doc_id long, quality int, toxic int")
    found = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(found) == len(ROWS) and all(0 <= r["score"] <= 1 for r in found)
    untold = quality.score(docs, quality.fit(docs, labels.limit(0))).collect()
    assert {round(r["score"], 9) for r in untold} == {0.5}
    assert quality.score(documents(spark, []), quality.fit(docs, labels)).count() == 0


def _plain_article(page):
    from html import unescape

    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
    return "\n\n".join(b for b in blocks if b)


def test_pages_equal_their_articles(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    found = QUERIES["op10_html_text"](spark, SMALL).collect()
    assert len(found) == len(pages)
    for r in found:
        assert r["text"] == _plain_article(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"])


PAGE = """<html><head><title>no</title></head><body><header><a href=x>Site</a></header><div class="sidebar">links</div>
<div id="page-content"><h2>Title &eacute;&lt;</h2>one <span>two</span><p>three<ul><li>a<li>b</ul><form>mail <input></form>
<div class="cookie-notice">We use</div><script>var a = "</p>";</script><section id="comments"><p>nice!</p></section></div><footer>c</footer>"""


def test_pages_edge_cases(spark):
    rows = [(1, "http://h/a", PAGE), (1, "http://h/a", PAGE), (2, None, PAGE), (3, "http://h/b", None), (None, "http://h/c", ""), (5, "no url", "just text &amp; more"), (6, "https://deep/x", "<div>" * 3000 + "end"), (7, "\u00a0http://h/a", "<article>odd</article>"), (8, "http://[::1", "<p>six")]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, wrapper string")
    found = sorted(((r["page_id"] or 0, r["text"]) for r in html.extract(frame).collect()), key=repr)
    article = "Title é<\n\none two\n\nthree\n\na\n\nb"
    assert found == sorted([(1, article), (1, article), (2, article), (3, ""), (0, ""), (5, "just text & more"), (6, "end"), (7, "odd"), (8, "six")], key=repr)
    assert html.extract(frame.limit(0)).count() == 0


def _texts_of(*pages):
    wrapper = None
    for p in pages:
        own = html.wrapper_of(html.parse(p))
        wrapper = own if wrapper is None else html._merged(wrapper, own)
    html.mark_main(wrapper)
    return [html.main_text(html.parse(p), wrapper) for p in pages]


@pytest.mark.parametrize(
    "around",
    [
        '<article class="post has-sidebar">%s</article>', '<article class="post category-social tag-share">%s</article>', '<div id="content" class="no-comments">%s</div>',
        "<form method=post><div>%s</div></form>", "<form><article>%s</article></form>", '<div class="widget"><main>%s</main></div>',
    ],
)
def test_names_do_not_drop_the_article(around):
    said = [f"<p>Text number {i} says {'this and that ' * i}</p>" for i in range(3, 7)]
    extra = '<div class="site-footer">Imprint</div><aside><article>Teaser</article></aside><form>Search here <input></form>'
    found = _texts_of(*("<body>" + around % s + extra for s in said))
    assert found == [" ".join(re.sub("<[^>]*>", "", s).split()) for s in said]


def _page(menu, notice, body, foot):
    items = "".join(f"<div><a href=/{m}>{m}</a></div>" for m in menu)
    return f"<body><div><div>{items}</div></div><div><div>{notice}</div></div><div><h2>{body[0]}</h2>{''.join(f'<p>{b}</p>' for b in body[1:])}</div><div>{foot}</div></body>"


def test_slots_find_articles_that_no_name_tells(spark):
    """Pages of plain divs: a notice longer than the article is the template's, as it is the same on all pages. Read by
    itself, a page does not show that."""
    rng = random.Random(3)
    said = lambda n: " ".join(rng.choice(("sun", "moon", "tide", "stone", "river", "cloud")) + str(rng.randint(0, 99)) for _ in range(n))
    rows, want = [], {}
    for host in range(4):
        menu, notice, foot = [said(1) for _ in range(6)], said(150), said(12)
        for i in range(5):
            body = [said(4), *(said(rng.randint(5, 25)) for _ in range(rng.randint(1, 4)))]
            want[len(rows)] = "\n\n".join(body)
            rows.append((len(rows), f"http://host{host}/{i}", _page(menu, notice, body, foot)))
    found = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == want
    alone = [_texts_of(page)[0] for _, _, page in rows]
    assert sum(t == want[i] for i, t in enumerate(alone)) < len(rows) / 4


def test_names_are_priors_that_slots_overrule():
    told = lambda i: f"Page {i} tells a story of its own, number {i * 77}. " * 8
    pages = [f"<body><div class=sidebar><div>{told(i)}</div></div><article>Ad</article><div class=widget>Same for all of these</div></body>" for i in range(4)]
    assert _texts_of(*pages) == [told(i).strip() for i in range(4)]
    assert _texts_of(pages[0]) == ["Ad"]  # a page alone has nothing to say against its names
    empty = "<body><article></article><div class=ad>Buy this</div><footer>Imprint and more</footer></body>"
    assert _texts_of(empty) == [""]


def test_texts_that_begin_alike_are_told_apart():
    lead = "The same long lead of every page of this host, a licence line and a dateline, said again. " * 2
    pages = [f"<body><div>{lead}{'Own words of page %d. ' % i * 9}</div><ul><li>{'Short %d.' % i}</ul></body>" for i in range(4)]
    found = _texts_of(*pages)
    assert all(t.startswith(lead.strip()) and f"Own words of page {i}." in t and "Short" not in t for i, t in enumerate(found))


def test_alignment_forms_optional_and_repeated_parts():
    one = html.wrapper_of(html.parse("<ul><li>a</ul><p>x</p>"))
    two = html.wrapper_of(html.parse("<h1>t</h1><ul><li>a<li>b</ul><p>x</p><p>y</p>"))
    parts = {p[0]: p for p in html._merged(one, two)[4]}
    assert list(parts) == ["h1", "ul", "p"] and parts["h1"][1] and parts["p"][2] and parts["ul"][4][0][2] and not parts["ul"][1]


def test_pipeline_stages_equal_brute_force(spark):
    """Each stage's rows against plain Python over the rows it was given, and run() against the stages."""
    docs = before = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    field = quality.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        given = docs
        docs = written(stage(spark, docs, SMALL))
        if name == "packing":
            break
        assert docs.columns == before.columns
        if name == "quality":
            rows = {i: t for i, t in rows.items() if quality.text_scores([t], field)[0] >= quality.THRESHOLD}
        elif name == "exact_dedup":
            rows = {max(i for i, t in rows.items() if t.encode().lower() == k): 0 for k in {t.encode().lower() for t in rows.values()}}
            rows = {r["doc_id"]: r["text"] for r in given.collect() if r["doc_id"] in rows}
        elif name == "near_dedup":
            ids = sorted(rows)
            label = _components([_plain_fingerprint(rows[i]) for i in ids], ids)
            rows = {i: rows[i] for i in set(label)}
        if name != "mixing":
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == rows and docs.count() == len(rows)
        else:
            taken = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix(given).collect()}
            want = Counter({(i, rows[i]): (2 * n + size) // (2 * size) if size else 1 for i, (size, n) in taken.items()})
            assert Counter((r["doc_id"], r["text"]) for r in docs.collect()) == +want
    found = _check_packing(spark, given)
    pieces = lambda frame: sorted(map(tuple, frame[["doc_id", "piece", "start", "length", "ids_crc32"]].astype("int64").values.tolist()))
    assert pieces(docs.toPandas()) == pieces(found) == pieces(corpus_pipeline.run(spark, SMALL).toPandas())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]


@pytest.mark.parametrize("rows", [ROWS, []])
def test_pipeline_stages_take_odd_rows(spark, rows):
    docs = documents(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SMALL))
        assert name == "packing" or len(docs.columns) == 5 + len(CLASHING)
    assert docs.count() >= (1 if rows else 0)
