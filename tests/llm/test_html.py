"""Pages are cut as a strict reader, a letter at a time, cuts them; and in time linear in the page."""

import random
import time

import pytest

from sedimenta.llm import html

SPACE = "\t\n\f\r "


def strict(page):
    """Text, and tags as (name, closing, attributes), one letter after the other; a tag that is not closed ends all."""
    out, text, i, n = [], [], 0, len(page)
    while i < n:
        if page[i] != "<":
            text.append(page[i])
            i += 1
            continue
        ahead = page[i + 1 : i + 2]
        closing = ahead == "/"
        name_at = i + 1 + closing
        first = page[name_at : name_at + 1]
        if page.startswith("<!--", i):
            i += 4
            if page.startswith((">", "->"), i):
                i = page.index(">", i) + 1
                continue
            ends = [(page.find(e, i), len(e)) for e in ("-->", "--!>")]
            ends = [(a, k) for a, k in ends if a >= 0]
            i = sum(min(ends)) if ends else n
        elif ahead in ("!", "?") and ahead or closing and first and not (first.isascii() and first.isalpha()):
            end = page.find(">", i)
            i = end + 1 if end >= 0 else n
        elif first and first.isascii() and first.isalpha():
            i = name_at
            name = ""
            while i < n and page[i] not in SPACE + "/>":
                name += page[i]
                i += 1
            said, state, key, value = {}, "before", "", ""
            done = False
            while i < n and not done:
                c = page[i]
                i += 1
                if state == "before":
                    if c == ">":
                        done = True
                    elif c not in SPACE + "/":
                        key, state = c, "name"
                elif state == "name":
                    if c in SPACE:
                        state = "after"
                    elif c in "/>":
                        said.setdefault(key.lower(), "")
                        state, i = "before", i - 1
                    elif c == "=":
                        state = "value"
                    else:
                        key += c
                elif state == "after":
                    if c == "=":
                        state = "value"
                    elif c not in SPACE:
                        said.setdefault(key.lower(), "")
                        state, i = "before", i - 1
                elif state == "value":
                    if c in "\"'":
                        state, value = c, ""
                    elif c == ">":
                        said.setdefault(key.lower(), "")
                        done = True
                    elif c not in SPACE:
                        state, value = "bare", c
                elif state == "bare":
                    if c in SPACE + ">":
                        said.setdefault(key.lower(), value)
                        state, i = "before", i - (c == ">")
                    else:
                        value += c
                elif c == state:  # the quote that closes
                    said.setdefault(key.lower(), value)
                    state = "before"
                else:
                    value += c
            if not done:
                break
            out += ["".join(text)] if text else []
            text = []
            out.append((name.lower(), closing, said))
        else:
            text.append("<")
            i += 1
    return out + (["".join(text)] if text else [])


def cut(page):
    out, at, text = [], 0, []
    for m in html._TOKEN.finditer(page):
        text.append(page[at : m.start()])
        at = m.end()
        if m[3] is None:
            continue
        if not m[5]:
            break
        said = {}
        for name, a, b, c in html._ATTRIBUTES.findall(m[4]):
            said.setdefault(name.lower(), a or b or c)
        out += ["".join(text)] if "".join(text) else []
        text = []
        out.append((m[3].lower(), bool(m[2]), said))
    else:
        text.append(page[at:])
    return out + (["".join(text)] if "".join(text) else [])


SOUP = ["<", ">", "</", "<p", "<div ", "<!--", "-->", "--", "-", "!", "!>", "<!", "<?", "/", "=", '"', "'", " ", "\n", "a", "x", "class", "id=", "it's", ' t="', "A B", "1", "é"]


@pytest.mark.parametrize("seed", range(4))
def test_tag_soup_is_cut_as_by_a_strict_reader(seed):
    rng = random.Random(seed)
    for _ in range(5000):
        page = "".join(rng.choice(SOUP) for _ in range(rng.randrange(0, 25)))
        assert cut(page) == strict(page), page


def read(page):
    own = html.wrapper_of(html.parse(page))
    html.mark_main(own)
    return html.main_text(html.parse(page), own)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p title=it's>Hello one</p><p>Don't stop here</p><p>end</p></article>", "Hello one\n\nDon't stop here\n\nend"),
        ("<article><!--><p>Hello one</p><p>two</p></article>", "Hello one\n\ntwo"),
        ("<article><!---><p>Hello one</p><!-- x --!><p>two</p></article>", "Hello one\n\ntwo"),
        ("<article><p a=\"1 > 0\" b='<p>'>one<p data-id=ad x-class='menu'>two &lt;3</article>", "one\n\ntwo <3"),
        ("<article><p>1 < 2 and <3</p><script>x</scripts></p></script ><p>two</p></article>", "1 < 2 and <3\n\ntwo"),
        ("<article><p>one</p><p hidden>no</p><p aria-hidden='true'>no</p><p style=\"display : none\">no</p><p title='hidden'>two</p></article>", "one\n\ntwo"),
    ],
)
def test_odd_attributes_and_comments(page, text):
    assert read(page) == text


@pytest.mark.parametrize(
    "page", ['<p title="x"' * 84_000, "<![CDATA[" * 110_000, "<!" * 500_000, "<script></script" * 62_000, "<!--" * 250_000, "<p a='" * 170_000, "<nav>" * 100_000 + "</x>" * 120_000, "<p " * 330_000, "<" * 1_000_000]
)
def test_a_page_of_a_million_letters_is_cut_once(page):
    began = time.time()
    html.parse(page)
    assert time.time() - began < 10  # some tenths of a second; minutes where work grows with the square


def test_wrappers_of_many_tasks_meet_in_a_tree(spark, monkeypatch):
    page = "<div><div>Home {0}</div><div>words of page {0}</div><div>All rights reserved</div></div>"
    rows = [(i, "http://one.example/x", page.format(f"about thing number {i} and some more")) for i in range(40)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = sorted(map(tuple, html.extract(frame.coalesce(1)).collect()))
    monkeypatch.setattr(html, "FAN_IN", 2)
    monkeypatch.setattr(html, "HOSTS", 1)
    assert sorted(map(tuple, html.extract(frame.repartition(9)).collect())) == whole
