"""Main text of pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page is a stream of tags and text. Its block structure is kept as nested sequences, in which a run of like siblings
is a repeated group. The wrapper of a host starts as its first page and is aligned with one page after the other: what
matches is merged, a mismatch becomes a repeated group where the run continues what stands beside it and an optional
part otherwise, and text becomes a slot that remembers how much text, how many links and whether the same text each
time it held. No alternatives are ever formed: a sequence whose order varies without end becomes one repeated group of
optional parts, which bounds a wrapper's size. Two wrappers align like two pages. So each task infers its
own for every host it meets, and only these are shuffled and merged, in a tree: a host that a third of all pages have
costs one row for each task.

A wrapper then tells which of its parts are the article, by its slots: text that is the same on all pages of a host is
the template's, text that is linked leads elsewhere, and what varies from page to page without being linked is content.
Names of elements and classes are priors, which the slots overrule where they say plainly otherwise. Each page is laid
over its host's wrapper, and the text of the slots in the article's parts, in page order, is its main text.
"""

from __future__ import annotations

import hashlib
import json
import re
from html import unescape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import written

#: Parts of a sequence before it becomes a group of optional parts; depth below which structure is not told apart.
SEQUENCE, DEPTH = 48, 100
#: Tasks whose wrappers of a host are merged at once; hosts whose wrappers a task holds.
FAN_IN, HOSTS = 64, 2000

# Fixed values of HTML: elements that are blocks, that hold no content, whose content is no text of the page.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody "
    "td tfoot th thead tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
DROPPED = frozenset("head svg math select button object video audio canvas map datalist form nav aside footer dialog menu search".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
#: Elements whose name tells nothing: two of them are the same part only if they hold like elements.
GENERIC = frozenset("div section td center".split())
# Words in a class, id or role that name what is no part of an article, and what is one.
BOILER = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner banners nav navbar navigation menu menus "
    "breadcrumb breadcrumbs sidebar sidebars aside footer masthead comment comments commentlist respond reply replies disqus cookie cookies "
    "consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations pagination pager toolbar widget widgets skip copyright complementary contentinfo hidden alert".split()
)
#: Words that beside one of these leave a name a name of that: a site-footer is a footer, but what has-sidebar is no sidebar.
NEUTRAL = frozenset("site main top bottom left right primary secondary global page box block area section container wrapper bar list links slot unit".split())
ARTICLE = frozenset("article articlebody main maincontent content post story entry posts".split())
#: What is never text of the page; in elements of other names, what text counts for where the article is looked for.
NO_TEXT = frozenset("head svg math select button object video audio canvas map datalist".split())
BOILER_SHARE, ARTICLE_SHARE = 1 / 16, 8
#: From so many pages on, a slot that always says the same is the template's; share of a part's text that one below it
#: must hold to be the article in its stead.
ALIKE, MOST = 3, 0.8

# A page is cut as a browser cuts it. Quantifiers never give back, and what is not closed reaches to the end of the page,
# so a page is read once: a quote within a value without quotes is a letter, <!--> is an empty comment.
_SPACE = "[\t\n\f\r ]"
_ATTRIBUTE = rf"""[^\t\n\f\r />][^\t\n\f\r />=]*+(?:{_SPACE}*+={_SPACE}*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\t\n\f\r "'>][^\t\n\f\r >]*+|(?=>)))?+"""
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<!\[CDATA\[((?:(?!<!\[CDATA\[|\]\]>).)*+)\]\]>"
    r"|<(?:[!?]|/(?=[^a-zA-Z]))[^>]*+(?:>|\Z)"
    rf"|<(/?)([a-zA-Z][^\t\n\f\r />]*+)((?:[\t\n\f\r /]++|{_ATTRIBUTE})*+)(>|\Z)",
    re.S,
)
_ATTRIBUTES = re.compile(rf"""([^\t\n\f\r />][^\t\n\f\r />=]*+)(?:{_SPACE}*+={_SPACE}*+(?:"([^"]*+)"?|'([^']*+)'?|([^\t\n\f\r >]*+)))?+""")
_GONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NAMING = ("class", "id", "role", "itemprop")
_WORDS = re.compile(r"[a-z]+")


class Part:
    """An element: its name with the telling words of its attributes, and what it holds, text and elements."""

    __slots__ = ("key", "tag", "boiler", "block", "items")

    def __init__(self, key, tag, boiler, block):
        self.key, self.tag, self.boiler, self.block, self.items = key, tag, boiler, block, []


def _element(tag: str, attributes: str, in_article: bool) -> Part:
    words: set[str] = set()
    boiler = tag in DROPPED or (tag == "header" and not in_article)
    if attributes and not attributes.isspace():
        said: dict[str, str] = {}
        for name, a, b, c in _ATTRIBUTES.findall(attributes):
            said.setdefault(name.lower(), a or b or c)  # of attributes of one name the first counts
        for name in " ".join(said.get(k, "") for k in NAMING).lower().split():
            parts = _WORDS.findall(name)
            if all(w in BOILER or w in NEUTRAL for w in parts):
                words.update(w for w in parts if w in BOILER)
            words.update(w for w in (*parts, "".join(parts)) if w in ARTICLE)
        if "hidden" in said or said.get("aria-hidden", "").strip().lower() == "true" or _GONE.search(said.get("style", "")):
            words.add("hidden")
    boiler = boiler or (bool(words & BOILER) and ("hidden" in words or tag != "article") and tag not in ("body", "html", "main"))
    return Part(".".join((tag, *sorted(words))), tag, boiler, tag in BLOCKS)


def parse(page: str) -> Part:
    """The elements of a page; forgiving: what is not closed ends with what holds it or where its kind starts anew."""
    root = Part("", "", False, True)
    stack, at, links, articles = [root], 0, 0, 0
    deeper: dict[str, int] = {}  # open elements below the depth; there, a block only ends a block
    open_: dict[str, int] = {}  # open elements by name
    tokens = _TOKEN.finditer(page)

    def text(upto: int):
        if upto > at:
            top = stack[-1]
            top.items.append((page[at:upto], links > 0))

    def close(i: int):
        nonlocal articles
        articles -= sum(p.tag in ("article", "main") for p in stack[i:])
        for p in stack[i:]:
            open_[p.tag] -= 1
        del stack[i:]

    skip_to = 0
    for m in tokens:
        if m.start() < skip_to:
            continue
        text(m.start())
        at = m.end()
        if m[3] is None:
            if m[1] is not None:
                stack[-1].items.append((m[1], links > 0))
            continue
        if not m[5]:
            break  # a tag that is not closed is the rest of the page
        tag = m[3].lower()
        if m[2]:
            if deeper.get(tag):
                deeper[tag] -= 1
                stack[-1].items.append(Part(tag, tag, False, True))
                continue
            if tag == "a":
                links = max(0, links - 1)
            elif tag == "br" or tag == "p" and not open_.get("p"):
                stack[-1].items.append((" ", False)) if tag == "br" else stack[-1].items.append(Part("p", "p", False, True))
            for i in range(len(stack) - 1, 0, -1) if open_.get(tag) else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in ("article", "main", "table", "body") and tag not in BLOCKS:
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\t\n\f\r />])[^>]*+(?:>|\Z)", re.I).search(page, at)
            at = skip_to = end.end() if end else len(page)
            continue
        if tag in ("br", "wbr", "img", "hr") or tag in VOID:
            if tag == "hr":
                stack[-1].items.append(Part("hr", "hr", False, True))
            elif tag == "br":
                stack[-1].items.append((" ", False))
            continue
        if tag == "a":
            links += 1
            continue
        part = _element(tag, m[4], articles > 0)
        if not part.block and not part.boiler:
            continue  # inline marks are part of the text
        if part.block:
            for i in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph; an item ends the one before
                if stack[i].tag in SCOPE.get(tag, ()):
                    break
                if stack[i].tag in CLOSED_BY.get(tag, ()):
                    close(i)
                    break
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].block and tag not in CLOSED_BY:
                    break
            links = 0
            if tag in ("article", "main"):
                articles += 1
        stack[-1].items.append(part)
        if len(stack) <= DEPTH or part.boiler:
            stack.append(part)
            open_[tag] = open_.get(tag, 0) + 1
        else:
            deeper[tag] = deeper.get(tag, 0) + 1
    else:
        text(len(page))
    return root


# ---- wrappers: [key, optional, repeated, [pages, text, link text, hash of the same text or None], parts]


def wrapper_of(part: Part, depth: int = 0) -> list:
    """The wrapper that a single page is."""
    own = [i for i in part.items if isinstance(i, tuple)]
    said = " ".join("".join(t for t, _ in own).split())
    links = sum(len(t) for t, linked in own if linked)
    parts: list = []
    if depth < DEPTH:
        for p in part.items:
            if isinstance(p, Part):
                below = wrapper_of(p, depth + 1)
                if parts and _alike(parts[-1], below):  # the run continues what stands beside it
                    parts[-1] = _merged(parts[-1], below)
                    parts[-1][2] = True
                else:
                    parts.append(below)
    return [part.key, False, False, [1, len(said), links, hashlib.sha256(said.encode("utf-8", "surrogatepass")).hexdigest()], _bounded(parts)]


def _bounded(parts: list) -> list:
    """Parts, or one repeated group of optional parts where they are too many."""
    if len(parts) <= SEQUENCE:
        return parts
    by_key: dict[str, list] = {}
    for p in parts:
        by_key[p[0]] = _merged(by_key[p[0]], p) if p[0] in by_key else p
    for p in by_key.values():
        p[1] = p[2] = True
    return list(by_key.values())


def _match(key: str, kids: set, other: set) -> bool:
    """Whether two elements of one name are the same part of a page: one that tells nothing must hold like elements."""
    if key not in GENERIC or kids == other:
        return True
    return 2 * len(kids & other) >= min(len(kids), len(other)) > 0


def _kids(w: list) -> set:
    return {p[0] for p in w[4]}


def _alike(a: list, b: list) -> bool:
    return a[0] == b[0] and _match(a[0], _kids(a), _kids(b))


def _merged(a: list, b: list) -> list:
    """Two matching parts as one."""
    (n, t, l, s), (m, u, k, r) = a[3], b[3]
    return [a[0], a[1] or b[1], a[2] or b[2], [n + m, t + u, l + k, s if s == r else None], align(a[4], b[4])]


def align(a: list, b: list) -> list:
    """The sequence that both sequences are instances of."""
    if len(a) == len(b) and all(map(_alike, a, b)):
        return [_merged(x, y) for x, y in zip(a, b, strict=True)]
    n, m = len(a), len(b)
    same = [[_alike(x, y) for y in b] for x in a]
    best = [[0] * (m + 1) for _ in range(n + 1)]  # longest common subsequences of the ends
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = 1 + best[i + 1][j + 1] if same[i][j] else max(best[i + 1][j], best[i][j + 1])
    out: list = []

    def lone(p):
        if out and _alike(out[-1], p):  # more of what stands beside it: a repeated group
            out[-1] = _merged(out[-1], p)
            out[-1][2] = True
        else:
            out.append([p[0], True, *p[2:]])

    i = j = 0
    while i < n or j < m:
        if i < n and j < m and same[i][j]:
            both = _merged(a[i], b[j])
            if out and _alike(out[-1], both):
                out[-1] = _merged(out[-1], both)
                out[-1][2] = True
            else:
                out.append(both)
            i, j = i + 1, j + 1
        elif j >= m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            lone(a[i])
            i += 1
        else:
            lone(b[j])
            j += 1
    return _bounded(out)


def _names(key: str) -> tuple[str, set[str]]:
    tag, *words = key.split(".")
    return tag, set(words)


def _is_gone(key: str) -> bool:
    """Whether an element is never seen as text."""
    tag, words = _names(key)
    return tag in NO_TEXT or ("hidden" in words and tag not in ("body", "html", "main"))


def _is_boiler(key: str, in_article: bool) -> bool:
    """Whether an element is boilerplate by its name."""
    tag, words = _names(key)
    return tag in DROPPED or (tag == "header" and not in_article) or (bool(words & BOILER) and tag not in ("body", "html", "main", "article"))


def _is_named(key: str, level: int) -> bool:
    """Whether an element is an article by its name: as such (level 0), or as what holds one."""
    tag, words = _names(key)
    return tag == "article" or "articlebody" in words if level == 0 else tag == "main" or bool(words & ARTICLE)


def _weights(wrapper: list) -> dict[int, float]:
    """Of each part, the text at and below it that is no link and not the template's; less of it in boilerplate by name,
    and none where the host has too few pages to say otherwise (but forms, which may hold a whole page)."""
    out: dict[int, float] = {}
    few = wrapper[3][0] < ALIKE

    def weigh(w) -> float:
        pages, chars, links, same = w[3]
        own = 0 if same is not None and pages >= ALIKE else max(0, chars - links)
        total = own + sum(weigh(p) for p in w[4])
        if _is_gone(w[0]):
            total = 0
        elif _is_boiler(w[0], False):
            total *= 0 if few and _names(w[0])[0] != "form" else BOILER_SHARE
        out[id(w)] = total
        return total

    weigh(wrapper)
    return out


def mark_main(wrapper: list) -> None:
    """Append to each part whether its text is the article's.

    The slots' choice is the part with most text that varies and is no link, narrowed down as long as one part below has
    MOST of it. Parts with an article's name take its place, those outside boilerplate first, unless on several pages the
    slots' choice has ARTICLE_SHARE times their text. In the article, elements of a boilerplate name are left out, and, where no name
    tells that it is one, so is the template's text. If a host's pages have no text that varies, they are all alike, and
    what they say is taken.
    """
    weights = _weights(wrapper)
    if not weights[id(wrapper)]:
        plain = json.loads(json.dumps(wrapper))

        def forget(w):
            w[3][3] = None
            for p in w[4]:
                forget(p)

        forget(plain)
        told = iter(_weights(plain).values())  # both are walked in the same order
        weights = dict(zip(_weights(wrapper), told, strict=True))

    few = wrapper[3][0] < ALIKE
    found: dict[tuple[bool, int], list] = {}

    def find(w, level, boiler):
        if _is_gone(w[0]):
            return
        if _is_named(w[0], level) and (weights[id(w)] or (few and not level)):
            found.setdefault((boiler, level), []).append(w)
        else:
            boiler = boiler or _is_boiler(w[0], False)
            for p in w[4]:
                find(p, level, boiler)

    for level in (0, 1):
        find(wrapper, level, False)
    at = wrapper
    while True:
        below = max(at[4], key=lambda p: weights[id(p)], default=None)
        if below is None or below[2] or weights[id(below)] < MOST * weights[id(at)] or (weights[id(below)] == 0):
            break
        at = below
    chosen, named = [at], False
    for key in ((False, 0), (False, 1), (True, 0), (True, 1)):
        if key in found:
            if few or ARTICLE_SHARE * sum(weights[id(w)] for w in found[key]) >= weights[id(at)]:
                chosen, named = found[key], True
            break
    chosen_ids = {id(w) for w in chosen}

    def mark(w, inside, article=False):
        article = article or _names(w[0])[0] in ("article", "main")
        if id(w) in chosen_ids:
            inside = True
        elif inside:
            pages, _, _, same = w[3]
            template = not named and same is not None and pages >= ALIKE and not w[4]
            inside = not _is_gone(w[0]) and not _is_boiler(w[0], article) and not template
        w.append(inside)
        for p in w[4]:
            mark(p, inside, article)

    mark(wrapper, False)


def main_text(page: Part, wrapper: list) -> str:
    """The text of a page in the parts of its host's wrapper that are the article, a block a paragraph. A page that has
    none of these parts is unlike the others of its host and is read by the wrapper that it is itself."""
    text, met = _laid_over(page, wrapper)
    if not met:
        mark_main(own := wrapper_of(page))
        text, _ = _laid_over(page, own)
    return text


def _laid_over(page: Part, wrapper: list) -> tuple[str, bool]:
    blocks: list[str] = []
    met = False
    now: list[str] = []

    def flush():
        said = " ".join(unescape("".join(now)).split())
        if said:
            blocks.append(said)
        now.clear()

    def walk(part: Part, w: list | None, inside: bool):
        nonlocal met
        met = met or inside
        if part.block:
            flush()
        parts, at = (w[4] if w else []), 0
        for item in part.items:
            if isinstance(item, tuple):
                if inside:
                    now.append(item[0])
                continue
            # the next part of the sequence that it matches, by its name if by no more; a repeated group starts anew
            here = [k for k in (*range(at, len(parts)), *range(at)) if parts[k][0] == item.key]
            found = None
            if here:
                kids = {p.key for p in item.items if isinstance(p, Part)} if item.key in GENERIC else set()
                at = next((k for k in here if _match(item.key, kids, _kids(parts[k]))), here[0])
                found = parts[at]
            walk(item, found, found[5] if found else inside and not item.boiler)
        if part.block:
            flush()

    walk(page, wrapper, wrapper[5])
    return "\n\n".join(blocks), met


def host_of(url: Column) -> Column:
    """The host in a URL, lower-cased, without port and user; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of ``pages``: page_id, url, text (empty if there is none), n_chars (code points).

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments of readers are no part of
    the text; character references are decoded, white space within a block is one space, blocks are joined by an empty
    line. A null or empty html gives an empty text; pages without a host are a host of their own. Repeated rows count
    as pages; further columns are ignored; an empty table gives an empty result.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))

    def infer(batches):
        import pyarrow as pa

        known: dict[str, list] = {}
        told = lambda: pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()), pa.array([json.dumps(w) for w in known.values()], pa.string())], names=["host", "wrapper"])
        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(known) >= HOSTS and host not in known:
                    yield told()
                    known.clear()
                own = wrapper_of(parse(html or ""))
                known[host] = _merged(known[host], own) if host in known else own
        if known:
            yield told()

    def merge(key, group):
        import pandas as pd

        wrapper = None
        for w in sorted(group["wrapper"]):
            wrapper = json.loads(w) if wrapper is None else _merged(wrapper, json.loads(w))
        return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(wrapper)], "part": [key[1]]})

    def apply(batches):
        import pyarrow as pa

        last: dict[str, list] = {}
        for batch in batches:
            texts = []
            for html, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                w = last.get(wrapper)
                if w is None:
                    if len(last) > 500:
                        last.clear()
                    w = last[wrapper] = json.loads(wrapper)
                    mark_main(w)
                texts.append(main_text(parse(html or ""), w))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    partial = rows.select("host", "html").mapInArrow(infer, "host string, wrapper string")
    wrappers = written(partial.withColumn("part", F.spark_partition_id()))
    parts = (wrappers.agg(F.max("part")).first()[0] or 0) + 1
    while True:  # a host's wrappers meet in a tree
        wrappers = wrappers.groupBy("host", F.floor(F.col("part") / FAN_IN).cast("int").alias("part")).applyInPandas(merge, "host string, wrapper string, part int")
        parts = -(-parts // FAN_IN)
        if parts == 1:
            break
    wrappers = written(wrappers.drop("part"))  # of known size: while small, pages stay where they are
    laid = rows.join(wrappers, "host", "left").select("page_id", "url", "html", "wrapper")
    kind = rows.schema["page_id"].dataType.simpleString()
    return laid.mapInArrow(apply, f"page_id {kind}, url string, text string, n_chars long")
