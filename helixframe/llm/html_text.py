"""Main text of HTML pages: flat text blocks classified by a decision tree on word counts and link densities.

One Arrow pass without a shuffle: a page is cut into blocks at block-level tags, a block's features are its own and
its neighbours' word count and link density, and what its enclosing elements are called; a small decision tree,
fitted from a labelled table of blocks, tells article text from the rest.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import chunks

#: Elements that don't break a line of text; every other tag ends a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never shown as text, or belongs to a control.
HIDDEN = frozenset("script style head title noscript template svg math iframe object canvas select textarea button datalist audio video".split())
#: Elements that may stand in a head; any other one, or text, ends it, as </head> may be left out.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Elements and names of classes or ids that hold what isn't the article.
OUTSIDE = frozenset("nav header footer aside form menu dialog".split())
OUTSIDE_NAMES = frozenset("nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer bottom sidebar aside widget related recommended ad ads advert adverts advertisement banner sponsor sponsored promo notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login form search comment comments commentlist reply replies respond disqus discussion share sharing social toolbar pagination pager tags copyright legal disclaimer hidden".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
#: Parts of a name after which the others tell how an element is laid out, not what it is: no-sidebar, overflow-hidden.
LAYOUT = frozenset("no not has have with without overflow backface".split())
#: Part of a page's words that an element holds if it is taken for the whole page.
NEARLY_ALL = 0.9
#: Elements and names that hold the article.
INSIDE = frozenset("article main".split())
INSIDE_NAMES = frozenset("article post entry content story body main text articlebody".split())

#: A quote opens a value only after an equals sign, and only if it is closed somewhere. Possessive repeats keep it linear.
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(>|$)|([^<]++|<)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|aria-hidden|hidden|style|itemprop)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "title", "textarea", "noscript", "iframe", "template")}
SPACE = re.compile(r"\s+")

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "outside", "inside", "page_has_inside", "heading_or_paragraph")

#: Fixed values of the labelled table: words and link densities of a block, and what stands before and after it.
WORDS = (1, 3, 6, 15, 40, 150)
DENSITIES = (0.0, 0.2, 0.5, 1.0)
NEIGHBOURS = ((0, 0.0, 0, 0.0), (1, 1.0, 2, 1.0), (2, 1.0, 60, 0.0), (50, 0.0, 45, 0.1), (90, 0.0, 3, 1.0), (4, 0.0, 3, 0.0))


@lru_cache(1)
def labelled() -> np.ndarray:
    """Labelled blocks, one a row: the features in order, then 1 for article text.

    Every kind of block comes with every word count, density and neighbourhood. Inside a marked article all text
    is the article's, and none of what stands in menus, footers, adverts, comments and the like, or beside a
    marked article. In a page without marks, text with few links is the article's if it is long, alone, or next
    to a long text with few links.
    """
    rows = []
    for words in WORDS:
        for density in DENSITIES:
            for around in NEIGHBOURS:
                for outside, inside, marked in ((0, 1, 1), (1, 1, 1), (1, 0, 1), (0, 0, 1), (1, 0, 0), (0, 0, 0)):
                    long_by = max(around[0] * (around[1] < 0.3), around[2] * (around[3] < 0.3)) >= 20
                    article = inside if marked else density < 0.3 and (words >= 10 or long_by or not any(around))
                    rows.append((words, density, *around, outside, inside, marked, words > 3, int(article and not outside)))
    return np.array(rows, float)


Node = tuple | int


def gini(y: np.ndarray) -> float:
    p = y.mean() if len(y) else 0.0
    return 2 * p * (1 - p)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9) -> Node:
    """A binary tree of (feature, threshold, at or below, above); the first best split wins, so it is the same every time."""
    if depth == 0 or len(set(y.tolist())) < 2:
        return int(2 * y.sum() >= len(y))
    best, split = gini(y) - 1e-9, None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in ((values[1:] + values[:-1]) / 2).tolist():
            low = x[:, f] <= t
            g = (low.sum() * gini(y[low]) + (~low).sum() * gini(y[~low])) / len(y)
            if g < best:
                best, split = g, (f, t)
    if split is None:
        return int(2 * y.sum() >= len(y))
    low = x[:, split[0]] <= split[1]
    return (*split, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


@lru_cache(1)
def tree() -> Node:
    table = labelled()
    return grow(table[:, :-1], table[:, -1])


def keeps(node: Node, row: tuple) -> bool:
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return bool(node)


@lru_cache(4096)
def names(attributes: str) -> tuple[bool, int, bool]:
    """What an element's attributes say: that it is outside by role or hidden, by a name (2: a name of its own, 1: a part of one), and inside by name or role."""
    outside, named, inside = False, 0, False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id", "itemprop"):
            for word in value.split():
                parts = re.split(r"[^a-z]+", word)
                inside |= not INSIDE_NAMES.isdisjoint(parts)
                layout = next((i for i, x in enumerate(parts) if x in LAYOUT), len(parts))
                if not OUTSIDE_NAMES.isdisjoint(parts[:layout]):
                    named = max(named, 2 if word in OUTSIDE_NAMES else 1)
        elif key == "role":
            outside |= value in OUTSIDE_ROLES
            inside |= value in ("main", "article")
        elif key == "style":
            outside |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
        else:
            outside |= key == "hidden" or value == "true"
    return outside, named, inside


Block = tuple[str, int, int, bool, bool, bool]


def blocks(page: str) -> list[Block]:
    """Text blocks in page order: text, words, words in links, outside, inside, heading or paragraph."""
    found, holders, wrappers = parsed(page)
    # An element that is outside by its name only, but is as good as the whole page, is no part beside the article.
    total = sum(b[1] for b in found if not b[3])
    freed: set[int] = set()
    held = Counter()
    for b, h in zip(found, holders, strict=True):
        if not b[3]:
            held.update(dict.fromkeys(h, b[1]))
    for e, (_, marks) in enumerate(wrappers):
        if total and held[e] >= NEARLY_ALL * total:
            within = [e in h for h in holders]
            now = settled(found, holders, wrappers, freed)
            rest = [b for b, w in zip(now, within, strict=True) if not w]
            if not any(b[4] for b in rest) and (marks or not any(kept(rest))):
                freed.add(e)
    return settled(found, holders, wrappers, freed) if wrappers else found


def settled(found: list[Block], holders: list[tuple[int, ...]], wrappers: list[tuple[bool, bool]], freed: set[int]) -> list[Block]:
    """The blocks with what the elements that are outside by name say of them; freed ones count for what else they are."""
    return [(*b[:3], b[3] or not freed.issuperset(h), b[4] or any(wrappers[e][0] for e in freed.intersection(h)), b[5]) for b, h in zip(found, holders, strict=True)]


def parsed(page: str) -> tuple[list[Block], list[tuple[int, ...]], list[tuple[bool, bool]]]:
    """The blocks without what names say against them, for each the elements around it that are outside by name, and of these elements whether they are inside otherwise and whether an article or main stands in them."""
    out, parts, linked = [], [], []
    holders: list[tuple[int, ...]] = []
    wrappers: list[list[bool]] = []
    around: list[int] = []
    stack: list[tuple[str, bool, bool, bool]] = []
    opened: Counter[str] = Counter()
    outside = inside = articles = 0
    link, kind = 0, ""
    at, end = 0, len(page)

    def close() -> None:
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append((text, text.count(" ") + 1, len(html.unescape(" ".join(linked)).split()), outside > 0, inside > 0, kind in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td")))
                holders.append(tuple(around))
            parts.clear()
            linked.clear()

    def pop(i: int) -> None:
        nonlocal outside, inside, articles
        for element, o, n, w in stack[i:]:
            opened[element] -= 1
            outside -= o
            inside -= n
            articles -= element == "article"
            if w:
                around.pop()
        del stack[i:]

    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        slash, name, attributes, ending, text = m.group(1, 2, 3, 4, 5)
        if name and not ending:  # a tag that nothing ends is the page's end
            break
        if text is not None:
            if stack and stack[-1][0] == "head" and not text.isspace():
                close()
                pop(len(stack) - 1)
            parts.append(text)
            if link:
                linked.append(text)
            continue
        if name is None:
            continue
        name = name.lower()
        if name == "a":
            link = 0 if slash else 1
        if name not in INLINE:
            close()
            link = 0
        if slash:
            for i in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[i][0] == name:
                    pop(i)
                    break
            if name not in INLINE:
                kind = ""
            continue
        if stack and stack[-1][0] == "head" and name not in HEAD:
            close()
            pop(len(stack) - 1)
        if name in RAW_END and not attributes.endswith("/"):
            m = RAW_END[name].search(page, at)
            at = m.end() if m else end
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if name not in INLINE:
            kind = name
            if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1][0] == name:
                pop(len(stack) - 1)  # these end where the next begins
        o, named, n = names(attributes) if attributes else (False, 0, False)
        if name in ("body", "html"):
            o, named, n = False, 0, False
        o = o or name in OUTSIDE or name in HIDDEN
        n = not o and (n or name in INSIDE)
        # A main is the page's one; an article is something else by a name of its own, or as a part of another article.
        w = not o and (named == 2 or articles > 0 if name == "article" else name != "main") and named > 0
        if o or n or w or name not in INLINE:
            if (o or w) and name in INLINE:
                close()
            if not o and not w and name in INSIDE:
                for e in around:
                    wrappers[e][1] = True
            if w:
                around.append(len(wrappers))
                wrappers.append([n, False])
                n = False
            stack.append((name, o, n, w))
            opened[name] += 1
            outside += o
            inside += n
            articles += name == "article"
    close()
    return out, holders, [(n, marks) for n, marks in wrappers]


def kept(found: list[Block]) -> list[bool]:
    """Whether the tree takes each block for article text."""
    marked = any(b[4] for b in found)
    density = [b[2] / b[1] for b in found]
    model, out = tree(), []
    for i, (_, words, _, outside, inside, paragraph) in enumerate(found):
        before, after = i > 0, i + 1 < len(found)
        row = (words, density[i], found[i - 1][1] if before else 0, density[i - 1] if before else 0, found[i + 1][1] if after else 0, density[i + 1] if after else 0, outside, inside, marked, paragraph)
        out.append(keeps(model, row))
    return out


def main_text(page: str) -> str:
    """The blocks that the tree takes for article text, joined in page order by one space."""
    found = blocks(page)
    return " ".join(b[0] for b, keep in zip(found, kept(found), strict=True) if keep)


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page: its main text, empty if there is none, and its code points.

    Null html counts as empty; null ids and urls are kept; repeated rows are done each; an empty table gives no
    rows. A tag that nothing ends is dropped with what it swallowed, as browsers do. Other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "html"):
                texts = [main_text(page or "") for page in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
