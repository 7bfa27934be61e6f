"""Main text of web pages: flat blocks, judged by a decision tree over their own and their neighbours' figures."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import steps
from .labelled_pages import MAIN, PAGES

#: Elements whose content is no text, elements that start a block, elements that mark page furniture, elements and words in
#: class, id and role that hint at it, and elements and words that mark or hint at the article.
SILENT = "script style noscript template svg math textarea select option iframe object canvas audio video head title"
BLOCK = """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul"""
FURNITURE = "nav header footer aside menu button dialog legend"
WRAPPERS = "form fieldset"
HINTS = """ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo
complementary cookie cookies copyright dialog disqus discussion footer form gdpr header login masthead menu menubar modal nav navbar navigation
newsletter notice notices notification pager pagination popup privacy promo promotion related replies reply respond search share sharing
sidebar signup social sponsor sponsored subscribe subscription teaser toolbar topbar warning widget widgets alert"""
ARTICLE = "article main"
ARTICLE_HINTS = "article articlebody content entry main post story"
#: Hints at what readers wrote and at other articles: an article below them is one of theirs.
OTHERS = "comment comments commentlist disqus discussion related replies reply respond teaser"
#: Words that, right before or after a hint, say that the page has or lacks such a part, not that the element is one.
BEFORE = "with without no non not has have show hide"
AFTER = "free less off open closed enabled disabled"
#: Silent elements that reach to the end of the page if they have no end tag; the tags of the others are then passed over alone.
ENDLESS = "script style textarea"
VOID = "area base br col embed hr img input link meta param source track wbr"

_SETS = {k: frozenset(v.split()) for k, v in (
    ("silent", SILENT), ("block", BLOCK), ("furniture", FURNITURE), ("hints", HINTS), ("article", ARTICLE), ("near", ARTICLE_HINTS), ("void", VOID),
    ("wrappers", WRAPPERS), ("others", OTHERS), ("before", BEFORE), ("after", AFTER), ("endless", ENDLESS))}
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|([^<]++|<)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z]+")

#: Plain words in no furniture from which on a page has its text there, and no furniture mark is a wrapper of all of it.
ELSEWHERE = 40
#: What the tree sees of that number is at most this.
MOST_ELSEWHERE = 999

#: What the tree looks at, in this order. Furniture and article are 2 by an element, 1 by a hint and 0 if nothing says so, both by the
#: nearest marks; share is that of the page's plain words below the nearest furniture mark, 0 if the page has ELSEWHERE words in no furniture;
#: elsewhere is the number of plain words in no furniture.
FEATURES = ("furniture", "article", "words", "link_density", "words_before", "links_before", "words_after", "links_after", "share", "elsewhere")

#: Blocks of hand-made pages: words, link density, the same of the block before and of the block after, then 1 if the block is main text.
#: Menus, headers, footers, adverts, notices, forms, comments, marked as such.
MARKED = (
    (1, 1.00, 0, 0.0, 1, 1.0, 0), (2, 1.00, 1, 1.0, 2, 1.0, 0), (9, 0.00, 1, 1.0, 12, 0.0, 0), (40, 0.05, 60, 0.0, 30, 0.0, 0), (14, 0.00, 80, 0.0, 0, 0.0, 0),
    (22, 0.10, 70, 0.0, 55, 0.0, 0), (1, 1.00, 1, 1.0, 35, 0.0, 0), (65, 0.00, 4, 0.0, 50, 0.0, 0), (90, 0.00, 45, 0.0, 60, 0.0, 0), (6, 0.00, 30, 0.0, 28, 0.0, 0),
    (25, 0.40, 20, 0.5, 0, 0.0, 0), (3, 0.00, 5, 0.0, 8, 0.0, 0), (40, 0.00, 30, 0.0, 0, 0.0, 0), (120, 0.00, 0, 0.0, 3, 1.0, 0), (200, 0.00, 90, 0.0, 90, 0.0, 0),
)
#: Inside the article: headings, paragraphs, lists, single words, links.
INSIDE = (
    (8, 0.00, 9, 0.0, 60, 0.0, 1), (1, 0.00, 1, 1.0, 0, 0.0, 1), (75, 0.02, 8, 0.0, 50, 0.0, 1), (4, 1.00, 50, 0.0, 30, 0.0, 1), (2, 0.00, 2, 0.0, 2, 0.0, 1),
    (30, 0.60, 20, 0.5, 20, 0.5, 1), (150, 0.00, 0, 0.0, 14, 0.0, 1), (12, 0.00, 6, 1.0, 12, 0.0, 1), (3, 0.00, 90, 0.0, 14, 0.0, 1), (20, 0.00, 1, 1.0, 1, 1.0, 1),
    (1, 1.00, 1, 1.0, 1, 1.0, 1), (5, 0.00, 0, 0.0, 0, 0.0, 1),
)
#: Pages without marks: long blocks, and short ones between long ones, are text; link lists and lone short lines are not.
PLAIN = (
    (60, 0.00, 40, 0.0, 55, 0.0, 1), (35, 0.05, 9, 0.0, 70, 0.0, 1), (120, 0.10, 3, 1.0, 20, 0.0, 1), (28, 0.00, 45, 0.0, 3, 1.0, 1), (18, 0.00, 50, 0.0, 48, 0.0, 1),
    (8, 0.00, 55, 0.0, 60, 0.0, 1), (7, 0.00, 2, 1.0, 65, 0.0, 1), (22, 0.15, 30, 0.0, 33, 0.1, 1), (2, 0.00, 60, 0.0, 60, 0.0, 1), (3, 0.00, 40, 0.1, 80, 0.0, 1),
    (45, 0.20, 60, 0.0, 2, 1.0, 1), (16, 0.00, 0, 0.0, 44, 0.0, 1),
    (2, 1.00, 2, 1.0, 2, 1.0, 0), (1, 1.00, 0, 0.0, 1, 1.0, 0), (6, 0.90, 3, 1.0, 5, 0.8, 0), (3, 0.00, 2, 1.0, 1, 1.0, 0), (25, 0.85, 10, 0.9, 12, 1.0, 0),
    (5, 0.00, 4, 0.6, 3, 0.0, 0), (9, 0.00, 6, 0.0, 0, 0.0, 0), (12, 0.50, 3, 0.0, 5, 0.7, 0), (1, 1.00, 1, 1.0, 60, 0.0, 0), (2, 1.00, 0, 0.0, 75, 0.0, 0),
    (3, 1.00, 60, 0.0, 50, 0.0, 0), (4, 0.90, 70, 0.0, 1, 1.0, 0), (40, 0.70, 5, 1.0, 30, 0.8, 0), (4, 0.00, 1, 1.0, 6, 0.0, 0), (10, 0.60, 50, 0.0, 3, 1.0, 0),
    (2, 0.00, 3, 0.0, 2, 0.0, 0),
)
#: Below a hint at the article: short lines are text too, links are not.
NEAR = (
    (60, 0.00, 40, 0.0, 55, 0.0, 1), (3, 0.00, 2, 1.0, 1, 1.0, 1), (8, 0.00, 9, 0.0, 60, 0.0, 1), (2, 0.00, 2, 0.0, 2, 0.0, 1), (120, 0.10, 3, 1.0, 20, 0.0, 1),
    (9, 0.00, 6, 0.0, 0, 0.0, 1), (22, 0.15, 30, 0.0, 33, 0.1, 1), (45, 0.20, 60, 0.0, 2, 1.0, 1), (5, 0.00, 0, 0.0, 0, 0.0, 1), (30, 0.40, 40, 0.0, 20, 0.5, 1),
    (2, 1.00, 2, 1.0, 2, 1.0, 0), (6, 0.90, 3, 1.0, 5, 0.8, 0), (25, 0.85, 10, 0.9, 12, 1.0, 0), (3, 1.00, 60, 0.0, 50, 0.0, 0), (40, 0.70, 5, 1.0, 30, 0.8, 0),
    (10, 0.60, 50, 0.0, 3, 1.0, 0), (1, 1.00, 1, 1.0, 60, 0.0, 0), (4, 0.90, 70, 0.0, 1, 1.0, 0),
)


#: Pages of a few plain words in all: what is not a link is text.
SHORT = (
    (1, 0.00, 0, 0.0, 0, 0.0, 1), (5, 0.00, 0, 0.0, 0, 0.0, 1), (9, 0.00, 6, 0.0, 0, 0.0, 1), (2, 0.00, 0, 0.0, 8, 0.0, 1), (8, 0.00, 2, 0.0, 3, 0.0, 1),
    (25, 0.10, 3, 0.0, 0, 0.0, 1), (12, 0.00, 2, 1.0, 0, 0.0, 1), (6, 0.30, 0, 0.0, 7, 0.0, 1), (4, 0.00, 4, 0.0, 4, 0.0, 1), (18, 0.20, 2, 1.0, 3, 1.0, 1),
    (1, 1.00, 0, 0.0, 5, 0.0, 0), (2, 1.00, 2, 1.0, 2, 1.0, 0), (3, 0.90, 9, 0.0, 0, 0.0, 0), (12, 0.80, 1, 1.0, 1, 1.0, 0), (2, 1.00, 0, 0.0, 0, 0.0, 0),
    (7, 0.70, 3, 1.0, 12, 0.0, 0),
)


def _labelled() -> Iterator[tuple]:
    """Rows of FEATURES and the label. Marks and figures disagree where a mark of furniture holds nearly all words of a page: it then is a
    wrapper, and its blocks are judged like those of a page without marks. The blocks of hand-labelled whole pages come last."""
    for blocks, furniture, article, shares, elsewhere in (
            (MARKED, (1, 2), (0, 1, 2), (0.0, 0.1, 0.4, 0.6), (0, 25, 300)), (PLAIN, (1, 2), (0, 1, 2), (0.8, 0.9, 1.0), (0, 25)),
            (INSIDE, (0,), (2,), (0.0,), (5, 60, 300)), (PLAIN, (0,), (0,), (0.0,), (60, 300)), (NEAR, (0,), (1,), (0.0,), (60, 300)),
            (SHORT, (0,), (0, 1), (0.0,), (0, 10, 25, 35))):
        for f, a, share, e, (*figures, label) in product(furniture, article, shares, elsewhere, blocks):
            yield (f, a, *figures, share, e, label)
    for page in PAGES:
        for row, text in figures_of(page):
            yield (*row, int(text.startswith(MAIN)))


def figures_of(page: str) -> Iterator[tuple[tuple, str]]:
    """(FEATURES, text) of each block of a page."""
    found = blocks(page)
    elsewhere = sum(words * (1 - density) for _, words, density, furniture, *_ in found if not furniture)
    for i, (text, words, density, furniture, article, share) in enumerate(found):
        _, w0, d0, *_ = found[i - 1] if i else ("", 0, 0.0)
        _, w1, d1, *_ = found[i + 1] if i + 1 < len(found) else ("", 0, 0.0)
        yield (furniture, article, words, density, w0, d0, w1, d1, share if elsewhere < ELSEWHERE else 0.0, min(elsewhere, MOST_ELSEWHERE)), text


@lru_cache(maxsize=1)
def labelled() -> tuple:
    """The labelled table: blocks by FEATURES, then 1 if the block is main text."""
    return tuple(_labelled())


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 12) -> tuple:
    """A binary tree by least Gini impurity: (feature, threshold, below, above) or (share of ones,)."""
    share = labels.mean()
    best = None
    if depth and 0 < share < 1:
        for f in range(rows.shape[1]):
            values = np.unique(rows[:, f])
            for cut in (values[:-1] + values[1:]) / 2:
                low = rows[:, f] <= cut
                a, b = labels[low], labels[~low]
                cost = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, f, cut)
    if best is None:
        return (float(share),)
    low = rows[:, best[1]] <= best[2]
    return (best[1], float(best[2]), grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1))


@lru_cache(maxsize=1)
def tree() -> tuple:
    table = np.array(labelled(), dtype=float)
    return grow(table[:, :-1], table[:, -1])


def is_text(features: tuple, node: tuple | None = None) -> bool:
    node = node or tree()
    while len(node) > 1:
        node = node[2] if features[node[0]] <= node[1] else node[3]
    return node[0] >= 0.5


def _marks(name: str, attributes: str) -> tuple[int, int, bool]:
    """(page furniture, article, hidden) by the element's name and the words of its class, id and role.

    2 by the name, 1 by a word; a word that names readers' comments or other articles counts as much as a name, so that an
    ``article`` inside is one of them. Hidden is what has that attribute, is hidden by ``aria-hidden`` or by its style.
    """
    if name in ("html", "body"):
        return 0, 0, False
    furniture, article = 2 * (name in _SETS["furniture"]) or int(name in _SETS["wrappers"]), 2 * (name in _SETS["article"])
    if not attributes.strip(" \t\n\r\f/"):
        return furniture, article, False
    given: dict[str, str] = {}
    for key, *values in _ATTRIBUTE.findall(attributes):
        given.setdefault(key.lower(), "".join(values).lower())
    for token in f"{given.get('class', '')} {given.get('id', '')} {given.get('role', '')}".split():
        words = _WORD.findall(token)
        article = article or int(not _SETS["near"].isdisjoint(words))
        if furniture < 2 and not _SETS["hints"].isdisjoint(words):
            for x, w, y in zip(["", *words], words, [*words[1:], ""], strict=False):
                if w in _SETS["hints"] and x not in _SETS["before"] and y not in _SETS["after"]:
                    furniture = max(furniture, 1 + (w in _SETS["others"]))
    hidden = "hidden" in given or given.get("aria-hidden") == "true" or bool(_NO_DISPLAY.search(given.get("style", "")))
    return furniture, article, hidden


def blocks(page: str) -> list[tuple[str, int, float, int, int, float]]:
    """(text, words, link density, furniture, article, share) of each flat block with text, in page order.

    The nearest marks decide: an article below a hint at furniture is no furniture, furniture inside the article is both. What is hidden stays
    furniture whatever lies inside.
    """
    out: list[tuple[str, int, float, int, int]] = []
    stack: list[tuple[str, tuple]] = []
    parts: list[str] = []
    linked: list[str] = []
    links = 0
    silent = set()  # names without a further end tag
    state = (0, 0, 0, False)  # furniture, article, the element that marks the furniture, hidden
    outer, under, owners = [0], [0.0], []  # by element that marks furniture: the one around it, plain words below; that of each block

    def close_block() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                anchor = " ".join("".join(linked).split())
                words, density = text.count(" ") + 1, len(anchor) / len(text)
                out.append((text, words, density, state[0], state[1]))
                owners.append(0 if state[3] else state[2])
                if not state[3]:
                    under[state[2]] += words * (1 - density)
            parts.clear()
            linked.clear()

    at = 0
    while m := _TOKEN.search(page, at):
        at = m.end()
        closing, name, attributes, chunk = m.groups()
        if chunk is not None:
            chunk = html.unescape(chunk)
            parts.append(chunk)
            if links:
                linked.append(chunk)
            continue
        if m[0].startswith("<![CDATA["):
            continue
        if name is None:
            continue
        name = name.lower()
        if name in _SETS["silent"]:
            if not closing and not attributes.endswith("/") and name not in ("head", "option") and name not in silent:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                if end or name in _SETS["endless"]:
                    at = end.end() if end else len(page)
                else:
                    silent.add(name)
            if name in ("head", "option"):
                close_block()
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name == "a":
            links = 0 if closing else 1
            continue
        is_block = name in _SETS["block"]
        if is_block:
            close_block()
            links = 0
        if name in _SETS["void"]:
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if not is_block and state != stack[i][1]:
                        close_block()
                    state = stack[i][1]
                    del stack[i:]
                    break
        elif not attributes.endswith("/"):
            f, a, h = _marks(name, attributes)
            marked = bool(f or a or h)
            if marked:
                close_block()
            if is_block or marked:
                if name in ("p", "li") and any(s[0] == name for s in stack[-1:]):
                    state = stack.pop()[1]  # a new paragraph ends the one before
                stack.append((name, state))
                furniture, article, owner, hidden = state
                if h or hidden:
                    state = (2, max(a, article), owner, True)
                elif f:
                    outer.append(owner)
                    under.append(0.0)
                    state = (f, max(a, article), len(outer) - 1, False)
                elif a == 2 and furniture < 2:
                    state = (0, 2, 0, False)
                elif a:
                    state = (furniture, max(a, article), owner, False)
    close_block()
    total = sum(under)
    for i in range(len(outer) - 1, 0, -1):  # inner ones come later
        if outer[i]:
            under[outer[i]] += under[i]
    return [(*block, under[o] / total if o and total else 0.0) for block, o in zip(out, owners, strict=True)]


def main_text(page: str | None) -> str:
    """The blocks that the tree takes for main text, joined by line ends; empty if there are none."""
    return "\n".join(text for row, text in figures_of(page or "") if is_text(row))


def extract(df: DataFrame, page: str = "html", out: str = "text") -> DataFrame:
    """``df`` with ``out``, the main text of the whole page.

    A page is cut into flat blocks at block elements; scripts, styles and the like are passed over. Each block has its word count, its link
    density, those of its neighbours, how far it is marked as page furniture (menus, headers, footers, sidebars, notices, adverts, forms,
    comments) or as the article, and how many of the page's words lie below that mark and outside of furniture. A decision tree grown from the
    labelled table says which blocks are main text.

    A null or empty page, and one without main text, gives the empty text. Rows keep their number and order; a column named like ``out`` is
    replaced. Nothing is shuffled.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, page):
                texts = [main_text(h) for h in part.column(page).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, out])

    chosen = df.select(*kept)
    return chosen.mapInArrow(run, df.select(*kept).schema.add(out, "string"))
