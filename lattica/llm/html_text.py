"""Main text of web pages: flat text blocks classified by a small decision tree.

A page becomes a flat list of text blocks, cut at block-level tags. Each block has its
word count and link density, those of its neighbours before and after, what stands
around it: page furniture (nav, header, footer, aside, form), a telling class or id
(advert, cookie, comment, ...), an article or main element; and, of the page, how much of
its running text stands in neither furniture nor telling elements and whether it marks an
article. A decision tree of Gini
splits, trained here on the labelled blocks of ``LABELLED``, says which are main text.
Class words are one feature among these: those of an article or main element say
nothing, and where all text of a page stands under one they do not hide it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.text import as_strings

_TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*)                                               # comment
      | <(script|style|textarea|title)(?![\w:.-])                         # raw text, unless the tag closes itself
            (?!(?:=\s*[^\s"'>]+|[^>"'/=]|/(?!>)|=|"[^"]*"|'[^']*')*+/>)
            (?:[^>"']|"[^"]*"|'[^']*')*+>(?:.*?</\1(?=[\s/>])[^>]*>|.*)
      | <(/?)([a-zA-Z][\w:.-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>           # tag
      | <[!?][^>]*>                                                     # declaration
      | <[/a-zA-Z!?][^>]*(?:>|\Z)                                       # broken tag
      | ([^<]+|<)                                                       # text
    """,
    re.S | re.X | re.I,
)
#: Elements whose content is no text of the page.
_HIDDEN = frozenset("noscript template svg iframe select button option object".split())
_ANY_HIDDEN = re.compile(rf"<(?:{'|'.join(sorted(_HIDDEN))})(?![\w:.-])", re.I)
_SELF_CLOSED = re.compile(r"""(?:=\s*[^\s"']+|[^"'/=]|/(?!\Z)|=|"[^"]*"|'[^']*')*+/\Z""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BREAKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_KEPT_OPEN = frozenset("address article aside blockquote body details dialog div dl fieldset figure footer form header li main menu nav ol section span table td ul".split())
_FURNITURE = frozenset("nav footer aside form menu dialog fieldset".split())
_ATTRIBUTE = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_TELLING = frozenset(
    "ad ads advert advertisement advertising adsense banner promo promoted promotion sponsor sponsored sponsors cookie cookies consent gdpr notice alert warning modal popup overlay subscribe subscription newsletter signup login share sharing social follow sidebar side widget widgets related recommended recommendations trending menu navigation nav navbar breadcrumb breadcrumbs pagination pager footer header masthead topbar toolbar comment comments commentlist disqus replies reply respond copyright legal disclaimer skip search contentinfo complementary toc tags".split()
)
_WORDS = re.compile(r"\S+")
_SPACE = re.compile(r"\s+")


class Block(NamedTuple):
    text: str
    words: int
    link_density: float
    furniture: int
    telling: int
    article: int


def _hidden_spans(page: str) -> dict[int, int]:
    """Start and end of the hidden elements whose end tag comes before that of their parent."""
    spans: dict[int, int] = {}
    if not _ANY_HIDDEN.search(page):
        return spans
    stack: list[tuple[str, int]] = []
    is_open: Counter[str] = Counter()

    def pop(name: str) -> int:
        while True:
            last, start = stack.pop()
            is_open[last] -= 1
            if last == name:
                return start

    for m in _TOKEN.finditer(page):
        if m[3] is None or (name := m[3].lower()) in _VOID:
            continue
        if m[2]:
            if is_open[name]:
                start = pop(name)
                if name in _HIDDEN:
                    spans[start] = m.end()
        elif not _SELF_CLOSED.match(m[4]):
            if name in ("button", "option", "select") and is_open[name]:
                pop(name)
            stack.append((name, m.start()))
            is_open[name] += 1
    return spans


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order.

    A hidden element without its end tag ends at the next block-level tag, at a line
    break or with its parent.
    """
    out: list[Block] = []
    spans = _hidden_spans(page)
    skip_to = 0
    # Elements open within a hidden one that lacks its end tag
    loose: int | None = None
    pieces: list[str] = []
    linked = 0
    # name, furniture, telling class, article: each open element adds to what is around it
    stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]
    in_link = False

    def close() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
        if text:
            words = len(_WORDS.findall(text))
            out.append(Block(text, words, min(1.0, linked / words), *stack[-1][1:]))
        pieces.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        if m.start() < skip_to:
            continue
        if (text := m[5]) is not None:
            if loose is not None:
                continue
            pieces.append(text)
            if in_link:
                linked += len(_WORDS.findall(text))
            continue
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name in _HIDDEN and not m[2]:
            if m.start() in spans:
                skip_to = spans[m.start()]
            elif loose is None and not _SELF_CLOSED.match(m[4]):
                loose = 0
            continue
        if loose is not None:
            if name in _BREAKS or name == "br":
                loose = None
            elif m[2]:
                loose = loose - 1 if loose else None
            elif name not in _VOID and not _SELF_CLOSED.match(m[4]):
                loose += 1
            if loose is not None:
                continue
        if name == "a":
            in_link = not m[2]
        elif name == "br":
            pieces.append(" ")
        if name in _BREAKS:
            close()
        if name not in _KEPT_OPEN:
            continue
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        elif not m[4].endswith("/"):
            _, furniture, telling, article = stack[-1]
            if name in ("article", "main") and not telling and not (furniture and any(s[0] in ("aside", "form") for s in stack)):
                furniture, article = 0, 1
            elif name in _FURNITURE or name == "header" and not article:
                furniture = 1
            if m[4] and not telling and name not in ("article", "main"):
                telling = int(any(not _TELLING.isdisjoint(re.split(r"[^a-z]+", v.lower())) for v in _ATTRIBUTE.findall(m[4])) and name != "body")
            stack.append((name, furniture, telling, article))
    close()
    return out


def features(rows: list[tuple[int, float, int, int, int]]) -> np.ndarray:
    """Words, link density, both of the block before and after (0, 0 at the ends), surroundings,
    the share of the page's unlinked words outside furniture and telling elements, and
    whether the page marks an article."""
    own = np.array(rows, float).reshape(-1, 5)
    edge = np.zeros((1, 2))
    before, after = np.vstack([edge, own[:-1, :2]]), np.vstack([own[1:, :2], edge])
    running = own[:, 0] * (1 - own[:, 1])
    plain = running[(own[:, 2] == 0) & (own[:, 3] == 0)].sum() / max(running.sum(), 1.0)
    marked = float(own[:, 4].any())
    return np.hstack([own[:, :2], before, after, own[:, 2:], np.full((len(own), 2), (plain, marked))])


#: Labelled pages: (words, link density, in furniture, telling class, in an article, main text).
LABELLED: tuple[tuple[tuple[int, float, int, int, int, int], ...], ...] = (
    # A news page with everything marked up.
    ((1, 1.0, 1, 0, 0, 0), (1, 1.0, 1, 0, 0, 0), (2, 1.0, 1, 0, 0, 0), (8, 0.0, 0, 1, 0, 0), (9, 0.0, 0, 0, 1, 1), (45, 0.0, 0, 0, 1, 1), (80, 0.02, 0, 0, 1, 1), (3, 0.0, 0, 0, 1, 1), (60, 0.05, 0, 0, 1, 1), (1, 0.0, 0, 0, 1, 1), (25, 0.0, 0, 1, 1, 0), (30, 0.0, 0, 0, 1, 1), (9, 0.1, 1, 0, 0, 0)),
    # The same with reader comments, related links and a form after the article.
    ((3, 1.0, 1, 0, 0, 0), (6, 0.0, 1, 0, 0, 0), (7, 0.0, 0, 0, 1, 1), (100, 0.0, 0, 0, 1, 1), (5, 0.0, 0, 0, 1, 1), (12, 0.0, 0, 0, 1, 1), (2, 0.0, 0, 1, 0, 0), (40, 0.0, 0, 1, 0, 0), (70, 0.0, 0, 1, 0, 0), (5, 1.0, 0, 1, 0, 0), (6, 1.0, 0, 1, 0, 0), (10, 0.0, 1, 0, 0, 0), (30, 0.0, 1, 1, 0, 0), (12, 0.3, 1, 0, 0, 0)),
    # A page of plain div elements: only length and links tell.
    ((2, 1.0, 0, 0, 0, 0), (1, 1.0, 0, 0, 0, 0), (3, 0.7, 0, 0, 0, 0), (7, 0.0, 0, 0, 0, 1), (50, 0.0, 0, 0, 0, 1), (90, 0.1, 0, 0, 0, 1), (15, 0.0, 0, 0, 0, 1), (65, 0.0, 0, 0, 0, 1), (4, 0.0, 0, 0, 0, 1), (40, 0.0, 0, 0, 0, 1), (8, 1.0, 0, 0, 0, 0), (6, 0.8, 0, 0, 0, 0), (9, 0.2, 0, 0, 0, 0)),
    # Plain again: long link lists, a short story, a notice at the end.
    ((20, 1.0, 0, 0, 0, 0), (35, 0.9, 0, 0, 0, 0), (25, 0.6, 0, 0, 0, 0), (6, 0.0, 0, 0, 0, 1), (28, 0.0, 0, 0, 0, 1), (33, 0.0, 0, 0, 0, 1), (22, 0.1, 0, 0, 0, 1), (30, 0.8, 0, 0, 0, 0), (5, 0.4, 0, 0, 0, 0), (4, 0.0, 0, 0, 0, 0)),
    # A menu bar, an article full of links, a sidebar.
    ((4, 1.0, 1, 0, 0, 0), (30, 0.0, 1, 0, 0, 0), (10, 0.3, 0, 0, 1, 1), (55, 0.4, 0, 0, 1, 1), (12, 0.5, 0, 0, 1, 1), (38, 0.3, 0, 0, 1, 1), (6, 1.0, 1, 0, 0, 0), (45, 0.0, 1, 0, 0, 0), (50, 0.1, 1, 1, 0, 0), (15, 1.0, 1, 1, 0, 0)),
    # Adverts and share buttons within an article; tags and links at its end.
    ((3, 0.0, 0, 0, 1, 1), (20, 0.0, 0, 1, 1, 0), (44, 0.0, 0, 0, 1, 1), (4, 1.0, 0, 1, 1, 0), (7, 0.0, 0, 0, 1, 1), (18, 0.0, 1, 0, 1, 0), (51, 0.0, 0, 0, 1, 1), (2, 0.5, 0, 0, 1, 1), (9, 0.0, 0, 0, 1, 1), (3, 1.0, 0, 0, 1, 0), (5, 1.0, 0, 0, 1, 0), (4, 0.9, 0, 0, 1, 0)),
    # A cookie notice first, then text without any article element.
    ((40, 0.1, 0, 1, 0, 0), (2, 0.0, 0, 1, 0, 0), (5, 0.0, 0, 0, 0, 1), (70, 0.0, 0, 0, 0, 1), (120, 0.0, 0, 0, 0, 1), (11, 0.0, 0, 0, 0, 1), (48, 0.0, 0, 0, 0, 1), (14, 0.0, 1, 0, 0, 0)),
    # An article alone, its paragraphs short.
    ((2, 0.0, 0, 0, 1, 1), (5, 0.0, 0, 0, 1, 1), (1, 0.0, 0, 0, 1, 1), (4, 0.0, 0, 0, 1, 1), (6, 0.2, 0, 0, 1, 1), (3, 0.0, 0, 0, 1, 1)),
    # One paragraph, nothing else; and one between a menu and a footer.
    ((18, 0.0, 0, 0, 0, 1),),
    ((2, 1.0, 1, 0, 0, 0), (16, 0.0, 0, 0, 0, 1), (5, 0.0, 1, 0, 0, 0)),
    # Long link lists right before and after plain text.
    ((20, 1.0, 0, 0, 0, 0), (60, 0.0, 0, 0, 0, 1), (80, 0.0, 0, 0, 0, 1), (20, 1.0, 0, 0, 0, 0)),
    ((30, 0.9, 0, 0, 0, 0), (9, 0.0, 0, 0, 0, 1), (150, 0.0, 0, 0, 0, 1), (35, 0.1, 0, 0, 0, 1), (12, 0.9, 0, 0, 0, 0), (3, 0.0, 0, 0, 0, 0), (2, 0.0, 0, 0, 0, 0)),
    ((15, 1.0, 0, 0, 0, 0), (25, 0.0, 0, 0, 0, 1), (40, 0.05, 0, 0, 0, 1), (18, 0.9, 0, 0, 0, 0), (5, 0.0, 0, 0, 0, 0)),
    ((25, 1.0, 1, 0, 0, 0), (9, 0.0, 0, 0, 1, 1), (70, 0.0, 0, 0, 1, 1), (6, 0.0, 0, 0, 1, 1)),
    ((12, 1.0, 0, 0, 0, 0), (4, 0.0, 0, 0, 1, 1), (40, 0.0, 0, 0, 1, 1), (8, 0.0, 0, 0, 1, 1), (15, 1.0, 0, 0, 0, 0), (6, 0.0, 0, 0, 0, 0)),
    # All text under a class such as social-post or side-effects, with and without a menu and a footer.
    ((7, 0.0, 0, 1, 0, 1), (60, 0.0, 0, 1, 0, 1), (85, 0.02, 0, 1, 0, 1), (30, 0.1, 0, 1, 0, 1)),
    ((4, 1.0, 1, 0, 0, 0), (2, 1.0, 1, 0, 0, 0), (8, 0.0, 0, 1, 0, 1), (70, 0.0, 0, 1, 0, 1), (16, 0.0, 0, 1, 0, 1), (44, 0.0, 0, 1, 0, 1), (10, 0.0, 1, 0, 0, 0)),
    ((3, 1.0, 1, 0, 0, 0), (18, 0.0, 0, 1, 0, 1), (22, 0.0, 0, 1, 0, 1), (6, 0.0, 1, 1, 0, 0), (4, 1.0, 0, 1, 0, 0)),
    # Paragraphs that are mostly or wholly a link, between paragraphs of an article, and link lists at its end.
    ((9, 0.0, 0, 0, 1, 1), (40, 0.0, 0, 0, 1, 1), (18, 0.75, 0, 0, 1, 1), (52, 0.0, 0, 0, 1, 1), (12, 1.0, 0, 0, 1, 1), (33, 0.0, 0, 0, 1, 1), (4, 1.0, 0, 0, 1, 0), (5, 1.0, 0, 0, 1, 0)),
    ((6, 0.0, 0, 0, 1, 1), (11, 0.0, 0, 0, 1, 1), (16, 0.7, 0, 0, 1, 1), (12, 0.0, 0, 0, 1, 1), (15, 0.6, 0, 0, 1, 1), (20, 0.05, 0, 0, 1, 1), (24, 0.8, 0, 0, 1, 1), (14, 0.0, 0, 0, 1, 1)),
    ((5, 1.0, 1, 0, 0, 0), (8, 0.0, 0, 0, 1, 1), (28, 0.1, 0, 0, 1, 1), (10, 0.9, 0, 0, 1, 1), (35, 0.0, 0, 0, 1, 1), (3, 1.0, 0, 0, 1, 0), (7, 1.0, 0, 0, 1, 0), (6, 1.0, 0, 0, 1, 0), (9, 0.0, 1, 0, 0, 0)),
    # Plain pages that end in a short paragraph, or are nothing but one.
    ((12, 0.0, 0, 0, 0, 1),),
    ((4, 0.0, 0, 0, 0, 1),),
    ((8, 0.0, 0, 0, 0, 1), (40, 0.0, 0, 0, 0, 1), (9, 0.0, 0, 0, 0, 1)),
    ((20, 0.0, 0, 0, 0, 1), (6, 0.0, 0, 0, 0, 1)),
    ((3, 1.0, 0, 0, 0, 0), (2, 1.0, 0, 0, 0, 0), (7, 0.0, 0, 0, 0, 1), (55, 0.0, 0, 0, 0, 1), (12, 0.0, 0, 0, 0, 1), (5, 0.0, 0, 0, 0, 1)),
    ((2, 1.0, 1, 0, 0, 0), (30, 0.0, 0, 0, 0, 1), (10, 0.0, 0, 0, 0, 1), (3, 0.0, 1, 0, 0, 0)),
    # Bread crumbs and share links within main, before, between and after long paragraphs.
    ((1, 1.0, 0, 0, 1, 0), (2, 1.0, 0, 0, 1, 0), (50, 0.0, 0, 0, 1, 1), (2, 1.0, 0, 0, 1, 0), (3, 1.0, 0, 0, 1, 0), (64, 0.0, 0, 0, 1, 1), (4, 0.8, 0, 0, 1, 0), (5, 0.8, 0, 0, 0, 0)),
    ((3, 1.0, 0, 0, 1, 0), (40, 0.0, 0, 0, 1, 1), (2, 1.0, 0, 0, 1, 0), (36, 0.1, 0, 0, 1, 1), (6, 0.8, 0, 0, 1, 0), (4, 1.0, 0, 0, 1, 0)),
    ((2, 1.0, 0, 0, 0, 0), (45, 0.0, 0, 0, 0, 1), (5, 0.8, 0, 0, 0, 0), (90, 0.0, 0, 0, 0, 1), (6, 0.8, 0, 0, 0, 0), (3, 1.0, 0, 0, 0, 0)),
    # An article of a few words beside longer notices, adverts and comments.
    ((3, 1.0, 1, 0, 0, 0), (7, 0.0, 0, 1, 0, 0), (1, 0.0, 0, 0, 1, 1), (2, 0.0, 0, 0, 1, 1), (12, 0.0, 1, 0, 0, 0)),
    ((20, 0.0, 0, 1, 0, 0), (2, 0.0, 0, 0, 1, 1), (35, 0.0, 0, 1, 0, 0), (60, 0.0, 0, 1, 0, 0), (28, 0.05, 0, 1, 0, 0)),
    ((9, 0.0, 0, 1, 0, 0), (3, 0.0, 0, 0, 1, 1), (40, 0.0, 0, 1, 1, 0), (6, 0.0, 1, 1, 0, 0)),
    # Articles that end in a word or two, and are little more.
    ((40, 0.0, 0, 0, 1, 1), (2, 0.0, 0, 0, 1, 1)),
    ((5, 0.0, 0, 0, 1, 1), (1, 0.0, 0, 0, 1, 1)),
    ((1, 0.0, 0, 0, 1, 1), (2, 0.0, 0, 0, 1, 1)),
    ((3, 1.0, 1, 0, 0, 0), (9, 0.0, 0, 1, 0, 0), (1, 0.0, 0, 0, 1, 1), (2, 0.0, 0, 0, 1, 1), (8, 0.0, 0, 1, 0, 0)),
    ((30, 0.0, 0, 0, 0, 1), (2, 0.0, 0, 0, 0, 1)),
    # A recipe: short lines of a list, then steps.
    ((3, 0.0, 0, 0, 1, 1), (25, 0.0, 0, 0, 1, 1), (4, 0.0, 0, 0, 1, 1), (3, 0.0, 0, 0, 1, 1), (5, 0.0, 0, 0, 1, 1), (4, 0.25, 0, 0, 1, 1), (30, 0.0, 0, 0, 1, 1), (2, 0.5, 0, 1, 1, 0), (6, 0.0, 0, 1, 0, 0)),
    # Documentation: menu of many links in furniture, code and short notes in main.
    ((2, 1.0, 1, 0, 0, 0), (3, 1.0, 1, 0, 0, 0), (2, 1.0, 1, 0, 0, 0), (2, 1.0, 1, 0, 0, 0), (4, 0.0, 0, 0, 1, 1), (20, 0.2, 0, 0, 1, 1), (2, 0.0, 0, 0, 1, 1), (9, 0.0, 0, 0, 1, 1), (14, 0.3, 0, 0, 1, 1), (3, 0.0, 1, 0, 0, 0)),
    # A forum page: the first post in the article, replies under telling classes.
    ((6, 0.0, 0, 0, 1, 1), (48, 0.0, 0, 0, 1, 1), (19, 0.0, 0, 0, 1, 1), (2, 0.5, 0, 1, 0, 0), (35, 0.0, 0, 1, 0, 0), (62, 0.05, 0, 1, 0, 0), (28, 0.0, 0, 1, 0, 0), (3, 0.0, 1, 1, 0, 0)),
    # A short notice, a long consent dialogue and a small article between them.
    ((30, 0.05, 0, 1, 0, 0), (55, 0.1, 1, 1, 0, 0), (6, 0.0, 0, 0, 0, 1), (24, 0.0, 0, 0, 0, 1), (31, 0.0, 0, 0, 0, 1), (7, 0.3, 0, 1, 0, 0)),
    ((12, 0.2, 0, 1, 0, 0), (5, 0.0, 0, 0, 1, 1), (15, 0.0, 0, 0, 1, 1), (20, 0.0, 0, 1, 0, 0), (26, 0.1, 0, 1, 0, 0), (14, 1.0, 1, 0, 0, 0)),
    # A shop page: product text plain, adverts and ratings telling, links around.
    ((25, 1.0, 0, 0, 0, 0), (5, 0.0, 0, 0, 0, 1), (38, 0.0, 0, 0, 0, 1), (16, 0.0, 0, 0, 0, 1), (10, 0.0, 0, 1, 0, 0), (22, 0.1, 0, 1, 0, 0), (30, 1.0, 0, 0, 0, 0), (4, 0.0, 0, 0, 0, 0)),
    # A front page: teasers are links.
    ((9, 1.0, 0, 0, 0, 0), (12, 1.0, 0, 0, 0, 0), (10, 1.0, 0, 0, 0, 0), (8, 0.9, 0, 0, 0, 0), (3, 0.0, 0, 0, 0, 0), (11, 1.0, 0, 0, 0, 0)),
)


class Tree(NamedTuple):
    """An inner node's feature and threshold, or a leaf's label."""

    label: bool
    feature: int = -1
    threshold: float = 0.0
    below: Tree | None = None
    above: Tree | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.below is None:
            return np.full(len(x), self.label)
        left = x[:, self.feature] <= self.threshold
        out = np.empty(len(x), bool)
        out[left], out[~left] = self.below.predict(x[left]), self.above.predict(x[~left])
        return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9) -> Tree:
    """The tree that splits by Gini impurity down to pure leaves or ``depth``."""
    label = bool(y.mean() >= 0.5)
    if depth == 0 or y.min() == y.max():
        return Tree(label)
    best = (np.inf, 0, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in ((values[1:] + values[:-1]) / 2).tolist():
            left = x[:, f] <= t
            p, q = y[left].mean(), y[~left].mean()
            best = min(best, (left.sum() * p * (1 - p) + (~left).sum() * q * (1 - q), f, t))
    if best[0] == np.inf:
        return Tree(label)
    left = x[:, best[1]] <= best[2]
    return Tree(label, best[1], best[2], grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1))


@lru_cache(maxsize=1)
def trained_tree() -> Tree:
    x = np.vstack([features([r[:5] for r in page]) for page in LABELLED])
    return grow(x, np.array([r[5] for page in LABELLED for r in page]))


def main_text(page: str, tree: Tree | None = None) -> str:
    """The main text of one page; empty if it has none."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    keep = (tree or trained_tree()).predict(features([b[1:] for b in blocks]))
    return " ".join(b.text for b, k in zip(blocks, keep.tolist(), strict=True) if k)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    A null or empty page, and one without main text, has the empty text. Unclosed
    comments, scripts, styles, titles, text areas and tags run to the end of the page. Ids and urls pass through,
    null or repeated; other columns are ignored.
    """
    tree = trained_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, tree) for p in as_strings(batch.column(2)).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
