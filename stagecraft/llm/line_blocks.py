"""Main text of web pages by the distribution of text over lines.

Markup is stripped so that every block element is a line of its own. A line weighs the
characters it has outside of links, less those inside; names of elements, classes and ids
change weights: lines of navigation, headers, footers, forms, adverts, notices, comments and
the like weigh nothing and take no place among the lines, a line of an ``article`` or
``main`` element weighs all its characters and at least the threshold. On pages with text in
such an element that is not itself in a wasted place, lines outside of these elements weigh
nothing and take no place either.

Weights are summed over windows of ``WINDOW`` lines around each line. The threshold comes
from the page: ``SHARE`` of the window sum that its average weighing character sees,
``CEILING`` at most. A stretch runs as long as the windows hold weight, and counts if one of
them reaches the threshold. Its surge is the first line that carries its share of the
threshold (a line of a paragraph does whatever its length, a heading if what follows it
does), its dive is after the last such line. All lines from surge to dive are the text: a
short list between paragraphs stays, a menu before them, a list of links after them and
three lines of links among them go.

Names of classes and ids tell what such a place is. What follows "with", "has", "no" and
the like in a name says nothing about the element itself. A name with "wrap" or
"container" counts unless the element holds most of the page's text, or, if the name has
other pieces too ("content-sidebar-wrap"), an article or main element.

Defined results: a null or empty page, or one without text outside of links, has the empty
string. Rows are judged alone: repeated rows and null ids or urls stay as they are.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagecraft.llm.words import batched

WINDOW = 3
SHARE = 0.5
CEILING = 150
_RAW = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea)\b[^>]*>"
    r".*?(?:</\1\s*>|\Z)|<![^>]*>?|<\?[^>]*>?", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)(?:>|\Z)")
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav ol optgroup option p pre section select summary table tbody td "
    "tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_WASTE = frozenset("head title nav header footer aside form button select menu dialog "
                   "fieldset".split())
_MAIN = frozenset("article main".split())
_NAMED = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""",
                    re.I)
_WASTE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner nav navbar "
    "navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside side "
    "complementary contentinfo cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe subscription signup login search share sharing social related "
    "recommended comment comments disqus replies reply respond widget pagination pager copyright "
    "disclaimer legal toolbar".split())
#: Pieces of a name after which the rest is about something else than the element.
_ABOUT = frozenset("with without has have no not non".split())
_WRAPS = frozenset("wrap wraps wrapper wrapped container".split())
#: Elements that HTML closes when one of these opens.
_CLOSES = {"p": _BLOCK - {"body", "html", "head", "title"}, "li": {"li"}, "option": {"option"}, "td": {"td", "th", "tr"},
           "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
           "head": {"body"}}


#: What an element's names say: nothing, a wrapper of waste only, a wrapper of waste and
#: something else, waste.
_CLEAR, _WRAP, _MIXED_WRAP, _BAD = range(4)


def _judged(name: str) -> int:
    """What one name of a class, id or role says."""
    pieces = [p for p in re.split(r"[^a-z]+", name) if p]
    own = next((pieces[:k] for k, p in enumerate(pieces) if p in _ABOUT), pieces)
    if not any(p in _WASTE_NAMES for p in own):
        return _CLEAR
    if not any(p in _WRAPS for p in own):
        return _BAD
    return _WRAP if all(p in _WASTE_NAMES or p in _WRAPS for p in own) else _MIXED_WRAP


def _wasted(name: str, attributes: str) -> int:
    if name in _WASTE:
        return _BAD
    if name in ("body", "html") or name in _MAIN or not attributes:
        return _CLEAR
    return max((_judged(part) for found in _NAMED.finditer(attributes)
                for part in next(g for g in (*found.groups(), "") if g is not None).lower().split()),
               default=_CLEAR)


class Line(NamedTuple):
    text: str
    waste: bool
    main: bool
    plain: int  # characters outside of links less those inside, 0 at least
    prose: bool  # in a paragraph or the like
    heading: bool


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PROSE = frozenset("p blockquote pre".split())
_LINK = re.compile(r"\bhref\s*=", re.I)


def _squeezed(pieces: list[str]) -> str:
    return " ".join(html.unescape("".join(pieces)).split())


def lines(page: str) -> list[Line]:
    """The lines of a page, in time linear in its length."""
    out: list[Line] = []
    pieces: list[str] = []
    linked: list[str] = []  # those of the pieces that stand in links
    opened: list[tuple[str, int, bool]] = []
    count: Counter[str] = Counter()  # open elements by name
    wraps: list[list[int]] = []  # first line, end and kind of each wrapper
    open_wraps: list[list[int]] = []
    waste = main = links = prose = headings = 0

    def add(piece):
        if piece:
            pieces.append(piece)
            if links:
                linked.append(piece)

    def close_line():
        text = _squeezed(pieces)
        if text:
            plain = len(text) - 2 * len(_squeezed(linked)) if linked else len(text)
            out.append(Line(text, waste > 0, main > 0, max(plain, 0), prose > 0, headings > 0))
        pieces.clear()
        linked.clear()

    def tally(name, bad, link, by):
        nonlocal waste, main, links, prose, headings
        count[name] += by
        waste += by * (bad == _BAD)
        main += by * (name in _MAIN)
        links += by * link
        prose += by * (name in _PROSE)
        headings += by * (name in _HEADINGS)

    def pop():
        name, bad, link = opened.pop()
        tally(name, bad, link, -1)
        if bad in (_WRAP, _MIXED_WRAP):
            open_wraps.pop()[1] = len(out)

    def pop_to(name):
        while opened[-1][0] != name:
            pop()
        pop()

    page, at = _RAW.sub(" ", page), 0
    for tag in _TAG.finditer(page):
        add(page[at : tag.start()])
        at = tag.end()
        closing, name = tag[1], tag[2].lower()
        if name == "br":
            pieces.append("\n")
        if name in _BLOCK:
            close_line()
        if name in _VOID or tag[3].endswith("/"):
            continue
        if closing:
            if count[name]:
                pop_to(name)
            continue
        bad = _wasted(name, tag[3])
        if bad and name not in _BLOCK:
            close_line()
        while opened and name in _CLOSES.get(opened[-1][0], ()):
            pop()
        if name in _CLOSES["p"] and count["p"]:
            pop_to("p")  # what a paragraph left open ends with it
        link = name == "a" and _LINK.search(tag[3]) is not None
        opened.append((name, bad, link))
        tally(name, bad, link, 1)
        if bad in (_WRAP, _MIXED_WRAP):
            wraps.append([len(out), -1, bad])
            open_wraps.append(wraps[-1])
    add(page[at:])
    close_line()
    return _without_wraps(out, wraps) if wraps else out


def _without_wraps(found: list[Line], wraps: list[list[int]]) -> list[Line]:
    """The lines, those of wrappers of waste marked as waste."""
    sums, mains = [0], [0]
    for line in found:
        sums.append(sums[-1] + (0 if line.waste else len(line.text)))
        mains.append(mains[-1] + (line.main and not line.waste))
    edge = [0] * (len(found) + 1)
    for first, end, kind in wraps:
        end = len(found) if end < 0 else end
        if 2 * (sums[end] - sums[first]) <= sums[-1] and not (
                kind == _MIXED_WRAP and mains[end] > mains[first]):
            edge[first] += 1
            edge[end] -= 1
    return [line._replace(waste=line.waste or depth > 0)
            for line, depth in zip(found, accumulate(edge))]


def window_sums(weights: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Sum of the weights of the lines around each line, itself among them."""
    total = np.concatenate(([0], np.cumsum(weights)))
    at = np.arange(len(weights))
    before = (window - 1) // 2
    return (total[np.minimum(at - before + window, len(weights))]
            - total[np.maximum(at - before, 0)])


def threshold(weights: np.ndarray, window: int = WINDOW, share: float = SHARE,
              ceiling: float = CEILING) -> float:
    """What a window has to hold, from the page's own window sums."""
    seen = window_sums(weights, window)
    total = int(weights.sum())
    return min(ceiling, share * float((weights * seen).sum()) / total) if total else 0.0


def stretches(weights: np.ndarray, strong: np.ndarray, least: float,
              window: int = WINDOW) -> list[tuple[int, int]]:
    """Line ranges from surge to dive, the end exclusive."""
    sums = window_sums(weights, window)
    full = np.concatenate(([False], sums > 0, [False]))
    edge = np.flatnonzero(full[1:] != full[:-1])
    out = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        carried = np.flatnonzero(strong[a:b])
        if len(carried) and sums[a:b].max() >= least:
            out.append((a + int(carried[0]), a + int(carried[-1]) + 1))
    return out


def main_text(page: str | None, window: int = WINDOW, share: float = SHARE,
              ceiling: float = CEILING) -> str:
    found = [line for line in lines(page or "") if not line.waste]
    if any(line.main for line in found):
        found = [line for line in found if line.main]
    raw = np.array([len(line.text) if line.main else line.plain for line in found], np.int64)
    least = threshold(raw, window, share, ceiling)
    weights = np.array([max(w, least) if line.main else w
                        for w, line in zip(raw.tolist(), found)], np.float64)
    strong = np.zeros(len(found), bool)
    follows = False  # whether the next line that is no heading is strong
    for i in range(len(found) - 1, -1, -1):
        line = found[i]
        if line.heading and not line.main:
            strong[i] = weights[i] > 0 and follows
        else:
            strong[i] = follows = weights[i] > 0 and (line.prose or window * weights[i] >= least)
    return "\n\n".join(found[i].text for a, b in stretches(weights, strong, least, window)
                       for i in range(a, b))


def extract(pages: DataFrame, window: int = WINDOW) -> DataFrame:
    """page_id, url, text, n_chars; pages are read in place, nothing is shuffled."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()),
                        ("n_chars", pa.int64())])

    def fill(batch):
        for page_id, url, page in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html"))):
            text = main_text(page, window)
            yield page_id, url, text, len(text)

    return pages.select(F.col("page_id").cast("bigint"), "url", "html").mapInArrow(
        batched(schema, fill, 500), "page_id bigint, url string, text string, n_chars bigint")
