"""Main text of a web page from streaming parser events and the text-to-tag ratio of its lines.

1. The standard library's parser feeds events; they build lists of elements (parent, kind) and blocks (text between two
block boundaries, with its tags and its characters in links). Nothing is searched from top to bottom, so broken markup of
any depth takes linear time.
2. Elements that are by their kind, role or name what an article is told from (menus, page headers, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments, hidden parts) are left out. Names are the words of classes and
ids; they do not count after ``has``, ``with`` or ``no``, on a header within an article, or on what holds the article or
most of the page.
3. The lines that are left have a ratio of characters outside links to tags. It is smoothed by a Gaussian, and lines at or
over a threshold (``share`` of the lesser of mean and standard deviation) form the content clusters.
4. The content region is the article (or main) element with the most characters, or with none the smallest element that
holds ``nearly`` all characters of the clusters, with headings right before it. Inside it the clusters decide: runs of
lines under the threshold that are links are menus and go; other lines under it stay between content lines, and beyond the
first and last one where they are built like a content line (same parent and element). So a short paragraph stays, and an
unnamed menu or a line of small print beside the paragraphs goes.

Character references are decoded, white space in a line becomes one space, lines are joined by a line feed in page
order. Defined results: null, empty and text-free pages give an empty text; broken markup is read as far as it goes
(unknown declarations are comments, stray end tags nothing); very long pages are read whole; of elements that hold as
much the first counts; repeated rows give equal texts; an empty table gives no rows; further columns are kept, and a
column of the result's name is replaced.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

# Elements of the HTML standard, and words that name menus, headers, footers, sidebars, notices, adverts, forms and reader comments.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split())
LEFT_OUT = frozenset("script style template noscript head title nav aside footer form menu dialog button select textarea input label fieldset iframe object svg canvas audio video map search datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar note".split())
WORDS = frozenset(
    "menu nav navbar navigation breadcrumb breadcrumbs pager pagination "
    "header masthead topbar "
    "footer "
    "sidebar "
    "cookie cookies consent gdpr notice notification popup "
    "ad ads advert adverts advertisement advertising advertisment adsense banner billboard promo promoted promotion sponsor sponsored "
    "captcha login newsletter signup subscribe "
    "comment comments commentlist disqus replies respond shoutbox".split()
)
NOT_IT = frozenset("has with no without".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDS = frozenset("ul ol dl table select body html article section div main aside nav header footer form td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p li dt dd blockquote pre figcaption caption tr".split())

_PART = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: How an element's names speak: not at all, by a part of a class or id, by a whole one.
NOTHING, PART, WHOLE = 0, 1, 2


def _left_out(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
    """Whether an element is by its kind no part of an article."""
    if tag in LEFT_OUT or tag == "header" and not in_article:
        return True
    for name, value in attrs:
        value = value or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            return True
        if name == "role" and value.strip().lower() in ROLES:
            return True
        if name in ("class", "id") and tag == "article" and WORDS & set(_PART.findall(value.lower())):
            return True
    return False


def _named(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> int:
    """Whether classes or ids say that it is no part of an article; a header in an article is one."""
    found = NOTHING
    if tag in ("body", "html", "article", "main"):
        return found
    for name, value in attrs:
        if name not in ("class", "id"):
            continue
        for token in (value or "").split():
            parts = _PART.findall(_HUMP.sub(" ", token).lower())
            for before, part in zip(["", *parts], parts, strict=False):
                if part in WORDS and before not in NOT_IT and not (in_article and part == "header"):
                    found = max(found, WHOLE if len(parts) == 1 else PART)
    return found


class Page(HTMLParser):
    """Elements (by number, 0 is the page itself) and blocks of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.out, self.name = [""], [0], [False], [NOTHING]
        self.stack, self.places, self.holding, self.articles = [0], {}, [], 0
        #: (pieces of text with the element that each lies in and whether in a link, tags)
        self.blocks: list[tuple[list[tuple[int, bool, str]], int]] = []
        self.pieces: list[tuple[int, bool, str]] = []
        self.tags = 0

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)

    def block(self) -> None:
        if self.pieces:
            self.blocks.append((self.pieces, self.tags))
            self.pieces = []
        self.tags = 0

    def _last(self, *tags: str) -> int:
        """The place of the innermost open element of these kinds, or -1."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def _pop(self, to: int) -> None:
        while len(self.stack) > to:
            tag = self.tag[self.stack.pop()]
            self.places[tag].pop()
            if tag in HOLDS:
                self.holding.pop()
            self.articles -= tag in ("article", "main")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        held = self.holding[-1] if self.holding else -1
        if tag in BLOCK:
            self.block()
            if (at := self._last("p")) > held:
                self._pop(at)
        elif tag in ("br", "td", "th"):
            self.pieces.append((self.stack[-1], False, " "))
        if tag in CLOSED_BY and (at := self._last(*CLOSED_BY[tag])) >= max(held, 0):
            self._pop(at)
        self.tags += 1
        if tag in VOID:
            return
        number = len(self.tag)
        self.tag.append(tag)
        self.parent.append(self.stack[-1])
        self.out.append(_left_out(tag, attrs, self.articles > 0))
        self.name.append(_named(tag, attrs, self.articles > 0))
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in HOLDS:
            self.holding.append(len(self.stack))
        self.articles += tag in ("article", "main")
        self.stack.append(number)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "g", "use", "rect", "circle"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        at = self._last(tag)
        if at < 0:
            return
        if tag in BLOCK:
            self.block()
        self.tags += 1
        self._pop(at)

    def handle_data(self, data: str) -> None:
        self.pieces.append((self.stack[-1], bool(self.places.get("a")), data))


def _read(html: str) -> Page:
    page = Page()
    page.feed(html)
    page.close()
    page.block()
    return page


def _sums(parent: list[int], own: list[float]) -> list[float]:
    """What each element and all in it have; an element's number is greater than its parent's."""
    total = list(own)
    for e in range(len(parent) - 1, 0, -1):
        total[parent[e]] += total[e]
    return total


def _above(parent: list[int], e: int) -> list[int]:
    """e and what it lies in."""
    path = [e]
    while path[-1]:
        path.append(parent[path[-1]])
    return path


def _dropped(page: Page, nearly: float) -> tuple[list[bool], int]:
    """Which elements lie in one that is left out, and the article (0: none)."""
    n = len(page.tag)
    out = [False] * n
    for e in range(1, n):
        out[e] = page.out[e] or out[page.parent[e]]
    own = [0.0] * n
    for pieces, _ in page.blocks:
        for e, _, data in pieces:
            if not out[e]:
                own[e] += len(data) - data.count(" ")
    held = _sums(page.parent, own)
    in_named = [False] * n
    for e in range(1, n):
        in_named[e] = page.name[e] == WHOLE or in_named[page.parent[e]]
    articles = [e for e in range(1, n) if page.tag[e] in ("article", "main") and not out[e] and held[e]]
    # not one among the reader comments, not a main beside an article of its own, and the first of equals
    articles = [e for e in articles if not in_named[e]] or articles
    inner = [e for e in articles if page.tag[e] == "article"] or articles
    article = max(inner, key=lambda e: (held[e], -e), default=0)
    spared = set(_above(page.parent, article)) if article else set()
    for e in range(1, n):
        most = held[e] >= held[0] * (nearly if page.name[e] == WHOLE else 0.5) > 0
        out[e] = page.out[e] or out[page.parent[e]] or page.name[e] > NOTHING and e not in spared and not (most and not article)
    return out, article


def smoothed(ratio: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian of three sigma on either side, with weights that add up to one at the ends too."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratio, kernel)[reach : reach + len(ratio)] / np.convolve(np.ones(len(ratio)), kernel)[reach : reach + len(ratio)]


def _runs(mark: np.ndarray) -> list[tuple[int, int]]:
    """The runs of true values, as (first, after the last)."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mark.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def main_text(html: str | None, sigma: float = 1.0, share: float = 0.5, nearly: float = 0.9) -> str:
    """The main text; sigma and share shape the content clusters, nearly the region."""
    page = _read(html or "")
    out, article = _dropped(page, nearly)
    texts, chars, linked, tags, place = [], [], [], [], []
    for pieces, n in page.blocks:
        kept = [p for p in pieces if not out[p[0]]]
        text = " ".join("".join(data for _, _, data in kept).split())
        if text:
            texts.append(text)
            chars.append(len(text))
            linked.append(len(" ".join("".join(data for _, link, data in kept if link).split())))
            tags.append(max(1, n))
            place.append(next(e for e, _, data in kept if not data.isspace()))
    if not texts:
        return ""
    size, links = np.array(chars, float), np.array(linked, float)
    level = smoothed((size - links) / np.array(tags, float), sigma)
    content = level >= share * min(level.mean(), level.std())
    # what each element holds of the clusters; the region is the article or the last on the way to nearly all of it
    own = [0.0] * len(page.tag)
    for e, n, c in zip(place, size, content, strict=True):
        own[e] += n if c else 0.0
    held = _sums(page.parent, own)
    region = article
    if not region:
        region = max((e for e in range(len(held)) if held[e] >= nearly * held[0] and (not e or page.tag[e] in HOLDS)), default=0)
    last = list(range(len(page.tag)))
    for e in range(len(last) - 1, 0, -1):
        last[page.parent[e]] = max(last[page.parent[e]], last[e])
    inside = np.array([region <= e <= last[region] for e in place])
    # the block that a line is: the element itself or the nearest block around its inline elements
    unit: list[int] = []
    for e in place:
        while e and page.tag[e] not in BLOCK:
            e = page.parent[e]
        unit.append(e)
    kind = [page.tag[e] for e in unit]
    heading = np.array([k in HEADINGS for k in kind])
    keep = inside & (content | heading)
    built = {(page.parent[e], k) for e, k, c, i in zip(unit, kind, content, inside, strict=True) if c and i}
    core = np.flatnonzero(inside & content)
    for i in np.flatnonzero(inside & ~keep):
        between = len(core) and core[0] < i < core[-1]
        alike = (page.parent[unit[i]], kind[i]) in built and (kind[i] in PROSE or page.tag[region] not in ("", "body", "html"))
        keep[i] = bool(article or between or alike)
    # runs of links that reach under the threshold are menus, in an article only long ones
    for a, b in _runs(inside & (links >= 0.9 * size) & np.array([k != "p" and k not in HEADINGS for k in kind])):
        if b - a >= (3 if article else 2) and not content[a:b].all():
            keep[a:b] = False
    # headings right before the region
    first = int(np.flatnonzero(inside)[0]) if inside.any() else 0
    while not article and first and heading[first - 1] and links[first - 1] < 0.9 * size[first - 1]:
        first -= 1
        keep[first] = True
    return "\n".join(t for t, k in zip(texts, keep, strict=True) if k)


def with_main_text(pages: DataFrame, html: str = "html", to: str = "text") -> DataFrame:
    @F.pandas_udf("string")
    def of(values: pd.Series) -> pd.Series:
        return pd.Series([main_text(v) for v in values], dtype=object)

    lean(pages.sparkSession)
    return pages.withColumn(to, of(F.col(f"`{html}`").cast("string")))
