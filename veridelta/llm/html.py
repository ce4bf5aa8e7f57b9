"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing and threshold clustering.

The standard library's parser streams a page's events. They are gathered into lines, one for each run of text between block
elements, with the tags that were met in it and the element that holds it. Furniture (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, comments of readers) is known by element, role or the words of class and id. Of what is left, each line's
ratio of text to tags is smoothed over its neighbours; lines that reach the ratios' standard deviation are content. Content lines
choose the region: the article that holds most of them, or, where a page marks no article, the innermost element that they
share. All lines of the region are returned, however short.

Nulls: a null html is an empty page, whose text is empty. Pages cut off anywhere, unclosed elements and unknown entities are read
as browsers read them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tune

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a line of text; all others begin a line and end one.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math nobr q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr".split()
)
#: Elements that are never part of an article.
FURNITURE = frozenset("head title nav menu footer aside form script style noscript template iframe object canvas svg select option button textarea input fieldset dialog audio video applet map datalist".split())
#: Text of these is not markup of the page, so nothing inside them is a line.
UNSEEN = frozenset("script style template noscript".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar tooltip note".split())
#: Words of class and id that name furniture, and beginnings of such words.
FURNITURE_WORDS = frozenset(
    "ad ads adsense nav navigation menu menubar side aside widget masthead topbar toolbar consent gdpr notice notices notification notifications announcement alert banner popup modal overlay "
    "signup login share sharing social related recommended recommendations respond replies disqus discussion pagination pager search form forms skip copyright leaderboard".split()
)
FURNITURE_STEMS = ("advert", "sponsor", "promo", "navbar", "breadcrumb", "sidebar", "footer", "cookie", "newsletter", "subscri", "comment")
#: This names furniture outside an article only: an article may have a header of its own.
OUTSIDE_WORD = "header"
#: How an element is marked as the main part of its page: not at all, as what holds it, as an article.
PLAIN, MAIN, ARTICLE = 0, 1, 2
#: Elements open at once; deeper ones stand beside their parents, as in browsers.
DEEPEST = 512
#: What a start tag ends, if it is open in the same block.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: An open element of these keeps what is outside it open.
SCOPE = frozenset("ul ol dl table select article main section div body html nav aside footer header form blockquote".split())
#: Neighbours on either side that a line is smoothed over, and the Gaussian's width.
NEAR = 2
SIGMA = 1.0
#: A block whose text is links to this share is a menu where no article is marked.
LINKED = 0.5


class Lines(HTMLParser):
    """Lines of a page as its events come: ``lines`` has (text, tags, letters in links, element), ``elements`` (parent, tag, furniture, mark, inside a main part)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[tuple[int, str, bool, int, bool]] = [(-1, "", False, PLAIN, False)]
        self.open: list[tuple[str, int]] = [("", 0)]
        self.lines: list[tuple[str, int, int, int]] = []
        self.held: list[str] = []
        self.tags = self.linked = self.links = self.unseen = 0

    def _line(self) -> None:
        text = " ".join("".join(self.held).split())
        if text:
            self.lines.append((text, self.tags, self.linked, self.open[-1][1]))
            self.tags = self.linked = 0
        self.held = []

    def _close(self, place: int) -> None:
        """Close the open elements from ``place`` on."""
        for tag, _ in self.open[place:]:
            if tag not in INLINE:
                self._line()
            self.links -= tag == "a"
            self.unseen -= tag in UNSEEN
            self.open.pop()

    def _found(self, tags: set[str] | frozenset[str], scope: frozenset[str] = SCOPE) -> int:
        """The innermost open element of ``tags``, if none of ``scope`` stands inside it; else 0."""
        for place in range(len(self.open) - 1, 0, -1):
            if self.open[place][0] in tags:
                return place
            if self.open[place][0] in scope:
                return 0
        return 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.held.append(" ")
        if tag in VOID:
            if tag not in INLINE and tag != "input":
                self._line()
            return
        if tag not in INLINE:
            self._line()
            if place := self._found({"p"}):
                self._close(place)
            if tag in ENDS and (place := self._found(ENDS[tag])):
                self._close(place)
        elif tag == "a" and (place := self._found({"a"})):
            self._close(place)
        if len(self.open) >= DEEPEST:
            return
        parent = self.open[-1][1]
        here = parent
        if tag not in INLINE or tag in FURNITURE or any(k in ("class", "id", "role") for k, _ in attrs):
            here = len(self.elements)
            self.elements.append((parent, tag, *self._kind(tag, dict(attrs), parent)))
        self.open.append((tag, here))
        self.links += tag == "a"
        self.unseen += tag in UNSEEN

    def _kind(self, tag: str, given: dict[str, str | None], parent: int) -> tuple[bool, int, bool]:
        """Whether an element is furniture, how it is marked, and whether it is or lies in a main part."""
        inside = self.elements[parent][4]
        role = (given.get("role") or "").strip().lower()
        if tag in FURNITURE or role in FURNITURE_ROLES:
            return True, PLAIN, inside
        if tag in ("html", "body"):
            return False, PLAIN, inside
        named = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{given.get('class') or ''} {given.get('id') or ''}").lower()))
        if tag != "main" and (named & FURNITURE_WORDS or any(w.startswith(FURNITURE_STEMS) for w in named)):
            return True, PLAIN, inside
        if not inside and (tag == "header" or OUTSIDE_WORD in named and tag not in ("article", "main", "h1", "h2", "h3")):
            return True, PLAIN, inside
        if tag == "article" or role == "article" or (given.get("itemprop") or "").lower() == "articlebody":
            return False, ARTICLE, True
        mark = MAIN if tag == "main" or role == "main" else PLAIN
        return False, mark, inside or mark == MAIN

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math", "path"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "p" and not self._found({"p"}):
            self._line()  # as an empty paragraph
            return
        inline = tag in INLINE
        if place := self._found({tag}, frozenset(SCOPE - {tag}) if inline or tag in ("p", "li", "td", "th") else frozenset()):
            self._close(place)

    def handle_data(self, data: str) -> None:
        if self.unseen:
            return
        self.held.append(data)
        if self.links:
            self.linked += sum(map(len, data.split()))

    def parse_comment(self, i: int, report: int = 1) -> int:
        """A comment that nothing ends goes on to the end of the page."""
        end = super().parse_comment(i, report)
        return end if end >= 0 else len(self.rawdata)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Ends at the next >, as a comment does that isn't one."""
        return self.rawdata.find(">", i) + 1 or len(self.rawdata)

    def end(self) -> None:
        self.close()
        self._line()


def smoothed(ratios: np.ndarray, near: int = NEAR, sigma: float = SIGMA) -> np.ndarray:
    """The ratios smoothed by a Gaussian over ``near`` neighbours on either side; at the ends over those there are."""
    kernel = np.exp(-(np.arange(-near, near + 1) ** 2) / (2 * sigma**2))
    return np.convolve(ratios, kernel)[near : near + len(ratios)] / np.convolve(np.ones(len(ratios)), kernel)[near : near + len(ratios)]


def main_lines(page: Lines) -> list[str]:
    """The lines of the region that the content lines choose."""
    elements, lines = page.elements, page.lines
    furniture = [False] * len(elements)
    within = {mark: [0] * len(elements) for mark in (ARTICLE, MAIN)}  # the outermost element so marked
    for k, (parent, _, own, marked, _) in enumerate(elements):
        furniture[k] = own or parent >= 0 and furniture[parent]
        for mark, outer in within.items():
            outer[k] = parent >= 0 and outer[parent] or (k if marked == mark and not furniture[k] else 0)
    left = [x for x in lines if not furniture[x[3]]]
    if not left:
        return []
    size = np.array([len(text) for text, *_ in left], float)
    plain = np.maximum(size - np.array([linked for _, _, linked, _ in left]), 0)
    ratio = smoothed(plain / np.maximum(1, np.array([tags for _, tags, _, _ in left])))
    content = ratio >= ratio.std()
    weight = np.where(content, plain, 0)
    for outer in within.values():
        inside = np.array([outer[x[3]] for x in left])
        regions = set(inside[inside > 0].tolist())
        chosen = {r for r in regions if weight[inside == r].sum() > 0} or (regions if not weight.any() else set())
        if chosen:
            return [x[0] for x, r in zip(left, inside.tolist(), strict=True) if r in chosen]
    return _shared_region(elements, left, weight, content)


def _shared_region(elements: list, left: list, weight: np.ndarray, content: np.ndarray) -> list[str]:
    """Without a marked article: the innermost element with all content, less its parts that have none or are links."""
    children: dict[int, float] = {}
    paths = []
    for (_, _, _, element), w in zip(left, weight.tolist(), strict=True):
        path = []
        while element >= 0:
            path.append(element)
            children[element] = children.get(element, 0.0) + w
            element = elements[element][0]
        paths.append(path[::-1])
    total, depth = weight.sum(), 0
    if total:
        first = paths[int(np.argmax(weight))]
        while depth + 1 < len(first) and children[first[depth + 1]] >= total and elements[first[depth + 1]][1] not in ("p", "li", "td", "tr", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6"):
            depth += 1
        top = first[depth]
    else:
        top = 0
    kept = []
    parts_with_content = {p[depth + 1] for p, c, w in zip(paths, content.tolist(), weight.tolist(), strict=True) if c and w and len(p) > depth + 1 and p[depth] == top}
    for (text, _, linked, _), path in zip(left, paths, strict=True):
        if len(path) <= depth or path[depth] != top:
            continue
        leaf = len(path) == depth + 1 or elements[path[depth + 1]][1] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "ul", "ol", "dl", "table")
        if (leaf or path[depth + 1] in parts_with_content) and linked < LINKED * len(text):
            kept.append(text)
    return kept


def whole_tags(html: str) -> str:
    """The page without a tag that its end cuts off, which no browser shows and the parser would try again and again."""
    end = html.rfind(">") + 1
    cut = re.compile("<[A-Za-z/!?]").search(html, end)
    return html[: cut.start()] if cut else html


def main_text(html: str | None) -> str:
    """The main text of one page, blocks joined by a line feed."""
    page = Lines()
    page.feed(whole_tags(html or ""))
    page.end()
    return "\n".join(main_lines(page))


def extracted(html: Column) -> Column:
    """The main text of each page of a column."""

    @F.pandas_udf("string")
    def texts(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            yield pd.Series([main_text(page) for page in batch], dtype=object)

    return texts(F.coalesce(html, F.lit("")))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    tune(pages.sparkSession)
    return pages.select("page_id", "url", extracted(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
