"""HTML extraction by line-block distribution.

A page becomes lines, one per text block. Sums of text lengths over sliding windows of all lines, menus and
notices too, rise above a threshold at surge points and fall to it at dive points. On a page without an
article (or main) element the body goes from the first surge to the last dive, and every line in it that is
not part of a menu, header, footer, sidebar, notice, advert, form, script, style or comment section is text,
however short. In a page with such an element its tags say where the body is: every line inside that is
not part of one of those is text, and the windows decide nothing.

Defined cases: a null or empty html gives an empty text; markup that ends or nests wrongly is read as far
as it goes; repeated rows are answered each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: Lines in a window.
WINDOW = 3
#: A window holds body text above this many characters (above half of the fullest window on pages with less text).
THRESHOLD = 40

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold article text.
OUTSIDE = frozenset("nav footer aside form script style noscript template iframe object svg canvas button select textarea head title dialog menu audio video map".split())
#: Class, id and role words of the same.
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer sidebar aside widget related recommended comment comments disqus respond replies reply cookie cookies consent notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login share sharing social toolbar pagination pager skip hidden contentinfo complementary search".split()
)
#: What may stand beside them in one name: sidebar-left, footer_links, main-nav, ad-slot-2; not has-sidebar or related-work.
BESIDE_WORDS = frozenset(
    "left right top bottom site main global primary secondary mobile desktop link links list item items box container wrapper inner outer "
    "area section bar block slot unit form button buttons icons posts articles content text".split()
)
#: Elements that stay in the line they stand in.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output q s samp small span strike strong sub sup time tt u var wbr".split())
ARTICLE = frozenset(("article", "main"))
#: An open paragraph ends where one of these begins.
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


def names_outside(name: str) -> bool:
    """Whether a whole class, id or role name says so: outside words with nothing but places and numbers beside them."""
    words = [w for w in name.replace("_", "-").split("-") if w]
    return any(w in OUTSIDE_WORDS for w in words) and all(w in OUTSIDE_WORDS or w in BESIDE_WORDS or w.isdigit() for w in words)


class Lines(HTMLParser):
    """Collects (text, outside by tag, elements outside by name, article) per block, the last two as numbers of elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []  # 1: outside by tag, 2: by name
        self.out = self.count = 0
        self.named: list[int] = []
        self.articles: list[int] = []
        self.around: dict[int, tuple[int, ...]] = {}  # elements outside by name around each article
        self.lines: list[tuple[str, bool, tuple[int, ...], int]] = []
        self.parts: list[str] = []

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.lines.append((text, self.out > 0, tuple(self.named), self.articles[-1] if self.articles else 0))

    def is_outside(self, tag: str, attrs: list) -> int:
        if tag in OUTSIDE:
            return 1
        if tag == "header":  # a heading inside the article belongs to it
            return int(not self.articles)
        if tag in ("html", "body", "article", "main"):
            return 0
        if any(name == "hidden" or (name == "aria-hidden" and value == "true") for name, value in attrs):
            return 1
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                if any(names_outside(n) and not (n == "header" and self.articles) for n in value.lower().split()):
                    return 2
        return 0

    def shut(self) -> None:
        tag, outside = self.open.pop()
        self.out -= outside == 1
        if outside == 2:
            self.named.pop()
        if tag in ARTICLE:
            self.articles.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self.end_line()
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag in CLOSES_P:
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == "p":
                    while len(self.open) > i:
                        self.shut()
                    break
                if self.open[i][0] not in INLINE:
                    break
        outside = self.is_outside(tag, attrs)
        if outside and tag in INLINE:
            self.end_line()
        self.open.append((tag, outside))
        self.out += outside == 1
        self.count += 1
        if outside == 2:
            self.named.append(self.count)
        if tag in ARTICLE:
            self.articles.append(self.count)
            self.around[self.count] = tuple(self.named)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self.end_line()
        elif tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.end_line()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if any(o for _, o in self.open[i:]):
                    self.end_line()
                while len(self.open) > i:
                    self.shut()
                break
            if self.open[i][0] not in INLINE and tag in INLINE:
                break

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def lines_of(html: str) -> list[tuple[str, bool, bool]]:
    """(text, outside, in_article) per block. A name puts no element outside that holds the article with most text, or the longest block."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    own: dict[int, int] = {}
    for text, out, _, article in parser.lines:
        if article and not out:
            own[article] = own.get(article, 0) + len(text)
    spared = set(parser.around[max(own, key=own.get)]) if own else set()
    found = lambda: [(text, out or not spared.issuperset(named), article > 0) for text, out, named, article in parser.lines]
    if not any(inside and not out for _, out, inside in found()):
        text = [(len(t), named) for t, out, named, article in parser.lines if not out and (article or not own)]
        spared.update(max(text, key=lambda x: x[0])[1] if text else ())
    return found()


def regions(lengths: list[int], window: int = WINDOW, threshold: float = 0) -> list[tuple[int, int]]:
    """(surge, dive) bounds of the runs of lines in windows with sums above the threshold, without empty lines at their ends."""
    found: list[tuple[int, int]] = []
    total, start = 0, None
    for i, n in enumerate([*lengths, None]):
        total = 0 if n is None else total + n - (lengths[i - window] if i >= window else 0)
        if n is not None and total > threshold:
            start = max(0, i - window + 1, found[-1][1] if found else 0) if start is None else start
        elif start is not None:
            stop = i
            while start < stop and not lengths[start]:
                start += 1
            while start < stop and not lengths[stop - 1]:
                stop -= 1
            if start < stop:
                found.append((start, stop))
            start = None
    return found


def main_text(html: str | None, window: int = WINDOW, threshold: float = THRESHOLD) -> str:
    if not html:
        return ""
    lines = lines_of(html)
    if any(inside and not outside for _, outside, inside in lines):
        return "\n".join(text for text, outside, inside in lines if inside and not outside)
    lengths = [len(text) for text, _, _ in lines]
    fullest = max((sum(lengths[i : i + window]) for i in range(len(lengths))), default=0)
    found = regions(lengths, window, min(threshold, fullest / 2))
    return "\n".join(text for text, outside, _ in lines[found[0][0] : found[-1][1]] if not outside) if found else ""


def extract(pages: DataFrame, window: int = WINDOW, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), window, threshold) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
