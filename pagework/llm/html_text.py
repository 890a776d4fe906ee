"""Main text of a web page, from the events of the standard library's parser.

Events are cut into lines at block elements. Each line has a text-to-tag ratio: characters of text for
each tag met on it. The ratios are smoothed by a Gaussian and split by a threshold of their spread;
lines above it are content, and the part of the page that holds most of the content is the article.
Inside it every line counts that is not part of a menu, header, footer, side bar, notice, advert, form
or reader comment. A page without ``article`` or ``main`` gives the lines of its content regions.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagework.llm.common import bodies, free_name, map_texts

#: Spread of the smoothing in lines, and the threshold as a share of the ratios' standard deviation.
SIGMA, THRESHOLD = 1.0, 0.9

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody "
    "td tfoot th thead title tr ul".split()
)
#: Elements whose text is never part of an article.
APART = frozenset(
    "nav footer aside form head title script style noscript template svg math iframe object canvas audio video button "
    "select textarea dialog menu".split()
)
HOMES = frozenset(("article", "main"))
CONTAINERS = HOMES | {"section", "div", "td"}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_APART_NAME = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|adsense|sponsor|sponsored|promo|promotion|"
    r"sidebar|side-bar|menu|menubar|nav|navbar|navigation|breadcrumb|breadcrumbs|toc|header|masthead|footer|cookie|cookies|consent|"
    r"gdpr|notice|notices|banner|alert|comment|comments|reply|replies|respond|disqus|share|sharing|social|related|"
    r"recommended|newsletter|subscribe|signup|login|popup|modal|overlay|widget|pagination|pager|search|skip)(?:$|[\s_-])",
    re.I,
)
_APART_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())


def _set_apart(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    if tag in APART:
        return True
    for name, value in attrs:
        if not value:
            if name == "hidden":
                return True
        elif name in ("class", "id"):
            if tag not in ("html", "body", "article", "main") and _APART_NAME.search(value):
                return True
            if tag == "article" and re.search(r"\b(?:comment|reply|promo|ad|teaser)s?\b", value, re.I):
                return True
        elif name == "role" and value.strip().lower() in _APART_ROLE:
            return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
    return False


class _Lines(HTMLParser):
    """Lines of a page as (text, tags, home, apart): home is the number of the innermost container that
    encloses the line. Container 0 is the page; ``kinds`` and ``parents`` describe the others."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool]] = []
        self.open: list[tuple[str, bool, int, bool, bool]] = []  # a tag and the state before it
        self.text: list[str] = []
        self.tags = 0
        self.apart, self.home, self.header, self.mute = False, 0, False, False
        self.kinds, self.parents = ["page"], [0]

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            self.text.clear()
            if text:
                heading = self.header and bool(self.home) and any(o[0] in HEADINGS for o in self.open[-3:])
                self.lines.append((text, self.tags, self.home, self.apart or (self.header and not heading)))
                self.tags = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if tag in VOID:
            return
        if tag in HOMES and (self.apart or self.header) and not _set_apart(tag, attrs):
            # A menu or notice that was not closed ends where an article begins, unless it is a list of them.
            while self.open and (self.apart or self.header) and self.open[-1][0] not in ("aside", "form"):
                self._close(len(self.open) - 1)
        self.open.append((tag, self.apart, self.home, self.header, self.mute))
        if not self.apart and _set_apart(tag, attrs):
            self.apart = True
            self.mute = tag not in BLOCKS  # it stands inside a line, which goes on after it
        if tag == "header":
            self.header = True
        if tag in CONTAINERS and not self.apart:
            self.kinds.append(tag)
            self.parents.append(self.home)
            self.home = len(self.kinds) - 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1

    def _close(self, at: int) -> None:
        _, self.apart, self.home, self.header, self.mute = self.open[at]
        del self.open[at:]

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        for at in range(len(self.open) - 1, -1, -1):
            name = self.open[at][0]
            if name == tag:
                self._close(at)
                return
            if name in ("body", "article", "main", "table", "td") and tag not in ("html", "body", "article", "main", "table", "tr", "div", "section"):
                return  # an end tag of a small element does not end what encloses it

    def handle_data(self, data: str) -> None:
        if not self.mute:
            self.text.append(data)

    def unknown_decl(self, data: str) -> None:
        pass


def parse_page(html: str) -> _Lines:
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser


def content_lines(ratios: np.ndarray, sigma: float = SIGMA, threshold: float = THRESHOLD) -> np.ndarray:
    """Which lines have a smoothed ratio of at least ``threshold`` standard deviations of the ratios.
    Where all lines are alike all are content."""
    if not len(ratios):
        return np.zeros(0, bool)
    radius = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    padded = np.pad(ratios, radius, mode="edge")
    smooth = np.convolve(padded, kernel / kernel.sum(), mode="valid")
    return smooth >= min(threshold * smooth.std(), smooth.max())


def _chain(parents: list[int], home: int) -> list[int]:
    chain = [home]
    while chain[-1]:
        chain.append(parents[chain[-1]])
    return chain


def main_text(html: str) -> str:
    """The article of a page. An empty page or one without text has the empty text."""
    page = parse_page(html)
    lines = page.lines
    ratios = np.array([0.0 if apart else len(text) / max(tags, 1) for text, tags, _, apart in lines])
    content = content_lines(ratios)
    chains = {home: _chain(page.parents, home) for _, _, home, _ in lines}
    weight: dict[int, int] = {}
    for (text, _, home, apart), chosen in zip(lines, content):
        if chosen and not apart:
            for at in chains[home]:
                weight[at] = weight.get(at, 0) + len(text)
    if not weight:
        return ""
    # An article with most of the content, or else the innermost container with nearly all of it.
    homes = {h: w for h, w in weight.items() if page.kinds[h] in HOMES and 2 * w >= weight[0]}
    most = max(homes.values(), default=weight[0])
    best = max((h for h, w in (homes or weight).items() if 5 * w >= 4 * most), key=lambda h: len(_chain(page.parents, h)))
    if best:
        kept = [text for text, _, home, apart in lines if not apart and best in chains[home]]
    else:
        at = [i for i, (line, chosen) in enumerate(zip(lines, content)) if chosen and not line[3]]
        kept = [text for text, _, _, apart in lines[at[0] : at[-1] + 1] if not apart]
    return " ".join(kept)


def extract_text(pages: DataFrame, *columns: str | Column, html: str = "html") -> DataFrame:
    """The given columns with ``text``, the main text, and ``n_chars``, its code points.

    Null and empty pages have the empty text; repeated rows are extracted one each; bytes that are no
    UTF-8 become U+FFFD.
    """
    kept = pages.select(*columns)
    names = kept.columns
    raw = free_name(names)

    def extract(part: pa.RecordBatch) -> pa.RecordBatch:
        found = [main_text(b.decode("utf-8", "replace")) for b in bodies(part, raw)]
        return pa.RecordBatch.from_arrays(
            [*(part.column(c) for c in names), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
            [*names, "text", "n_chars"],
        )

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema)
    rows = pages.select(*columns, F.col(html).cast("binary").alias(raw))
    return map_texts(rows, extract, fields + "text string, n_chars long", column=raw)
