"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams events; block elements part the page into lines. Each line has a
text-to-tag ratio (characters for each tag since the line before, at most ``MOST``). The ratios are smoothed with a
Gaussian along the page, and a line's score is its smoothed ratio times a weight: ``DOUBT`` within elements whose
tag, role or class speaks of boilerplate, else 1. The best split of the scores' logarithms into two clusters
parts content from the rest. A container (article, section, div, table cell and so on) most of whose characters are
content is a content region, and its short lines belong to it, as do the containers within a content article
or main element; lines that are links alone must pass by their own ratio.

An element that only seems to be boilerplate is none: one that holds the largest article or main element, or,
without any, ``WRAP`` of all characters; a header within an article; names such as with-sidebar or no-comments.

Edge cases: null and empty pages give the empty text, as do pages of boilerplate alone; unclosed and
unmatched tags are tolerated; repeated rows come back as often as they went in; extra columns are ignored.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.shared import freed, only, quoted

#: Elements of HTML: those without content, those that begin a new line, those that may be a region.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINER = frozenset("article aside body center div footer form header html main nav section td".split())
#: Elements whose text is never shown as text.
UNSEEN = frozenset("audio canvas datalist head iframe noframes noscript object script select style svg template textarea title video".split())
#: What speaks of boilerplate: a tag, a role, a part of a class or id (unless its first part says otherwise).
DOUBT_TAGS = frozenset("aside dialog footer form header menu nav".split())
DOUBT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
DOUBT_NAMES = frozenset(
    "ad ads advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification overlay pagination popup promo promoted promotion related respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
BUT = frozenset("with without has have no not hide show".split())
#: An open element of these is closed by the start of one of those.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NOT_IN_P = BLOCK - {"html", "head", "body", "title", "option", "legend", "caption"}
#: Lines over which ratios are smoothed, the greatest ratio, the weight of doubtful lines.
SIGMA, MOST, DOUBT = 1.5, 200.0, 0.005
#: Shares of characters: of a region that are content, of a page that a wrapper holds, of a line that links hold.
REGION, WRAP, LINKS = 0.5, 0.8, 0.8

_PARTS = re.compile(r"[^a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def marks(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Whether a tag or its attributes say that the element is boilerplate."""
    if tag in ("html", "body", "article", "main"):
        return False
    for name, value in attrs:
        value = (value or "").lower()
        if name in ("class", "id"):
            for parts in map(_PARTS.split, value.split()):
                if parts[0] not in BUT and not DOUBT_NAMES.isdisjoint(parts):
                    return True
        elif name == "hidden" or (name == "role" and value in DOUBT_ROLES) or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value)):
            return True
    return tag in DOUBT_TAGS


class Lines(HTMLParser):
    """Lines of a page (text, tags before it, whether it is links alone, its element) and the elements (parent, tag, doubtful)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int]] = []  # tag and element
        self.elements: list[tuple[int, str, bool]] = [(-1, "", False)]
        self.lines: list[tuple[str, int, bool, int]] = []
        self.text: list[str] = []
        self.tags = self.linked = self.links = self.unseen = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.linked >= LINKS * len(text), self.stack[-1][1] if self.stack else 0))
            self.tags = 0
        self.text, self.linked = [], 0

    def shut(self, depth: int) -> None:
        if any(tag in BLOCK for tag, _ in self.stack[depth:]):
            self.flush()
        for tag, _ in self.stack[depth:]:
            self.links -= tag == "a"
            self.unseen -= tag in UNSEEN
        del self.stack[depth:]

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        doubtful = bool(attrs or tag in DOUBT_TAGS) and marks(tag, attrs)
        if tag in BLOCK or doubtful:
            self.flush()
        if tag in BLOCK:
            if tag in NOT_IN_P:
                for i in range(len(self.stack) - 1, -1, -1):
                    if self.stack[i][0] == "p":
                        self.shut(i)
                        break
                    if self.stack[i][0] in CONTAINER or self.stack[i][0] in UNSEEN:
                        break
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in CLOSES.get(tag, ()):
                    self.shut(i)
                    break
                if self.stack[i][0] in ("ul", "ol", "dl", "table", "select") or self.stack[i][0] in CONTAINER:
                    break
        if tag in VOID:
            return
        if tag == "header" and doubtful and any(t in ("article", "main") for t, _ in self.stack):
            doubtful = marks("div", attrs)
        at = self.stack[-1][1] if self.stack else 0
        if tag in CONTAINER or doubtful:
            self.elements.append((at, tag, doubtful))
            at = len(self.elements) - 1
        self.links += tag == "a"
        self.unseen += tag in UNSEEN
        self.stack.append((tag, at))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "a", "span", "b", "i"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if self.elements[self.stack[i][1]][2]:
                    self.flush()
                self.shut(i)
                return
            # an end tag of an inline element doesn't reach out of its block
            if tag not in BLOCK and self.stack[i][0] in BLOCK:
                return

    def handle_data(self, data):
        if not self.unseen:
            self.text.append(data)
            if self.links:
                self.linked += len(data.strip())


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing that does not darken the ends."""
    reach = int(3 * sigma)
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    pick = slice(reach, reach + len(ratio))
    return np.convolve(ratio, kernel)[pick] / np.convolve(np.ones(len(ratio)), kernel)[pick]


def upper_cluster(values: np.ndarray) -> np.ndarray:
    """Which values are in the upper of the two clusters with the least squared error."""
    order = np.sort(values)
    n, total = np.arange(1, len(order)), np.cumsum(order)
    if not len(n) or order[0] == order[-1]:
        return np.ones(len(values), bool)
    # of the errors, only the squared sums depend on where the values are split
    gain = total[:-1] ** 2 / n + (total[-1] - total[:-1]) ** 2 / (len(order) - n)
    return values > order[int(np.argmax(np.where(order[1:] > order[:-1], gain, -1)))]


def doubts(elements: list[tuple[int, str, bool]], held: list[int]) -> list[bool]:
    """Which elements lie within boilerplate, given the characters under each."""
    mains = [i for i, (_, tag, _) in enumerate(elements) if tag in ("article", "main")]
    spared = set()
    if mains:
        at = max(mains, key=lambda i: (held[i], -i))
        while at >= 0:
            spared.add(at)
            at = elements[at][0]
    out: list[bool] = []
    for i, (parent, _, doubtful) in enumerate(elements):
        wraps = i in spared if mains else held[i] >= WRAP * held[0] and elements[i][1] not in ("nav", "footer")
        out.append((parent >= 0 and out[parent]) or (doubtful and not wraps))
    return out


def main_text(html: str | None, content_of=upper_cluster) -> str:
    """The lines of a page's content regions, one on each row."""
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    page.flush()
    if not page.lines:
        return ""
    elements, at = page.elements, np.array([e for *_, e in page.lines])
    size = np.array([len(text) for text, *_ in page.lines])
    held = np.bincount(at, size, len(elements)).astype(int).tolist()
    for i in range(len(elements) - 1, 0, -1):
        held[elements[i][0]] += held[i]
    doubtful = np.array(doubts(elements, held))[at]
    if doubtful.all():
        return ""
    ratio = np.array([min(MOST, len(text) / max(1, tags)) for text, tags, *_ in page.lines])
    links = np.array([links for _, _, links, _ in page.lines])
    content = content_of(np.log1p(np.where(links, np.minimum(ratio, smoothed(ratio)), smoothed(ratio)) * np.where(doubtful, DOUBT, 1.0)))
    plain = ~doubtful & ~links
    every = np.bincount(at[plain], size[plain], len(elements))
    good = np.bincount(at[plain & content], size[plain & content], len(elements))
    whole_every, whole_good = every.copy(), good.copy()
    for i in range(len(elements) - 1, 0, -1):
        whole_every[elements[i][0]] += whole_every[i]
        whole_good[elements[i][0]] += whole_good[i]
    region = (good > 0) & (good >= REGION * every)
    inside = [False] * len(elements)
    for i, (parent, tag, _) in enumerate(elements):
        own = tag in ("article", "main") and whole_good[i] > 0 and whole_good[i] >= REGION * whole_every[i]
        inside[i] = own or (parent >= 0 and inside[parent])
    chosen = content | (plain & (region | np.array(inside))[at])
    return "\n".join(text for (text, *_), c in zip(page.lines, chosen, strict=True) if c)


def extract(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """The key columns and text, the main text of every whole page."""
    rows = only(pages, *keys, html)
    n = len(keys)

    def run(batches):
        for batch in batches:
            texts = pa.array([main_text(h.as_py()) for h in batch.column(n)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], texts], names=[*keys, "text"])

    return rows.mapInArrow(freed(run), ", ".join([*(f"{quoted(k)} {rows.schema[k].dataType.simpleString()}" for k in keys), "text string"]))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
