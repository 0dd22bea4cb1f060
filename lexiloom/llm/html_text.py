"""Main text of web pages: text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

Python's streaming parser turns a page into lines: one for each block of text, with the number
of tags met since the line before. A line's ratio is its characters over its tags. Ratios are
smoothed along the page with a Gaussian kernel. Lines whose smoothed ratio reaches the threshold
form the content clusters: the standard deviation of the smoothed ratios, or PART of what the
median character of the page has, if that is less. Lines whose own ratio reaches it too are
strong; they say where the article is:

* What a page marks as something else (NOT_CONTENT elements, roles, names in class or id) has the
  ratio 0 and never counts.
* Marked articles (CONTENT elements) that hold a line of a cluster are the article, whole.
* Elsewhere, lines that are nothing but links, several in a row or in one line, are menus. They and
  page furniture (navigation, headers, footers) cut the page into segments. The heaviest segment, by
  characters of strong lines, holds the article; its region is the innermost element around its
  strong lines. A segment belongs to it that has strong lines in the same region, or, where the
  region is the whole page, SHARE of the heaviest's weight. From the first strong line to the last
  all lines stay, short ones too; outwards, lines of the same region and paragraphs and headings
  next to it up to the next menu.

Lines are joined in page order by one space; white space in a line becomes one space; character
references are decoded. Time is linear in the page's length.

Defined cases: null or empty html, or a page without text or without a strong line, gives an empty
text; unclosed and wrongly nested tags close with their parent; very long pages and very deep ones
are taken whole; ties of segments go to the first; repeated rows are separate rows, null ids and
urls stay null; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import map_arrow, spread, table

#: Smoothing radius in lines; the kernel's standard deviation is as large.
RADIUS = 2
#: The threshold in standard deviations of the smoothed ratios, and as a part of the median character's.
DEVIATIONS, PART = 1.0, 1 / 3
#: The part of the heaviest segment's weight that another one needs where the region is the whole page.
SHARE = 0.1
#: The part of a line's letters that are links in a menu, and of a page's text that only a wrapper holds.
LINKED, WRAPPER = 0.8, 0.9

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_SAME = frozenset("li dd dt option tr td th thead tbody tfoot".split())
NO_TEXT = frozenset("script style noscript template head title svg math iframe object canvas audio video select textarea button datalist".split())
CONTENT = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold text of their own, wherever they stand.
PROSE = HEADINGS | frozenset("p blockquote pre li dd dt td th figcaption".split())
FURNITURE = frozenset("nav header footer menu".split())
NOT_CONTENT = frozenset("aside dialog".split()) | FURNITURE | NO_TEXT
NOT_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar form".split())
#: Names in class or id: of parts that are no article, and of parts that layouts also give to a wrapper of the whole page.
PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising breadcrumb breadcrumbs comment comments cookie cookies consent disqus gdpr newsletter "
    "notice notices pagination promo related reply replies respond share sharing signup social sponsor sponsored subscribe subscription".split()
)
LAYOUT = frozenset("banner footer header masthead menu modal nav navbar navigation overlay popup sidebar toc toolbar widget widgets".split())
#: Words that go with these in one name, as in "comment-list" or "site-footer".
BESIDE = frozenset(
    "area article articles bar block box button buttons bottom col column container entry form group inline inner item items left link links list main outer "
    "page panel post posts primary right row secondary section site slot stories story text thread title top unit wrap wrapper".split()
)
#: Elements that can be the region of content.
REGIONS = frozenset("article center div main section table tbody td tr".split())
SPACE = re.compile(r"\s+")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9_\-\s]+")
NO_LETTER = re.compile(r"[\W_]+")


def named(value: str, whole: bool) -> frozenset[str]:
    """The PARTS and LAYOUT words that the names of a class or id consist of; whole asks for names of one word."""
    found = set()
    for name in value.split():
        words = [name.lower()] if whole else [w.lower() for w in NAME.findall(name)]
        own = [w for w in words if w in PARTS or w in LAYOUT]
        if own and all(w in own or w in BESIDE or w.isdigit() for w in words):
            found.update(own)
    return frozenset(found)


class Page(HTMLParser):
    """Events to lines, as parallel lists, and the elements that matter, with the lines from first to before last."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = []  # tag, no content from here on, number of the element or -1
        self.places: dict[str, list[int]] = {}  # of each tag, the open ones
        self.blocks: list[int] = []  # the open blocks
        self.tags = self.anchors = self.chars = self.titles = 0
        self.text: list[str] = []
        self.link: list[str] = []
        self.hidden = self.edge = False
        # lines: text (of an off line none), tags, no content, a border of segments, all links, number of links, innermost block
        self.lines: list[str] = []
        self.tag_counts: list[int] = []
        self.off: list[bool] = []
        self.border: list[bool] = []
        self.linked: list[bool] = []
        self.link_counts: list[int] = []
        self.block: list[str] = []
        # elements: kind (content, region, or the words that name it), first and last line, characters and titles before and in it
        self.kinds: list[str | frozenset[str]] = []
        self.first: list[int] = []
        self.last: list[int] = []
        self.held: list[int] = []
        self.titled: list[int] = []

    def end_line(self) -> None:
        if not self.text and not self.hidden:
            return
        line = SPACE.sub(" ", "".join(self.text)).strip()
        if line or self.hidden:
            self.lines.append(line)
            self.tag_counts.append(self.tags)
            self.off.append(not line)
            self.border.append(not line and self.edge)
            self.block.append(self.open[self.blocks[-1]][0] if self.blocks else "")
            letters = len(NO_LETTER.sub("", "".join(self.link))) if self.link else 0
            self.linked.append(letters > 0 and self.block[-1] not in HEADINGS and letters >= LINKED * len(NO_LETTER.sub("", line)))
            self.link_counts.append(self.anchors)
            self.chars += len(line)
            self.tags = 0
        self.text, self.link, self.hidden, self.anchors, self.edge = [], [], False, 0, False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        if tag == "a":
            self.anchors += 1
        if tag in VOID:
            return
        if tag in BLOCKS and self.blocks:  # an open paragraph, or the item of the same kind, ends by itself
            other = self.open[self.blocks[-1]][0]
            if other == "p" or (other == tag and tag in CLOSES_SAME):
                self.close_from(self.blocks[-1])
        off = bool(self.open) and self.open[-1][1]
        number = -1
        if not off:
            off, words = self.marked(tag, attrs)
            kind = words or ("content" if tag in CONTENT else "region" if tag in REGIONS else "")
            if tag == "h1" and not off:
                self.titles += 1
            if kind and not off:
                number = len(self.kinds)
                self.kinds.append(kind)
                self.first.append(len(self.lines))
                self.last.append(-1)
                self.held.append(self.chars)
                self.titled.append(self.titles - (tag in CONTENT))  # an article counts as a title
                if words and tag in CONTENT:
                    self.titled[-1] += 1
        if off and tag in FURNITURE:
            self.edge = True
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append((tag, off, number))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in NO_TEXT:
            self.handle_endtag(tag)

    def close_from(self, place: int) -> None:
        """Close the open elements from this place on."""
        while len(self.open) > place:
            tag, _, number = self.open.pop()
            self.places[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
            if number >= 0:
                self.last[number] = len(self.lines)
                self.held[number] = self.chars - self.held[number]
                self.titled[number] = self.titles - self.titled[number]

    def inside(self, *tags: str) -> bool:
        return any(self.places.get(t) for t in tags)

    def marked(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, frozenset[str]]:
        """Whether the page marks an element as no content, and else the words that name it so, to be judged by what it holds."""
        none: frozenset[str] = frozenset()
        if tag in ("html", "body"):
            return False, none
        if tag in NOT_CONTENT and not (tag == "header" and self.inside(*CONTENT)):
            return True, none
        words = frozenset(["menu"]) if tag == "form" else none
        for name, value in attrs:
            value = value or ""
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                return True, none
            if name == "style" and "display:none" in value.lower().replace(" ", ""):
                return True, none
            if name == "role" and value.lower() in NOT_CONTENT_ROLES:
                return True, none
            if name in ("class", "id") and tag != "main" and tag not in HEADINGS and not self.inside("pre", "code"):
                words |= named(value, tag in CONTENT)
        if words and self.inside(*CONTENT):
            words -= {"header"}  # an article's own
        if words and tag not in BLOCKS:  # an inline element is no wrapper
            return True, none
        return False, words

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        places = self.places.get(tag)
        # a stray inline end tag doesn't close blocks
        if places and not (tag not in BLOCKS and self.blocks and self.blocks[-1] > places[-1]):
            self.close_from(places[-1])

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][1]:
            if not data.isspace() and self.open[-1][0] not in NO_TEXT:
                self.hidden = True
                self.edge = self.edge or self.inside(*FURNITURE)
            return
        self.text.append(data)
        if self.places.get("a"):
            self.link.append(data)

    def done(self) -> None:
        self.close()
        self.end_line()
        self.close_from(0)
        # elements that are named for something else go, unless they wrap the page; outer ones come first
        reach = 0
        for kind, first, last, held, titled in zip(self.kinds, self.first, self.last, self.held, self.titled, strict=True):
            if isinstance(kind, frozenset) and first < last:
                wrapper = titled > 0 and 2 * held > self.chars
                if kind <= LAYOUT:
                    wrapper = wrapper or held > WRAPPER * self.chars or (titled > 0 and "header" in kind)
                if not wrapper:
                    for i in range(max(first, reach), last):
                        if not self.off[i]:
                            self.off[i] = True
                            self.border[i] = not kind <= PARTS
                    reach = max(reach, last)


def smoothed(ratios: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / max(radius, 1)) ** 2)
    return np.convolve(ratios, kernel / kernel.sum(), mode="full")[radius : radius + len(ratios)]


def threshold(smooth: np.ndarray, chars: np.ndarray) -> float:
    """What a smoothed ratio must reach; chars: each line's characters, 0 of a line that doesn't count."""
    order = np.argsort(smooth, kind="stable")
    median = smooth[order][np.searchsorted(np.cumsum(chars[order]), chars.sum() / 2)]
    return min(DEVIATIONS * float(smooth.std()), PART * float(median))


def covered(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n lines is in one of the intervals."""
    change = np.bincount(first, minlength=n + 1)[: n + 1] - np.bincount(last, minlength=n + 1)[: n + 1]
    return np.cumsum(change)[:n] > 0


def chosen_lines(page: Page) -> np.ndarray:
    """Whether each line belongs to the article."""
    n = len(page.lines)
    off = np.array(page.off, bool)
    chars = np.where(off, 0, np.array([len(t) for t in page.lines]))
    none = np.zeros(n, bool)
    if not chars.any():
        return none
    ratios = chars / np.maximum(np.array(page.tag_counts), 1)
    smooth = smoothed(ratios)
    limit = threshold(smooth, chars)
    linked = np.array(page.linked, bool) & ~off
    row = np.pad(linked, 1)
    menu = linked & ((np.array(page.link_counts) > 1) | row[:-2] | row[2:])
    core = ~off & ~menu & (smooth >= limit) & (smooth > 0)
    strong = core & (ratios >= limit)
    if not strong.any():
        return none
    upto = np.concatenate([[0], np.cumsum(core)])
    of = {kind: np.array([(f, l) for k, f, l in zip(page.kinds, page.first, page.last, strict=True) if k == kind and l > f], np.int64).reshape(-1, 2) for kind in ("content", "region")}
    marked = of["content"]
    marked = marked[upto[marked[:, 1]] > upto[marked[:, 0]]]
    if len(marked):
        return covered(marked[:, 0], marked[:, 1], n) & ~off

    # segments between menus and furniture, weighed by the characters of their strong lines
    segment = np.cumsum(menu | np.array(page.border, bool))
    weight = np.bincount(segment, np.where(strong & ~menu, chars, 0))
    heaviest = int(weight.argmax())
    own = (strong & (segment == heaviest)).nonzero()[0]
    around = of["region"][(of["region"][:, 0] <= own[0]) & (of["region"][:, 1] > own[-1])]
    a, b = around[np.argmin(around[:, 1] - around[:, 0])] if len(around) else (0, n)
    inside = np.zeros(n, bool)
    if len(around):
        inside[a:b] = True
        mine = (strong & inside).nonzero()[0]
    else:
        mine = (strong & (weight >= SHARE * weight[heaviest])[segment]).nonzero()[0]
    lo, hi = int(mine[0]), int(mine[-1])
    stays = inside | np.array([t in PROSE for t in page.block], bool)
    ends = menu | np.array(page.border, bool) | (~off & ~stays)
    before, after = ends[:lo].nonzero()[0], ends[hi + 1 :].nonzero()[0]
    lo = int(before[-1]) + 1 if len(before) else 0
    hi = hi + int(after[0]) if len(after) else n - 1
    out = none
    out[lo : hi + 1] = True
    return out & ~off


def main_text(html: str | None) -> str:
    page = Page()
    page.feed(html or "")
    page.done()
    return " ".join(page.lines[i] for i in chosen_lines(page).nonzero()[0].tolist())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = spread(pages.select(F.col(id_col).cast("long"), F.col(url_col), F.col(html_col)))
    return map_arrow(rows, run, "page_id long, url string, text string, n_chars long", 2)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
