"""Main text of web pages from streaming parser events.

The standard library's parser calls back for each tag and text; nothing but a stack of open
elements is kept. Text between block tags is a line. Each line has a text-to-tag ratio; the
ratios are smoothed by a Gaussian along the page and split in two clusters by a threshold. The
lines above it choose the content region, which holds them all and the text next to it; what
pages mark as not being the article is left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of formulas. Each token inside one is a word, and a formula counts as one tag.
MATH = set(
    "annotation annotation-xml maction math menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms "
    "mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split()
)
INLINE = MATH | set(
    "a abbr acronym b bdi bdo big button cite code data del dfn em font i img ins kbd label mark output q ruby rb rt rp s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
#: Inline elements that are no text where a line holds nothing else.
CONTROLS = ("button", "label")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
IN_HEAD = set("base link meta noscript script style template title".split())
#: Elements that hold no article text; ``annotation`` is a formula's source, which is not shown.
DROPPED = set(
    "annotation annotation-xml applet aside audio canvas datalist dialog embed fieldset footer form frame frameset head iframe input map menu "
    "meter nav noembed noframes noscript object option progress script select style svg template textarea title video".split()
)
#: Words of a class, id or role that name reader comments, and those of menus, headers, footers, sidebars, adverts and forms.
COMMENTS = set("comment commentlist comments disqus replies respond".split())
MARKS = set(
    "ad ads adv advert advertisement advertisements advertising adverts breadcrumb breadcrumbs consent contentinfo "
    "cookie cookies footer gdpr login masthead menu menubar menus modal nav navbar navigation newsletter outbrain pager pagination popup "
    "promoted sharing sidebar sidebars signup sponsor sponsored subscribe subscription taboola toolbar topbar".split()
)
#: Words that may also name a part of an article: inside one they are believed of link lists and of elements without a line of text.
WEAK = set(
    "banner complementary copyright dialog disclaimer form hidden notice notices notification notifications overlay promo promotion "
    "recommended recommendations related reply search share social widget widgets".split()
)
#: Words that say which or where. A name made of these and marks only is a mark: "site-footer", "left sidebar"; "has-sidebar", "no-ads" and "related-work" are not.
PLACES = set(
    "bar block bottom box btn button column container desktop fixed floating global group inner item items left link links list mobile module "
    "outer page panel primary reader right row secondary section site slot sticky top unit user wrap wrapper".split()
)
OF_ARTICLE = set("article blog entry main post".split())
CONTAINERS = set("html body main article section div td blockquote center".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Share of link text that makes a line a link line.
LINKED = 0.5
SIGMA, RADIUS = 1.0, 2
_KERNEL = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_COMMENT_END = re.compile(r"--\s*>")


def _closed(html: str) -> str:
    """The page with every markup that never ends written as text, so that the parser looks for no end in vain."""
    ends = [m.end() for m in _COMMENT_END.finditer(html)]
    last = ends[-1] if ends else 0
    html = (html[:last] + html[last:].replace("<!--", "&lt;!--")).replace("<![", "<! [")  # outside formulas and drawings a comment
    last = html.rfind(">") + 1
    return html[:last] + html[last:].replace("<", "&lt;")


class _Lines(HTMLParser):
    """Lines of a page: text, its tags (the block's own one too), its share of link text, its element, its links."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # of every element, in page order; ``marks``: its class, id or role speaks against it, ``weak``: perhaps
        self.parent, self.name, self.drops, self.marks, self.weak = [-1], [""], [False], [False], [False]
        self.stack, self.open = [0], Counter()
        self.article = 0  # open article and main elements
        self.formula = False  # a token of the open formula is written
        self.lines: list[tuple[str, int, float, int, int]] = []
        self.text: list[str] = []
        self.tags, self.linked, self.links, self.pressed, self.at = 0, 0, 0, 0, 0

    def end_line(self) -> None:
        if self.text:
            words = " ".join("".join(self.text).split())
            if words and self.pressed < sum(len(t.strip()) for t in self.text):
                self.lines.append((words, self.tags, self.linked / len(words), self.at, self.links))
            self.text = []
        self.tags, self.linked, self.links, self.pressed = 0, 0, 0, 0

    def pop(self, tag: str) -> None:
        """Close the innermost open ``tag`` and all that is open inside it."""
        while len(self.stack) > 1:
            name = self.name[self.stack.pop()]
            self.open[name] -= 1
            self.article -= name in ("article", "main")
            if name == tag:
                return

    def judged(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, bool, bool]:
        """Whether the element is dropped, is marked, and is perhaps marked."""
        if tag in DROPPED or (tag == "header" and not self.article):
            return True, False, False
        marked = weak = False
        for key, value in attrs:
            if key in ("class", "id", "role"):
                for name in (value or "").split():
                    words = {w.lower() for w in _WORD.findall(name)}
                    if words <= COMMENTS | MARKS | WEAK | PLACES | OF_ARTICLE:
                        if not words.isdisjoint(COMMENTS) and tag not in ("html", "body", "main"):
                            return True, False, False
                        marked |= not words.isdisjoint(MARKS)
                        weak |= not words.isdisjoint(WEAK)
                    elif "header" in words and words <= PLACES | {"header", "main"} and not self.article:
                        marked = True
            elif key == "hidden" or (key == "aria-hidden" and value == "true"):
                return True, False, False
        exempt = tag in ("html", "body", "main", "article")
        return False, marked and not exempt, weak and not exempt

    def handle_starttag(self, tag, attrs):
        if self.open["head"] and tag not in IN_HEAD:
            self.pop("head")
        if tag not in INLINE:
            self.end_line()
            if self.open["p"]:
                self.pop("p")
            if tag in ("li", "td", "th", "tr", "dt", "dd", "option") and self.name[self.stack[-1]] == tag:
                self.pop(tag)
        self.tags += not self.open["math"]
        self.links += tag == "a"
        self.formula &= tag != "math"
        if tag in VOID:
            return
        up = self.stack[-1]
        self.parent.append(up)
        self.name.append(tag)
        dropped, marked, weak = self.judged(tag, attrs)
        self.drops.append(self.drops[up] or dropped)
        self.marks.append(marked)
        self.weak.append(weak)
        self.stack.append(len(self.name) - 1)
        self.open[tag] += 1
        self.article += tag in ("article", "main")

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.end_line()
        self.tags += tag == "math" or not self.open["math"]
        if self.open[tag] > 0:
            self.pop(tag)

    def handle_data(self, data):
        at = self.stack[-1]
        if self.drops[at]:
            return
        if not self.text:
            self.at = at
        if self.open["math"]:
            if self.formula:
                self.text.append(" ")
            self.formula = True
        self.text.append(data)
        if self.open["a"]:
            self.linked += len(data.strip())
        if any(self.open[c] for c in CONTROLS):
            self.pressed += len(data.strip())


def _smooth(ratio: np.ndarray) -> np.ndarray:
    """Gaussian smoothing along the lines; at the ends the kernel is cut and rescaled."""
    full = np.convolve(ratio, _KERNEL)[RADIUS : RADIUS + len(ratio)]
    return full / np.convolve(np.ones(len(ratio)), _KERNEL)[RADIUS : RADIUS + len(ratio)]


def _threshold(x: np.ndarray) -> float:
    """Border of two clusters of the smoothed ratios: means of both sides, until it stands still."""
    border = x.mean()
    for _ in range(50):
        low, high = x[x <= border], x[x > border]
        if not len(low) or not len(high) or (new := (low.mean() + high.mean()) / 2) == border:
            break
        border = new
    return float(border)


def _below(page: _Lines, chosen: list[bool]) -> list[bool]:
    """Of every element, whether it or one around it is chosen."""
    below = list(chosen)
    for k in range(1, len(below)):  # parents come before their children
        below[k] = below[k] or below[page.parent[k]]
    return below


def _unmarked(page: _Lines, inside: list[bool]) -> list[tuple[str, int, float, int, int]]:
    """The lines outside marked elements, and outside perhaps marked ones that are in no article.

    An element that wraps an article is no menu, sidebar or notice. Where marks leave no line at
    all, they are not believed.
    """
    wraps = [n in ("article", "main") for n in page.name]
    for k in range(len(wraps) - 1, 0, -1):
        wraps[page.parent[k]] |= wraps[k]
    out = _below(page, [not w and (m or (p and not i)) for m, p, w, i in zip(page.marks, page.weak, wraps, inside, strict=True)])
    return [x for x in page.lines if not out[x[3]]] or page.lines


def _menus(plain: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Of lines that are ``plain`` link lines, those in a row of two links or more."""
    run = np.cumsum(np.append(True, plain[1:] != plain[:-1])) - 1
    return plain & (np.bincount(run, weights=links)[run] >= 2)


def _with_neighbours(base: np.ndarray, stop: np.ndarray, link: np.ndarray, heading: np.ndarray) -> np.ndarray:
    """``base`` without menus, and the lines next to it up to the menus.

    A run of lines begins with text or a heading, also a linked one, and ends with text.
    """
    keep, run = base & ~stop, np.cumsum(stop)
    free = np.flatnonzero(~stop)
    for at in np.split(free, np.flatnonzero(np.diff(run[free])) + 1):
        if base[at].any():
            first, last = at[(base | ~link | heading)[at]][0], at[(base | ~link)[at]][-1]
            keep[first : last + 1] = True
    return keep


def main_text(html: str | None) -> str:
    """The article's blocks in page order, joined by one space; empty if there is none.

    Character references are decoded, and white space inside a block becomes one space. Markup
    that never ends is text. Dropped elements are those named in ``DROPPED``, a header outside
    articles, lines that are all button or label, and those that a class, id or role marks by a
    name of its own (``MARKS``, and ``WEAK`` outside articles) unless they wrap an article. Inside an
    article an element marked by a ``WEAK`` name goes if it is mostly links or has no line above the
    threshold. Every other line of articles (or ``main``) is kept, short ones too, and all text
    above the threshold that stands outside. Without an article the region is the innermost
    container with all text above the threshold, without the lines at its ends that are below it
    and mostly links. Lines beside what is kept, such as a title or a last remark, stay as well as
    far as the next menu. A menu, two or more links in a row of lines that are mostly links and not
    above the threshold, goes outside articles. A mostly linked line chooses no region if only the
    smoothing lifts it over the threshold, unless the whole page is such lines.
    """
    if not html:
        return ""
    page = _Lines()
    page.feed(_closed(html))
    page.close()
    page.end_line()
    own = [n in ("article", "main") for n in page.name]
    inside = _below(page, own)
    lines = _unmarked(page, inside)
    if not lines:
        return ""
    size = np.array([len(t) for t, *_ in lines], dtype=float)
    where = [at for _, _, _, at, _ in lines]
    link = np.array([share for _, _, share, _, _ in lines]) >= LINKED
    links = np.array([n for *_, n in lines])
    ratio = size / np.maximum([n for _, n, *_ in lines], 1)
    smooth = _smooth(ratio)
    border = min(_threshold(smooth), float(smooth.max()))
    content = smooth >= border
    solid = content & (~link | (ratio >= border))  # a menu line beside a paragraph is only smoothed over the threshold
    if not solid.any():
        solid = content
    kept = np.ones(len(lines), dtype=bool)
    if any(page.weak):
        kept = ~_perhaps(page, inside, where, size, link, solid)
    heading = np.array(_below(page, [n in HEADINGS for n in page.name]))[where]
    articles = np.array(inside)[where]
    if articles.any():
        base = articles | solid
    else:
        held = np.zeros(len(page.name))
        np.add.at(held, where, np.where(solid, size, 0.0))
        total = held.sum()
        for k in range(len(held) - 1, 0, -1):  # children come after their parents
            held[page.parent[k]] += held[k]
        # innermost: of nested elements the last in page order
        region = max((k for k in range(1, len(held)) if page.name[k] in CONTAINERS and held[k] == total), default=0)
        base = np.array(_below(page, [k == region for k in range(len(held))]))[where]
        ends = np.flatnonzero(base & (content | ~link))
        base[: ends[0]] = base[ends[-1] + 1 :] = False
    stop = _menus(link & ~heading & ~solid & ~articles, links)
    keep = _with_neighbours(base, stop, link, heading) & kept
    return " ".join(lines[i][0] for i in np.flatnonzero(keep))


def _perhaps(page: _Lines, inside: list[bool], where: list[int], size: np.ndarray, link: np.ndarray, solid: np.ndarray) -> np.ndarray:
    """Lines of articles in an element that is perhaps marked and is mostly links or has no solid line."""
    total, linked, text = (np.zeros(len(page.name)) for _ in range(3))
    np.add.at(total, where, size)
    np.add.at(linked, where, np.where(link, size, 0.0))
    np.add.at(text, where, np.where(solid & ~link, size, 0.0))
    for k in range(len(total) - 1, 0, -1):
        for held in (total, linked, text):
            held[page.parent[k]] += held[k]
    goes = [w and i and (linked[k] >= LINKED * total[k] or not text[k]) for k, (w, i) in enumerate(zip(page.weak, inside, strict=True))]
    return np.array(_below(page, goes))[where]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = [main_text(h.as_py()) for h in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string())], ["id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row (null html: empty text); one pass, no shuffle.

    Repeated rows and ids are each extracted; an empty table gives no rows; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = rows.mapInArrow(_texts, "id bigint, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("bigint").alias("n_chars"))
