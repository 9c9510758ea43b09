"""Operator 9: main text of web pages by two passes of block rules.

A page is read into blocks: runs of text between block-level tags, with the ends that HTML
implies.  Scripts, styles, forms and hidden parts are no blocks at all.  All other blocks go
through both passes.

1. Every block is weighed: length and stop words speak for it, link density against it, and so do
   menus, headers, footers, asides and elements whose class or id names boilerplate; standing
   in an article element is one more thing that speaks for it.  What weighs enough either
   way is decided.  Few stop words alone never decide, as a block may be in another language.
2. Ambiguous blocks inherit the label of the nearest decided ones, in an article those of
   the article first.

If nothing is good, blocks that only a class or id name spoke against are weighed without it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Link densities of boilerplate and of much of it; lengths and stop-word densities of text.
LINKS, MANY_LINKS, SHORT, LONG, FEW_STOPS, MANY_STOPS = 0.2, 0.5, 70, 200, 0.15, 0.25
#: What a block must weigh to be good; as much below 0 is bad.
DECIDED = 1.5
#: A page whose blocks have a smaller share of any language's stop words is in a language without a list.
KNOWN_LANGUAGE = 0.12

# Tags and names.
_RAW = frozenset({"script", "style", "template", "textarea", "title", "noscript", "iframe", "svg", "math", "xmp", "noembed", "noframes"})
_DROPPED = frozenset({"form", "button", "select", "dialog", "menu", "object", "head", "fieldset"})
_PLACES = frozenset({"nav", "footer", "aside", "header"})
_BLOCKS = frozenset({
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend",
    "li", "main", "menu", "nav", "object", "ol", "optgroup", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td",
    "tfoot", "th", "thead", "tr", "ul",
})
_VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
#: Elements whose start ends an open paragraph, and which elements a start ends otherwise, up to what holds them.
_ENDS_P = _BLOCKS - {"body", "button", "caption", "dd", "dt", "head", "html", "legend", "li", "object", "optgroup", "option", "select", "tbody", "td", "tfoot", "th", "thead", "tr"}
_CELLS = frozenset({"td", "th", "caption", "table", "object", "button", "html"})
_LISTS = frozenset({"ul", "ol", "menu", "dir"})
_IMPLIED = {
    "li": (("li",), _LISTS), "dd": (("dd", "dt"), frozenset({"dl"})), "dt": (("dd", "dt"), frozenset({"dl"})), "td": (("td", "th"), frozenset({"table", "tr"})), "th": (("td", "th"), frozenset({"table", "tr"})),
    "tr": (("tr",), frozenset({"table"})), "tbody": (("tbody", "thead", "tfoot"), frozenset({"table"})), "tfoot": (("tbody", "thead", "tfoot"), frozenset({"table"})), "thead": (("tbody", "thead", "tfoot"), frozenset({"table"})), "option": (("option",), frozenset({"select"})),
}
_ARTICLE = frozenset({"article", "main"})
_HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
#: Words of class names of boilerplate, and those that may stand beside them in one name.
_NAMES = frozenset({
    "ad", "ads", "adsense", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
    "cookie", "cookies", "copyright", "disclaimer", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "notification", "pagination", "pager", "popup", "promo", "related", "replies", "share", "sharing", "sidebar",
    "signup", "skyscraper", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar",
})
_BESIDE = frozenset({"area", "bar", "block", "body", "bottom", "box", "buttons", "container", "form", "global", "inner", "item", "left", "link", "links", "list", "main", "outer", "right", "section", "site", "top", "unit", "wrap", "wrapper"})
_ROLES = frozenset({"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"})
_STOPS = tuple(
    frozenset(words.split())
    for words in (
        "a an and are as at be been but by for from had has have he her his i in is it its not of on or she so that the their they this to was we were which will with would you",
        "aber als am auch auf aus bei das dass dem den der des die ein eine einen er es für hat ich im ist mit nicht noch nur sich sie sind und vom von war wie wird zu zum zur",
        "au aux avec ce cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour que qui sa se ses son sur un une vous",
        "al como con del de el ella en entre era es esta este ha la las lo los más no o para pero por que se ser sin sobre su sus un una y ya",
    )
)

_TOKEN = re.compile(
    r"<!--(?:>|->)?.*?(?:--!?>|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME = re.compile(r"[a-z]+")
_MARKS = ".,;:!?\"'()[]“”„«»"
_ENDS: dict[str, re.Pattern] = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I) for tag in _RAW}


OUT, ASIDE, NAMED = 1, 2, 3


def _says_boilerplate(value: str) -> bool:
    """Does a class or id name boilerplate? Whole names count: ``sidebar`` and ``ad-box`` do, ``has-sidebar`` doesn't."""
    for name in value.split():
        words = _NAME.findall(name)
        if not _NAMES.isdisjoint(words) and all(w in _NAMES or w in _BESIDE for w in words):
            return True
    return False


def _kind(tag: str, attributes: str, in_article: bool) -> int:
    """``OUT`` for an element that holds no text of the page, ``ASIDE`` for one beside the article, ``NAMED`` if only its name says so, else 0."""
    if tag in _DROPPED:
        return OUT
    kind = ASIDE if tag in _PLACES and not (tag == "header" and in_article) else 0
    if "=" not in attributes and "hidden" not in attributes:
        return kind
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "role" and value in _ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return OUT
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return OUT
        if not kind and key in ("class", "id") and tag not in ("body", "html", "main") and not (in_article and tag == "header") and _says_boilerplate(value):
            kind = NAMED
    return kind


class _Block:
    __slots__ = ("article", "aside", "heading", "label", "links", "named", "text", "weight")

    def __init__(self, text: str, links: int, article: int, aside: bool, named: bool, heading: bool):
        self.text, self.links, self.article, self.aside, self.named, self.heading, self.label, self.weight = text, links, article, aside, named, heading, "", 0.0


class _Open:
    """The open elements of a page. Whether one of a tag is open, and where, is known without a search."""

    def __init__(self):
        self.stack: list[list] = []  # tag, kind, an article, open
        self.at: dict[str, list[int]] = {}
        self.inside = [0, 0, 0, 0]
        self.article = 0
        self.around = 0  # elements beside the text that the article itself stands in

    def beside(self) -> int:
        return self.inside[ASIDE] + self.inside[NAMED]

    def last(self, *tags: str) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def push(self, tag: str, kind: int, article: int) -> None:
        self.at.setdefault(tag, []).append(len(self.stack))
        self.stack.append([tag, kind, article, True])
        self.inside[kind] += 1
        if article:
            self.article, self.around = article, self.beside()

    def _end(self, entry: list) -> None:
        if entry[3]:
            entry[3] = False
            self.at[entry[0]].pop()
            self.inside[entry[1]] -= 1
            if entry[2]:
                self.article = 0

    def close(self, k: int) -> None:
        """End the element at ``k`` and all in it."""
        while len(self.stack) > k:
            self._end(self.stack[-1])
            self.stack.pop()

    def end_inline(self, tag: str) -> None:
        """End the last inline element of a tag; blocks in it stay open."""
        if self.at.get(tag):
            k = self.at[tag][-1]
            if k == len(self.stack) - 1:
                self.close(k)
            else:
                self._end(self.stack[k])

    def start(self, tag: str) -> None:
        """End what the start of a block ends."""
        if tag in _ENDS_P and (k := self.last("p")) > self.last(*_CELLS):
            self.close(k)
        if tag in _IMPLIED:
            ended, holders = _IMPLIED[tag]
            if (k := self.last(*ended)) > self.last(*holders) and k >= 0:
                self.close(min(j for t in ended if self.at.get(t) for j in [self.at[t][-1]] if j > self.last(*holders)))


def blocks_of(page: str) -> list[_Block]:
    """The blocks of a page in order, without labels; what holds no text of the page is left out. Takes time in proportion to the page."""
    out: list[_Block] = []
    parts: list[str] = []
    links, in_link, articles, heading = 0, False, 0, False
    tags = _Open()
    inside = tags.inside

    def end_block() -> None:
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(_Block(text, min(links, len(text)), tags.article if tags.beside() == tags.around else 0, inside[ASIDE] > 0, inside[NAMED] > 0, heading))
            parts.clear()
        links = 0

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and not inside[OUT]:
            parts.append(text)
            if in_link:
                links += len(text.strip())
        if not m:
            break
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA[") and not inside[OUT]:
                parts.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag, closing, attributes = m[2].lower(), m[1], m[3]
        if tag in _RAW and not closing:
            if not attributes.endswith("/"):
                end = _ENDS[tag].search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag not in _BLOCKS:
            if tag == "a":
                in_link = not closing
            if tag == "br":
                parts.append(" ")
            elif closing:
                tags.end_inline(tag)
            elif tag not in _VOID and not attributes.endswith("/"):
                tags.push(tag, _kind(tag, attributes, bool(tags.article)) if attributes else 0, 0)
            continue
        end_block()
        heading = tag in _HEADINGS and not closing
        if closing:
            if (k := tags.last(tag)) >= 0 and (tag != "p" or k > tags.last(*_CELLS)):
                tags.close(k)
            continue
        if tag in _VOID:
            continue
        in_link = False
        tags.start(tag)
        if tag in _ARTICLE and not tags.article and (k := min((tags.at[t][0] for t in ("nav", "header", "footer", "head", "menu") if tags.at.get(t)), default=-1)) >= 0:
            tags.close(k)  # a menu or header that was never closed
        if tag == "body":
            tags.close(0)
        kind = _kind(tag, attributes, bool(tags.article))
        main = tag in _ARTICLE and not tags.article and not kind and not inside[OUT] and not inside[ASIDE]
        articles += main
        tags.push(tag, kind, articles if main else 0)
    end_block()
    return out


def _stop_shares(text: str) -> list[float]:
    """Share of each language's stop words among the words of a text."""
    words = [w.strip(_MARKS) for w in text.lower().split()]
    return [sum(w in known for w in words) / len(words) for known in _STOPS]


def first_pass(blocks: list[_Block], names: bool = True) -> None:
    """Weigh blocks by length, links, stop words and place; label ``good`` or ``bad`` what weighs enough.

    Without ``names``, class and id names of boilerplate count for nothing, and only running text
    without them can be good.
    """
    shares = {k: _stop_shares(b.text) for k, b in enumerate(blocks) if len(b.text) >= SHORT}
    # The page's language: the one whose stop words its blocks of running text hold most.
    long = [k for k in shares if blocks[k].links <= LINKS * len(blocks[k].text) and not blocks[k].aside]
    size = sum(len(blocks[k].text) for k in long)
    pooled = [sum(len(blocks[k].text) * shares[k][n] for k in long) for n in range(len(_STOPS))]
    known = bool(size) and max(pooled) >= KNOWN_LANGUAGE * size
    for k, b in enumerate(blocks):
        n, weight = len(b.text), float(b.article > 0)
        if b.aside or (b.named and names):
            weight -= 4
        if b.links > MANY_LINKS * n:
            weight -= 5
        elif b.links > LINKS * n:
            weight -= 1.5
        if b.text[0] == "©":
            weight -= 2
        if n < SHORT:
            if b.links:
                weight -= 1.5
        else:
            weight += n > LONG
            if not known:
                weight += 0.5
            elif (share := max(shares[k])) >= MANY_STOPS:
                weight += 1
            elif share < FEW_STOPS:
                weight -= 1
        b.weight = weight
        b.label = "good" if weight >= DECIDED else "bad" if weight <= -DECIDED else ""


def _nearest(blocks: list[_Block], own: bool) -> list[list[int]]:
    """For each block the nearest labelled ones before and after it, of its own article or of the page."""
    found: list[list[int]] = [[] for _ in blocks]
    for order in (range(len(blocks)), range(len(blocks) - 1, -1, -1)):
        last: dict[int, int] = {}
        for k in order:
            key = blocks[k].article if own else 0
            if key in last:
                found[k].append(last[key])
            if blocks[k].label:
                last[key] = k
    return found


def second_pass(blocks: list[_Block]) -> None:
    """Label what the first pass left: each block takes the label of the nearest decided one, of two as near the one before.

    A heading looks at what comes after it first.  In an article the article's own blocks count
    alone, and a good one on either side is enough; beside a good article only blocks outside of it
    count, and what they leave open is bad.  Without a decided block to inherit from, the
    block's own weight says.
    """
    own, page = _nearest(blocks, True), _nearest(blocks, False)
    good_article = any(b.article and b.label == "good" for b in blocks)
    labels = []
    for k, b in enumerate(blocks):
        near = own[k] if b.article or good_article else page[k]
        if b.label:
            labels.append(b.label)
        elif not near and good_article and not b.article:
            labels.append("bad")
        elif not near:
            labels.append("good" if b.weight >= 0 else "bad")
        elif b.article:
            labels.append("good" if any(blocks[j].label == "good" for j in near) else "bad")
        else:
            labels.append(blocks[min(near, key=lambda j: (b.heading and j < k, abs(j - k), j))].label)
    for b, label in zip(blocks, labels, strict=True):
        b.label = label


def main_text(page: str | None) -> str:
    """The main text of a page: its good blocks, one to a line."""
    if not page:
        return ""
    blocks = blocks_of(page)
    first_pass(blocks)
    if not any(b.label == "good" for b in blocks) and any(b.named for b in blocks):
        first_pass(blocks, names=False)
        if not any(b.label == "good" for b in blocks):
            first_pass(blocks)
    second_pass(blocks)
    return "\n".join(b.text for b in blocks if b.label == "good")


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, url, text, n_chars`` for each row of ``pages``.

    Null and empty pages, and pages of boilerplate alone, have an empty text.  Broken markup
    is read as far as it goes.  Rows with equal or null ids or urls each keep a row; other
    columns aren't read.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "id long, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
