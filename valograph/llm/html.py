"""Main text of web pages: the contiguous region with the largest sum of word and tag scores.

A page is read as a row of tokens: the words of a text node count as many times their score, a tag counts once. Scores
are log-likelihood ratios from labelled pages, those whose markup names its article: how often a kind of token stands
inside it against outside. Words never score below zero there, tags never above. One linear scan finds the best region,
and the region's blocks are the text.

Menus, notices, adverts, forms and comments are known by their elements or by a class, id or role that says nothing else:
``related-posts`` and ``cookie-notice`` do, ``related-work`` and ``banner-years`` don't. Their words count as tags do and
make no block. A name that holds such a word beside others only marks its words as a kind of their own: they make blocks,
and count for or against a region as the labelled pages say, or not at all. Inside an article's element they are words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from valograph.llm.shared import batch_of, text_slices

LABELLED = 20_000  # labelled pages that the scores are learned from, about; chosen by a hash of the page's id
#: Element names of HTML by what they mean here.
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "textarea", "select", "object", "video", "audio", "canvas", "annotation", "annotation-xml")
APART = ("nav", "footer", "aside", "form", "head", "header", "dialog", "menu", "button", "title")
ARTICLE = ("article", "main")
HOLDERS = (*APART, *ARTICLE, "div", "section", "ul", "ol", "table", "body", "html", "figure", "details", "fieldset", "blockquote", "dl", "p", "span", "a", "h1", "h2", "h3", "h4", "h5", "h6", "li")
BLOCKS = (*APART, *ARTICLE, "address", "blockquote", "body", "caption", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "li", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul")
INLINE = ("a", "abbr", "b", "br", "code", "em", "i", "img", "input", "label", "link", "meta", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "time", "u")
KINDS = ("word", "link word", "word apart", "word marked", *(f"{e}{t}" for t in dict.fromkeys((*BLOCKS, *INLINE, *RAW)) for e in ("", "/")), "other")
#: Words of a class, id or role that mark an element as no part of the article, and words that often stand
#: beside them in a name without changing what it says.
MARKS = "ad|ads|advert|advertisement|adsense|banner|breadcrumb|breadcrumbs|comment|comments|consent|contentinfo|cookie|cookies|disclaimer|disqus|footer|login|menu|modal|nav|navbar|navigation|newsletter|notice|popup|promo|promotion|related|replies|share|sharing|sidebar|signup|social|sponsor|sponsored|subscribe|toolbar|widget"
HEAD_MARKS = "header|masthead"
BESIDE = "area|articles|bar|block|body|bottom|box|btn|button|buttons|col|column|container|content|count|feed|form|google|group|icons|inner|item|items|left|link|links|list|main|module|outer|page|pane|panel|post|posts|primary|right|row|secondary|section|site|slot|stories|story|text|thread|title|top|unit|user|view|wrap|wrapper"
_MARKS, _HEADS = frozenset(MARKS.split("|")), frozenset(HEAD_MARKS.split("|"))
_BESIDE = frozenset(BESIDE.split("|")) | _MARKS | _HEADS
_PART = re.compile(r"[A-Z]*[a-z]+|[A-Z]+|[^\W\d_]+")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"\shidden(?=[\s/>=]|$)", re.I)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    rf"|<({'|'.join(RAW)})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S | re.I,
)
_KIND = {k: i for i, k in enumerate(KINDS)}
WORD, LINK, ASIDE, MARKED = 0, 1, 2, 3
FREE, NAMED, OUT = 0, 1, 2  # an element as its name, class, id and role have it: nothing, marked, apart
_HOLDERS, _BLOCKS, _APART_TAGS = frozenset(HOLDERS), frozenset(BLOCKS), frozenset(APART)
_EMPTY = frozenset(("br", "hr", "img", "input", "link", "meta", "source", "wbr", "col", "area", "base", "embed", "track"))
_COUNTS = pa.schema([("kind", pa.int32()), ("inside", pa.int64()), ("outside", pa.int64())])
_TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
#: Scores where no page is labelled: a word, a linked word, a word apart, a marked word, any tag.
DEFAULT = np.array([1.0, 0.1, -2.0, 0.0, *[-2.0] * (len(KINDS) - 4)])
for _t in ("p", "/p", "br", "b", "/b", "i", "/i", "em", "/em", "strong", "/strong", "h1", "/h1", "h2", "/h2", "h3", "/h3", "blockquote", "/blockquote", "li", "/li", "a", "/a", "span", "/span"):
    DEFAULT[_KIND[_t]] = -0.1


class Page:
    """Tokens (kind, how many words, inside an article) and blocks (text, first and last token, apart) of a page."""

    def __init__(self, html: str):
        self.kinds: list[int] = []
        self.times: list[int] = []
        self.inside: list[bool] = []
        self.blocks: list[tuple[str, int, int]] = []
        self.labelled = False
        stack: list[tuple[str, int, bool, bool]] = [("", FREE, False, False)]  # name, what it is, in an article, in a link
        parts: list[str] = []
        first = last = 0

        def close_block():
            nonlocal parts
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.blocks.append((text, first, last))
                parts = []

        at = 0
        for m in _TOKEN.finditer(html):
            if m.start() > at:
                self._text(html[at : m.start()], stack[-1], parts)
                if parts and len(parts) == 1:
                    first = len(self.kinds) - 1
                last = len(self.kinds) - 1
            at = m.end()
            name = m[3] or m[6]
            if not name:
                if m[1]:
                    self._add(_KIND[m[1].lower()], 1, stack[-1][2])
                continue
            name, end, rest = name.lower(), m[2] or m[5] or "", m[4] or m[7] or ""
            self._add(_KIND.get(end + name, len(KINDS) - 1), 1, stack[-1][2] and name not in ARTICLE)
            if name in _BLOCKS:
                close_block()
            elif name == "br" and parts:
                parts.append(" ")
            if end:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
            elif name not in _EMPTY and not rest.endswith("/"):
                _, what, inside, link = stack[-1]
                own = max(what, self._what(name, rest, inside))
                if name in _HOLDERS or own > what:
                    while name in ("p", "li") and stack[-1][0] in ("p", "a", "span", "li"):  # an open one ends here
                        if stack[-1][0] == "li" and name == "p":
                            break
                        stack.pop()
                    _, what, inside, link = stack[-1]
                    own = max(what, self._what(name, rest, inside))
                    self.labelled |= name in ARTICLE
                    stack.append((name, own, inside or name in ARTICLE, link or name == "a"))
        if at < len(html):
            self._text(html[at:], stack[-1], parts)
            if len(parts) == 1:
                first = len(self.kinds) - 1
            last = len(self.kinds) - 1
        close_block()

    def _add(self, kind: int, times: int, inside: bool) -> None:
        self.kinds.append(kind)
        self.times.append(times)
        self.inside.append(inside)

    def _text(self, raw: str, state, parts: list[str]) -> None:
        text = unescape(raw)
        words = len(text.split())
        _, what, inside, link = state
        if words:
            self._add(ASIDE if what == OUT else MARKED if what == NAMED else LINK if link else WORD, words, inside)
        if what != OUT and (words or parts):
            parts.append(text)

    @staticmethod
    def _what(name: str, rest: str, inside: bool) -> int:
        if name in _APART_TAGS and not (name == "header" and inside):
            return OUT
        if not rest or name in ("body", "html", *ARTICLE):
            return FREE
        if _HIDDEN.search(rest):
            return OUT
        most = FREE
        for key, a, b, c in _ATTRIBUTE.findall(rest):
            value, key = a or b or c, key.lower()
            if key == "style":
                if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    return OUT
            elif key == "aria-hidden":
                if value.lower() == "true":
                    return OUT
            else:
                for one in value.split():
                    parts = {p.lower() for p in _PART.findall(one)}
                    if parts & _MARKS or (not inside and parts & _HEADS):
                        if parts <= _BESIDE:
                            return OUT
                        most = NAMED
        return most

    def main_text(self, scores: np.ndarray) -> str:
        """The blocks that the best region touches, in page order, joined by line breaks."""
        if not self.kinds:
            return ""
        kinds = np.array(self.kinds)
        kinds[(kinds == MARKED) & np.array(self.inside)] = WORD
        gain = scores[kinds] * np.array(self.times)
        sums = np.concatenate(([0.0], np.cumsum(gain)))
        lowest = np.minimum.accumulate(sums)
        end = int(np.argmax(sums - lowest))
        if sums[end] <= lowest[end]:
            return ""
        start = int(np.argmax(sums[: end + 1] == lowest[end]))
        return "\n".join(text for text, first, last in self.blocks if last >= start and first < end)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inside, outside = (np.zeros(len(KINDS), np.int64) for _ in range(2))
    for batch in batches:
        for html in batch.column("html").to_pylist():
            page = Page(html)
            if page.labelled:
                kinds, times, flag = np.array(page.kinds), np.array(page.times), np.array(page.inside)
                inside += np.bincount(kinds[flag], times[flag], len(KINDS)).astype(np.int64)
                outside += np.bincount(kinds[~flag], times[~flag], len(KINDS)).astype(np.int64)
    yield batch_of(_COUNTS, kind=np.arange(len(KINDS), dtype=np.int32), inside=inside, outside=outside)


def learned_scores(pages: DataFrame, page_id: str = "page_id", html: str = "html", most: int = LABELLED) -> np.ndarray:
    """A score for each of ``KINDS`` from about ``most`` pages whose markup names an article; the defaults without any."""
    marked = pages.select(F.col(page_id).alias("page_id"), F.col(html).alias("html")).where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    share = min(1.0, most / max(1, pages.count()))
    some = marked.where(F.pmod(F.xxhash64("page_id"), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else marked
    rows = some.select("html").mapInArrow(_count, from_arrow_schema(_COUNTS)).groupBy("kind").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).collect()
    inside, outside = (np.zeros(len(KINDS)) for _ in range(2))
    for r in rows:  # one per kind
        inside[r["kind"]], outside[r["kind"]] = r["i"], r["o"]
    if not inside.sum() or not outside.sum():
        return DEFAULT
    ratio = np.log((inside + 1) / (inside.sum() + len(KINDS))) - np.log((outside + 1) / (outside.sum() + len(KINDS)))
    seen = (inside + outside) > 0
    scores = np.where(seen, np.minimum(ratio, -0.01), DEFAULT)
    scores[WORD] = min(max(ratio[WORD], 0.1), 1.0)
    scores[LINK] = max(ratio[LINK], 0.0) if seen[LINK] else DEFAULT[LINK]
    # Words apart make no block, so a region may pass them where it goes on behind them; below -2 one advert would end it.
    scores[ASIDE] = min(max(ratio[ASIDE], -2.0), -0.5)
    scores[MARKED] = min(ratio[MARKED], scores[WORD]) if seen[MARKED] else DEFAULT[MARKED]
    return scores


def _extract(scores: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "html"):
                texts = [Page(h).main_text(scores) if h else "" for h in batch.column("html").to_pylist()]
                yield batch_of(_TEXTS, page_id=batch.column("page_id"), url=batch.column("url"), text=texts)

    return run


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", scores: np.ndarray | None = None) -> DataFrame:
    """``page_id, url, text`` of every page. A null or empty page, or one without words, has an empty text.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by line breaks.
    """
    scores = learned_scores(pages, page_id, html) if scores is None else scores
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(_extract(scores), from_arrow_schema(_TEXTS))
