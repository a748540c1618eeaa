"""Fields and main content of article pages by selectors: a tag, ``.class``, ``#id`` or ``[name=value]``, tried in order."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions.times import free_time
from lodestream.operators.pages import JUNK_CLASSES, JUNK_TAGS, SKIPPED, VOID

# Meta names and selectors of each field, in order; places of the content.
TITLE_META, TITLES = ["og:title", "twitter:title"], ["h1", ".article-title", ".post-title", ".title"]
AUTHOR_META, AUTHORS = ["author", "article:author"], [".author", ".article-author", ".post-author", ".name"]
TIME_META, TIMES = ["article:published_time", "pubdate", "publishdate", "date"], ["time", ".time", ".date", ".publish-time", ".pub-time", ".article-time"]
CONTENT = ["article", "main", "[role=main]", ".article-content", ".post-content", ".entry-content", ".content", ".article", ".news-content", ".detail-content", ".main-content", "#content"]

#: Elements that end where another of the same kind begins.
CLOSED_BY_NEXT = {"p", "li", "option", "tr", "td", "th", "dt", "dd"}


class _Element:
    __slots__ = ("attrs", "classes", "end", "first", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], first: int):
        self.tag, self.attrs, self.first, self.end = tag, attrs, first, None
        self.classes = frozenset(attrs.get("class", "").split())


class Tree(HTMLParser):
    """Elements in document order, each with the range of its pieces of text. Unclosed and stray tags are tolerated."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.elements, self.open, self.pieces, self.meta = [], [], [], {}
        self.by: dict[str, list[_Element]] = {}
        self.feed(html)
        self.close()
        self._end(0)

    def _end(self, depth: int) -> None:
        for e in self.open[depth:]:
            e.end = len(self.pieces)
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            for name in ("property", "name", "itemprop"):
                if a.get(name) and a.get("content"):
                    self.meta.setdefault((name, a[name]), a["content"])
        if tag in CLOSED_BY_NEXT and self.open and self.open[-1].tag == tag:
            self._end(len(self.open) - 1)
        e = _Element(tag, a, len(self.pieces))
        self.elements.append(e)
        for key in {tag, *(f".{c}" for c in e.classes), f"#{a.get('id', '')}", *(f"[{k}={v}]" for k, v in a.items() if k == "role")}:
            self.by.setdefault(key, []).append(e)
        if tag in VOID:
            e.end = e.first
        else:
            self.open.append(e)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._end(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                self._end(i)
                break

    def handle_data(self, data: str) -> None:
        if data.strip() and not (self.open and self.open[-1].tag in ("script", "style")):
            self.pieces.append(data.strip())

    def named(self, metas: list[str]) -> str:
        for m in metas:
            for kind in ("property", "name", "itemprop"):
                if self.meta.get((kind, m), "").strip():
                    return self.meta[kind, m].strip()
        return ""

    def first(self, selectors: list[str]) -> str:
        """The time or text of the first element of the first selector that has one."""
        for s in selectors:
            for e in self.by.get(s, [])[:1]:
                found = e.attrs.get("datetime") or " ".join(self.pieces[e.first : e.end])
                if found.strip():
                    return found.strip()
        return ""

    def content(self, selectors: list[str], rejected: list[str]) -> str:
        """The longest text of all elements that a selector names and no rejected word is in, else of the body; junk inside is left out."""
        nodes = list({id(e): e for s in selectors for e in self.by.get(s, [])}.values()) or self.by.get("body", [])[:1]
        best, length = None, 0
        for e in nodes:
            text = _clean("\n".join(self.pieces[e.first : e.end]))
            if len(text) > length and not any(w.lower() in text.lower() for w in rejected):
                best, length = e, len(text)
        if best is None:
            return ""
        drop = set()
        for e in self.elements:
            if e is not best and best.first <= e.first and e.end <= best.end and (e.tag in SKIPPED | JUNK_TAGS or e.classes & JUNK_CLASSES):
                drop.update(range(e.first, e.end))
        return _clean("\n".join(p for i, p in enumerate(self.pieces[best.first : best.end], best.first) if i not in drop))


def _clean(text: str) -> str:
    text = re.sub(r"[ \t]{2,}", " ", re.sub(r"\r\n?", "\n", text))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def page_details(pages: DataFrame, key: str, reference: Column | None = None, html: str = "html", content: list[str] | None = None, rejected: list[str] | None = None, titles: list[str] | None = None, authors: list[str] | None = None, times: list[str] | None = None) -> DataFrame:
    """(key, title, author, published, publish_time, summary, content) of each page.

    A meta name that is given wins over selectors. ``published`` is the text as it
    stands, ``publish_time`` its time (words such as hours ago against ``reference``,
    now if none is given); the summary is the first 1000 characters of the content.
    Null and empty pages give empty texts.
    """
    kind = pages.schema[key].dataType.simpleString()
    places, words = CONTENT if content is None else content, rejected or []
    asked = (TITLE_META, TITLES if titles is None else titles), (AUTHOR_META, AUTHORS if authors is None else authors), (TIME_META, TIMES if times is None else times)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, h in zip(f[key], f[html], strict=True):
                t = Tree(h or "")
                rows.append((k, *(t.named(m) or t.first(s) for m, s in asked), t.content(places, words)))
            yield pd.DataFrame(rows, columns=[key, "title", "author", "published", "content"])

    read = pages.select(key, html).mapInPandas(each, f"`{key}` {kind}, title string, author string, published string, content string")
    at = F.current_timestamp().cast("timestamp_ntz") if reference is None else reference
    return read.select(key, "title", "author", "published", free_time("published", at).alias("publish_time"), F.substring("content", 1, 1000).alias("summary"), "content")
