"""Text, metadata and links of web pages. Spark has no tolerant HTML parser: one pass of the standard library's, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream import config as C
from lodestream.functions import urls
from lodestream.operators.filters import title_ok

SKIPPED = {"script", "style", "nav", "footer", "header", "noscript"}
VOID = {"br", "img", "meta", "link", "input", "hr", "source", "area", "base", "col", "embed", "wbr"}
# Where the main content of a page is looked for, in this order; what is never part of it.
MAIN = [("tag", "article"), ("tag", "main"), ("role", "main"), ("class", "post-content"), ("class", "article-content"), ("class", "main-content"), ("id", "content")]
JUNK_TAGS = {"aside", "iframe", "form"}
JUNK_CLASSES = {"share", "shares", "comment", "comments", "related", "recommend", "advert", "ad", "ads", "breadcrumb", "pagination"}


class _Reader(HTMLParser):
    """Collects what the operators need while it reads; unclosed and stray tags are tolerated."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.open, self.text = base, [], []
        self.found: dict[int, list[str]] = {}  # text of the first element of each place of the main content
        self.title, self.heading, self.meta, self.links, self.feeds, self.time = "", "", {}, [], [], ""
        self.anchor: list | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            name = (a.get("property") or a.get("name") or "").lower()
            if name and name not in self.meta:
                self.meta[name] = a.get("content", "")
        elif tag == "link" and a.get("href") and "alternate" in a.get("rel", "").lower() and any(kind in a.get("type", "").lower() for kind in ("rss", "atom", "xml")):
            self.feeds.append(urljoin(self.base, a.get("href", "")))
        elif tag == "a" and a.get("href"):
            self.anchor = [a["href"].strip(), []]
        elif tag == "img" and self.anchor and a.get("alt"):
            self.anchor[1].append(a["alt"])
        elif tag == "time" and not self.time:
            self.time = a.get("datetime", "")
        if tag not in VOID:
            classes = set(a.get("class", "").lower().split())
            have = {"tag": {tag}, "role": {a.get("role", "")}, "class": classes, "id": {a.get("id", "")}}
            marks = [i for i, (where, name) in enumerate(MAIN) if name in have[where] and i not in self.found]
            self.found |= {i: [] for i in marks}
            self.open.append((tag, marks, tag in JUNK_TAGS or bool(classes & JUNK_CLASSES)))

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self.anchor:
            self.links.append((self.anchor[0], " ".join(" ".join(self.anchor[1]).split())))
            self.anchor = None
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        tags = {t for t, _, _ in self.open}
        if self.open and self.open[-1][0] == "title":
            self.title += data
        elif not tags & SKIPPED:
            if "h1" in tags:
                self.heading += data
            if data.strip():
                self.text.append(data.strip())
                if not any(junk for _, _, junk in self.open):
                    for _, marks, _ in self.open:
                        for i in marks:
                            self.found[i].append(data.strip())
        if self.anchor is not None:
            self.anchor[1].append(data)


    def main(self) -> str:
        """Text of the first place that the page has, without junk; else of the whole page."""
        held = self.found[min(self.found)] if self.found else self.text
        return "\n".join(held)


def read_page(html: str | None, base: str | None) -> _Reader:
    r = _Reader(base or "")
    r.feed(html or "")
    r.close()
    return r


FIELDS = "text string, main string, title string, author string, published string, summary string, links array<struct<url:string,title:string,position:int>>, feeds array<string>"
#: Bytes of HTML that are read to rows at once.
RUN = 1 << 20


def _runs(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about RUN bytes of a column; a longer value stands alone."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + RUN, "right")))
        yield batch.slice(i, j - i)
        i = j


def _fields(h: str | None, u: str | None) -> tuple:
    """FIELDS of one page."""
    r = read_page(h, u)
    m = r.meta
    body = "\n".join(r.text)
    links = []
    for i, (href, title) in enumerate(r.links):
        try:
            links.append({"url": urljoin(u or "", href), "title": title, "position": i})
        except ValueError:
            continue
    return body, r.main() or body, (m.get("og:title") or r.heading or r.title).strip(), m.get("author") or m.get("article:author"), m.get("article:published_time") or r.time or None, (m.get("description") or m.get("og:description") or body)[:1000], links, r.feeds


def parse_pages(pages: DataFrame, key: str, html: str = "html", url: str = "url", fields: list[str] | None = None) -> DataFrame:
    """One pass: text, main content, metadata, links and feeds of each page, or those of them in ``fields``. ``key`` may be the column of URLs.

    A task holds a batch of pages as it came, and what it makes of RUN bytes of them.
    """
    kind = pages.schema[key].dataType.simpleString()
    names = [f.split(" ")[0] for f in FIELDS.split(", ")]
    wanted = [n for n in names if fields is None or n in fields]
    types = {"links": pa.list_(pa.struct([("url", pa.string()), ("title", pa.string()), ("position", pa.int32())])), "feeds": pa.list_(pa.string())}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _runs(batch, 1):
                rows = [_fields(h.as_py(), u.as_py()) for h, u in zip(part.column(1), part.column(2), strict=True)]
                made = [pa.array([r[names.index(n)] for r in rows], types.get(n, pa.string())) for n in wanted]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], [key, *wanted])

    schema = ", ".join(f for f in FIELDS.split(", ") if f.split(" ")[0] in wanted)
    return pages.select(F.col(key).alias("key"), F.col(html).alias("html"), F.col(url).alias("url")).mapInArrow(each, f"`{key}` {kind}, {schema}")


def extract_links(parsed: DataFrame, key: str, include: Column | None = None, exclude: Column | None = None) -> DataFrame:
    """Links of each page with an article's URL and title, the first of each URL."""
    none = F.lit(None).cast("array<string>")
    flat = parsed.select(key, F.inline("links")).withColumn("url", urls.strip_fragment("url"))
    ok = flat.filter(urls.article_url_ok("url") & title_ok(F.col("title"), C.BLOCKED_TITLES, none if include is None else include, none if exclude is None else exclude))
    return ok.groupBy(key, "url").agg(F.min(F.struct("position", "title")).alias("_f")).select(key, "url", "_f.title", "_f.position")


def feed_links(pages: DataFrame, key: str, html: str = "html", url: str = "url") -> DataFrame:
    """(key, kind, feed): the feed that a page holds itself, from where it begins; else the feeds that it links to."""
    places = [F.locate(mark, F.lower(html)) for mark in ("<?xml", "<rss", "<feed")]
    at = F.array_min(F.filter(F.array(*places), lambda i: i > 0))
    starts = pages.withColumn("_at", at)
    held = starts.filter("_at > 0").select(key, F.lit("embedded").alias("kind"), F.expr(f"substring(`{html}`, _at)").alias("feed"))
    linked = parse_pages(starts.filter("coalesce(_at, 0) = 0"), key, html, url, ["feeds"]).select(key, F.lit("link").alias("kind"), F.explode(F.array_distinct("feeds")).alias("feed"))
    return held.unionByName(linked)


def expand_links(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(node, depth) reached breadth-first from ``seeds`` over ``edges`` (src, dst). Each round joins the frontier, and takes away what was seen."""
    from lodestream.sources.store import written

    seen = written(seeds.select("node", F.lit(0).alias("depth")).distinct(), "frontier")
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = written(step.withColumn("depth", F.lit(d)), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def expand_site(seeds: DataFrame, links: DataFrame, depth: int = 2, max_pages: int = 20, max_urls: int = 100, rules: DataFrame | None = None) -> DataFrame:
    """(source, url, title, rank): articles found by following listing pages breadth-first from each source's start, within its budgets.

    ``seeds``: source, url, domain; ``links``: page, position, url, title, a row for
    each link. The result is that of a queue: pages are taken in the order in which
    they were put in, each once, if on the domain and allowed by robots, until
    ``max_pages`` were taken; links to articles with a title of six characters are
    kept in order, each URL once, until there are ``max_urls``; other links that look
    like listings go into the queue, up to ``depth``. A level of all queues is one round.
    """
    from lodestream.operators.filters import robots_filter
    from lodestream.sources.store import written

    def allowed(df: DataFrame) -> DataFrame:
        on = df.filter((urls.bare_host("url") == F.col("domain")) | F.endswith(urls.bare_host("url"), F.concat(F.lit("."), "domain")))
        return robots_filter(on, "url", rules) if rules is not None else on

    title = F.length(F.coalesce("title", F.lit(""))) >= 6
    marked = links.withColumn("article", urls.looks_like_article("url") & title)
    level = seeds.select("source", "url", "domain", urls.host("url").alias("home"), F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")).alias("at"))
    taken = None
    for d in range(depth + 1):
        level = allowed(level).groupBy("source", "url", "domain", "home").agg(F.min("at").alias("at"))
        if taken is not None:
            before = taken.groupBy("source").agg(F.max("visit").alias("before"))
            level = level.join(taken.select("source", "url"), ["source", "url"], "left_anti").join(before, "source")
        else:
            level = level.withColumn("before", F.lit(0))
        visit = F.col("before") + F.row_number().over(Window.partitionBy("source").orderBy("at", "url"))
        now = written(level.withColumn("visit", visit).filter(F.col("visit") <= max_pages).select("source", "url", "domain", "home", "visit"), "level")
        taken = now if taken is None else taken.unionByName(now)
        if d < depth:
            out = now.withColumnRenamed("url", "page").join(marked.filter("not article"), "page")
            level = out.filter(urls.looks_like_listing(F.col("url"), F.col("home"))).select("source", "url", "domain", "home", F.struct(F.col("visit").alias("a"), F.col("position").alias("b")).alias("at"))
    found = allowed(taken.select("source", F.col("url").alias("page"), "domain", "visit").join(marked.filter("article"), "page"))
    first = found.groupBy("source", "url").agg(F.min(F.struct("visit", "position", "title")).alias("f"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy("f.visit", "f.position", "url"))
    return first.withColumn("rank", rank).filter(F.col("rank") <= max_urls).select("source", "url", "f.title", "rank")


@F.pandas_udf(T.StringType())
def _joined(base: pd.Series, link: pd.Series) -> pd.Series:
    def one(b: str | None, u: str | None) -> str | None:
        try:
            return urljoin(b or "", u.strip()) if u is not None else None
        except ValueError:
            return None

    return pd.Series([one(b, u) for b, u in zip(base, link, strict=True)], dtype=object)


def absolute(link: Column | str, base: Column | str) -> Column:
    """A link made absolute against its page. Only links with dot segments, queries or fragments of their own go through Python."""
    u, b = F.trim(F.col(link) if isinstance(link, str) else link), F.col(base) if isinstance(base, str) else base
    root = F.regexp_extract(b, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    folder = F.regexp_extract(b, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(?:/[^?#]*/|/))", 1)
    plain = ~F.contains(u, F.lit("./")) & ~u.rlike(r"(^|/)\.{1,2}([/?#]|$)")
    out = F.when(plain & u.rlike("^https?://[^/?#]+/"), u).when(plain & u.rlike("^//[^/?#]+/"), F.concat(F.regexp_extract(b, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), u))
    out = out.when(plain & (root != "") & u.rlike("^/[^/]"), F.concat(root, u)).when(plain & (folder != "") & u.rlike("^[A-Za-z0-9_-][^:?#]*$"), F.concat(folder, u))
    return F.regexp_replace(out.otherwise(_joined(b, u)), "#.*$", "")


@F.udtf(returnType="url: string, title: string, position: int")
class PageLinks:
    """Table function: the links of one page, for use in SQL once registered."""

    def eval(self, html: str, base: str):
        for i, (href, title) in enumerate(read_page(html, base).links):
            try:
                yield urljoin(base or "", href), title, i
            except ValueError:
                continue
