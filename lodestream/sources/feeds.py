"""RSS and Atom feeds, one document each: files of a folder, or a column of a table of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions.times import feed_time
from lodestream.functions.urls import host

_LINK = "array<struct<_href:string,_rel:string,_VALUE:string>>"
_ENTRY = (
    f"array<struct<title:string,link:{_LINK},guid:array<struct<_VALUE:string,_isPermaLink:string>>,pubDate:string,published:string,updated:string,`dc:date`:string,"
    "description:string,summary:string,`content:encoded`:array<string>,content:array<string>,author:array<struct<name:string,_VALUE:string>>,`dc:creator`:string>>"
)
#: RSS 2.0 has its items in the channel, RSS 1.0 beside it, Atom has entries.
FEED = f"channel struct<item:{_ENTRY}>, item {_ENTRY}, entry {_ENTRY}"
#: Encodings that a feed may name in its first line; all others are read as UTF-8.
ENCODINGS = ["ISO-8859-1", "US-ASCII", "UTF-16", "UTF-16BE", "UTF-16LE"]


def _text(c: Column | str) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _link(entry: Column) -> Column:
    """The link that stands for the entry (no ``rel``, or ``alternate``), then a guid that is a URL by its own word."""
    links = F.filter(entry["link"], lambda l: F.coalesce(l["_rel"], F.lit("alternate")) == "alternate")
    urls = F.filter(F.transform(links, lambda l: F.coalesce(_text(l["_VALUE"]), _text(l["_href"]))), lambda u: u.isNotNull())
    guid = F.filter(entry["guid"], lambda g: F.lower(F.coalesce(g["_isPermaLink"], F.lit("true"))) == "true")
    return F.coalesce(F.get(urls, F.lit(0)), F.when(F.get(guid, F.lit(0))["_VALUE"].rlike("^\\s*https?://"), _text(F.get(guid, F.lit(0))["_VALUE"])))


def parse_feeds(df: DataFrame, content: str, per_feed: int | None = None, domain: Column | None = None) -> DataFrame:
    """Adds position (from 0), title, url, author, publish_time, summary and body; a row for each entry with a link.

    ``content``: whole feeds, RSS 2.0, RSS 1.0 or Atom; what isn't one, or is null
    or broken before its first entry, gives no row. Entries keep the order of the
    feed, and ``per_feed`` takes the first of them before anything is filtered.
    ``domain``: only links whose host contains it (null or empty: all). The time is
    in UTC: published, then updated; a summary is '' where there is none, a
    description stands in for it; a title is 'Untitled'. Other columns stay, and
    must not have these names.
    """
    feed = F.from_xml(F.ltrim(content), FEED)
    entries = F.coalesce(feed["channel"]["item"], feed["item"], feed["entry"])
    if per_feed is not None:
        entries = F.slice(entries, 1, per_feed)
    rows = df.select("*", F.posexplode(entries).alias("position", "_e"))
    e = F.col("_e")
    person = F.get(F.filter(F.transform(e["author"], lambda a: F.coalesce(_text(a["name"]), _text(a["_VALUE"]))), lambda a: a.isNotNull()), F.lit(0))
    times = F.coalesce(*(feed_time(e[c]) for c in ("pubDate", "published", "dc:date", "updated")))
    full = F.filter(F.concat(F.coalesce(e["content:encoded"], F.array()), F.coalesce(e["content"], F.array())), lambda c: _text(c).isNotNull())
    out = rows.withColumns({
        "title": F.coalesce(_text(e["title"]), F.lit("Untitled")), "url": _link(e), "author": F.coalesce(person, _text(e["dc:creator"])), "publish_time": times,
        "summary": F.coalesce(_text(e["summary"]), _text(e["description"]), F.lit("")), "body": F.get(full, F.lit(0)),
    }).drop("_e").filter("url is not null")
    if domain is not None:
        out = out.filter((F.coalesce(domain, F.lit("")) == "") | F.contains(host(F.col("url")), F.lower(domain)))
    return out


def read_feed(spark: SparkSession, path: str, per_feed: int | None = None, domain: str | None = None) -> DataFrame:
    """Entries of feed files (one feed a file) in any store that Spark reads, as ``parse_feeds`` gives them, with the file."""
    raw = spark.read.format("binaryFile").load(path)
    named = F.upper(F.regexp_extract(F.substring("content", 1, 200).cast("string"), "^[^>]*encoding\\s*=\\s*[\"']([A-Za-z0-9_.:-]+)", 1))
    text = F.col("content").cast("string")
    for e in ENCODINGS:
        text = F.when(named == e, F.decode("content", e)).otherwise(text)
    # a mark of the byte order may stand before the feed
    docs = raw.select(F.col("path").alias("file"), F.regexp_replace(text, "^\\x{FEFF}", "").alias("_feed"))
    return parse_feeds(docs, "_feed", per_feed, F.lit(domain) if domain else None).drop("_feed")
