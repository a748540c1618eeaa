"""Feeds as sites write them, not as the library would."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestream.functions.times import feed_time
from lodestream.sources.feeds import parse_feeds, read_feed

RSS = """<?xml version="1.0" encoding="UTF-8"?>
<?xml-stylesheet type="text/xsl" href="/feed.xsl"?>
<!-- generated -->
<rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:atom="http://www.w3.org/2005/Atom">
 <channel><title>News &amp; more</title><link>https://news.example.org/</link><atom:link href="https://news.example.org/rss" rel="self"/>
  <item><title>Zebra &amp; yak</title><link>
    https://news.example.org/z?a=1&amp;b=2 </link><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate>
    <description><![CDATA[<p>Short</p>]]></description><content:encoded><![CDATA[<p>Long <b>one</b></p>]]></content:encoded><dc:creator>Ann Lee</dc:creator><guid isPermaLink="false">17</guid></item>
  <item><title>No address</title><guid isPermaLink="false">https://news.example.org/not-this</guid></item>
  <item><title>Apple</title><guid>https://news.example.org/a</guid><pubDate>Wed, 3 Jan 24 01:30 -0500</pubDate><author>desk@example.org (Desk)</author></item>
  <item><link>https://other.example.com/b</link><dc:date>2024-01-04</dc:date></item>
 </channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>T</title><link href="https://blog.example.net/atom" rel="self"/>
 <entry><title type="html">One &lt;em&gt;two&lt;/em&gt;</title><link rel="enclosure" href="https://blog.example.net/x.mp3"/><link rel="alternate" type="text/html" href="https://blog.example.net/1"/>
  <published>2024-01-02T10:00:00+02:00</published><updated>2024-02-02T10:00:00Z</updated><summary>Sum</summary>
  <content type="xhtml"><div xmlns="http://www.w3.org/1999/xhtml"><p>Body</p></div></content><author><name>Bo</name><email>bo@x</email></author><author><name>Cy</name></author></entry>
 <entry><title>Later</title><link href="https://blog.example.net/2"/><updated>2024-01-03T10:00:00.250Z</updated></entry>
</feed>"""
RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/">
 <channel rdf:about="x"><title>Old</title></channel><item rdf:about="y"><title>R</title><link>https://old.example.org/r</link><dc:date>2024-05-05T01:02:03+00:00</dc:date></item></rdf:RDF>"""


def at(*parts):
    return dt.datetime(*parts)


def test_feeds_of_all_kinds(spark, tmp_path):
    for name, text in (("rss", RSS), ("atom", ATOM), ("rdf", RDF), ("broken", "<rss><channel>"), ("page", "<html><body>no feed</body></html>"), ("nothing", "")):
        (tmp_path / f"{name}.xml").write_text(text, "utf-8")
    (tmp_path / "latin.xml").write_bytes('<?xml version="1.0" encoding="iso-8859-1"?><rss><channel><item><title>Käse</title><link>https://l.example.org/</link></item></channel></rss>'.encode("latin-1"))
    got = {(r["file"].rsplit("/", 1)[1], r["position"]): r for r in read_feed(spark, str(tmp_path)).collect()}
    pick = lambda f, i: tuple(got[f, i][c] for c in ("title", "url", "author", "publish_time", "summary", "body"))
    assert set(got) == {("rss.xml", 0), ("rss.xml", 2), ("rss.xml", 3), ("atom.xml", 0), ("atom.xml", 1), ("rdf.xml", 0), ("latin.xml", 0)}
    assert pick("rss.xml", 0) == ("Zebra & yak", "https://news.example.org/z?a=1&b=2", "Ann Lee", at(2024, 1, 2, 10), "<p>Short</p>", "<p>Long <b>one</b></p>")
    assert pick("rss.xml", 2) == ("Apple", "https://news.example.org/a", "desk@example.org (Desk)", at(2024, 1, 3, 6, 30), "", None)
    assert pick("rss.xml", 3) == ("Untitled", "https://other.example.com/b", None, at(2024, 1, 4), "", None)
    assert pick("atom.xml", 0)[:5] == ("One <em>two</em>", "https://blog.example.net/1", "Bo", at(2024, 1, 2, 8), "Sum") and "<p>Body</p>" in pick("atom.xml", 0)[5]
    assert pick("atom.xml", 1) == ("Later", "https://blog.example.net/2", None, at(2024, 1, 3, 10, 0, 0, 250000), "", None)
    assert pick("rdf.xml", 0)[:4] == ("R", "https://old.example.org/r", None, at(2024, 5, 5, 1, 2, 3))
    assert got["latin.xml", 0]["title"] == "Käse"


def test_first_entries_by_place_in_the_feed_then_filters(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS, "utf-8")
    urls = lambda **k: [r["url"].strip() for r in read_feed(spark, str(tmp_path), **k).orderBy("position").collect()]
    assert urls(per_feed=1) == ["https://news.example.org/z?a=1&b=2"]
    assert urls(per_feed=2) == ["https://news.example.org/z?a=1&b=2"]  # the second has no link and counts
    assert urls(per_feed=4, domain="news.example.org") == ["https://news.example.org/z?a=1&b=2", "https://news.example.org/a"]
    assert urls(domain="other.example") == ["https://other.example.com/b"]


def test_feeds_in_a_table(spark):
    rows = [(1, RSS, "news"), (2, ATOM, ""), (3, None, None), (4, "{}", None), (5, "\n" + RDF, "elsewhere")]
    got = parse_feeds(spark.createDataFrame(rows, "id long, xml string, site string"), "xml", domain=F.col("site"))
    assert sorted((r["id"], r["position"]) for r in got.collect()) == [(1, 0), (1, 2), (2, 0), (2, 1)]
    assert parse_feeds(spark.createDataFrame([], "id long, xml string"), "xml").collect() == []


@pytest.mark.parametrize("text,want", [
    ("Tue, 02 Jan 2024 10:00:00 GMT", at(2024, 1, 2, 10)), ("2 January 2024 10:00 EST", at(2024, 1, 2, 15)), ("Sat, 30 Dec 95 23:59:59 +0130", at(1995, 12, 30, 22, 29, 59)),
    ("02-Feb-24 1:05:00", at(2024, 2, 2, 1, 5)), ("2024-01-02", at(2024, 1, 2)), ("2024-01-02T03:04:05-0800", at(2024, 1, 2, 11, 4, 5)), ("2024-01-02T03:04:05", at(2024, 1, 2, 3, 4, 5)),
    ("Tue, 32 Jan 2024 10:00:00 GMT", None), ("soon", None), ("", None), (None, None), ("Tue, 02 Foo 2024 10:00:00 GMT", None),
])
def test_feed_times(spark, text, want):
    zone = spark.conf.get("spark.sql.session.timeZone")
    for z in (zone, "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", z)
        assert spark.createDataFrame([(text,)], "t string").select(feed_time("t").alias("t")).first()["t"] == want
    spark.conf.set("spark.sql.session.timeZone", zone)


def test_sitemap_scan_of_many_addresses(spark, tmp_path):
    from lodestream.plans import jobs

    spark.range(150_000).selectExpr("id AS o_orderkey", "TIMESTAMP_NTZ '2024-01-02 03:04:05' AS o_orderdate").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    assert jobs.s2(spark, str(tmp_path)).count() == 150_000
