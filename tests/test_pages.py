"""Fields and content by selectors, feeds in made pages, and link expansion against a plain queue."""

import datetime as dt
import random
from collections import deque

import pyarrow as pa
from pyspark.sql import functions as F

from lodestream.functions import urls
from lodestream.operators import details, pages


def one(spark, html, **k):
    at = F.lit("2024-06-01 12:00:00").cast("timestamp_ntz")
    return details.page_details(spark.createDataFrame([(1, html)], "k long, html string"), "k", at, **k).first()


def test_fields_by_meta_then_selectors(spark):
    r = one(spark, '<body><p class="title">Low</p><h1> Head <b>line</b></h1><span class="post-author">Ann</span><span class="name">No</span><i class="pub-time">发布于 2024-03-05 10:20</i></body>')
    assert (r["title"], r["author"], r["published"], r["publish_time"]) == ("Head line", "Ann", "发布于 2024-03-05 10:20", dt.datetime(2024, 3, 5, 10, 20))
    r = one(spark, '<head><meta property="og:title" content="Meta"><meta itemprop="author" content=" Bo "><meta name="pubdate" content="2024-01-02"></head><h1>H</h1><div class="author">X</div><time datetime="2020-01-01">then</time>')
    assert (r["title"], r["author"], r["publish_time"]) == ("Meta", "Bo", dt.datetime(2024, 1, 2))
    r = one(spark, '<time datetime="2024-02-03T04:05:00">yesterday</time><div class="author"></div><div class="article-author">C</div>')
    assert (r["published"], r["author"]) == ("2024-02-03T04:05:00", "C")
    assert one(spark, '<p class="date">3小时前</p>')["publish_time"] == dt.datetime(2024, 6, 1, 9)
    assert one(spark, '<p class="who">D</p>', authors=[".who"])["author"] == "D"
    for nothing in (None, "", "<p>", "<<>"):
        r = one(spark, nothing)
        assert (r["title"], r["author"], r["publish_time"]) == ("", "", None)


def test_longest_node_without_rejected_words(spark):
    page = '<body>out<article>short</article><div class="content">much longer text here<aside>junk</aside><div class="share">more junk</div><script>x()</script></div><main>the longest text of all, but please subscribe now to read on</main></body>'
    assert one(spark, page)["content"] == "the longest text of all, but please subscribe now to read on"
    assert one(spark, page, rejected=["SUBSCRIBE"])["content"] == "much longer text here"
    assert one(spark, page, rejected=["t"])["content"] == ""
    assert one(spark, "<body>a<p>b<p>c<nav>n</nav></body>")["content"] == "a\nb\nc"
    assert one(spark, '<div id="content">by id<li>x<li>y</div><div role="main">r</div>')["content"] == "by id\nx\ny"


def test_feeds_of_made_pages(spark):
    rows = [
        (1, '<html><head><link rel="alternate" type="application/rss+xml" href="/feed"><link rel="alternate" type="text/html" href="/m"><link rel="stylesheet" type="text/xml" href="/s"></head></html>', "https://a.example.org/x/"),
        (2, 'noise <?xml version="1.0"?><rss></rss>', "https://b.example.org/"), (3, "<html></html>", "https://c.example.org/"), (4, None, None),
        (5, '<LINK REL="Alternate feed" TYPE="application/atom+xml" HREF="atom.xml">', "https://d.example.org/y/z"),
    ]
    got = {tuple(r) for r in pages.feed_links(spark.createDataFrame(rows, "k long, html string, url string"), "k").collect()}
    assert got == {(1, "link", "https://a.example.org/feed"), (2, "embedded", '<?xml version="1.0"?><rss></rss>'), (5, "link", "https://d.example.org/y/atom.xml")}


def test_expansion_equals_a_plain_queue(spark):
    rng = random.Random(3)
    home = "https://s.example.org"
    listings = [f"{home}/news/page{c}" for c in "abcdefgh"] + [f"{home}/blog/list{c}" for c in "abc"]
    arts = [f"{home}/2024/05/{i:02d}/a-long-story-about-{i}" for i in range(1, 28)] + ["https://else.example.com/2024/05/01/a-long-story", f"{home}/private/2024/05/02/a-long-story-x"]
    known = {r["u"]: (r["a"], r["l"]) for r in spark.createDataFrame([(u,) for u in [*listings, *arts, home + "/"]], "u string").select("u", urls.looks_like_article("u").alias("a"), urls.looks_like_listing(F.col("u"), F.lit("s.example.org")).alias("l")).collect()}
    assert sum(a for a, _ in known.values()) > 20 and sum(b for _, b in known.values()) > 5
    rows = [(p, i, rng.choice([*listings, *arts, *arts]), rng.choice(["A fitting title", "short", "Another title"])) for p in [home + "/", *listings] for i in range(rng.randint(0, 12))]
    rules = spark.createDataFrame([(home + "/", 1, False, "/private")], "origin string, rule_no int, allow boolean, path_prefix string")
    for depth, max_pages, max_urls in ((2, 20, 100), (2, 4, 100), (1, 20, 6), (0, 5, 5), (2, 3, 3)):
        queue, visited, out = deque([(home + "/", 0)]), [], {}
        while queue and len(visited) < max_pages and len(out) < max_urls:
            page, d = queue.popleft()
            if page in visited:
                continue
            visited.append(page)
            for _, _, u, t in sorted(r for r in rows if r[0] == page):
                if not u.startswith(home) or u.startswith(home + "/private"):
                    continue
                if known[u][0] and len(t) >= 6:
                    if u not in out:
                        out[u] = t
                        if len(out) >= max_urls:
                            break
                elif d < depth and known[u][1]:
                    queue.append((u, d + 1))
        got = pages.expand_site(spark.createDataFrame([("s", home + "/", "s.example.org")], "source string, url string, domain string"), spark.createDataFrame(rows, "page string, position int, url string, title string"), depth, max_pages, max_urls, rules)
        assert [(r["url"], r["title"]) for r in got.orderBy("rank").collect()] == list(out.items()), (depth, max_pages, max_urls)


def test_pages_by_their_url_and_in_runs(spark, monkeypatch):
    rows = [(i, f"https://s.example.org/{i}/", f"<title>T{i}</title><p>{'x' * (i % 7) * 50}</p><a href='a'>first link</a><a href='/b'>second</a>") for i in range(40)] + [(40, "https://s.example.org/n/", None), (41, None, "<p>t")]
    df = spark.createDataFrame(rows, "k long, url string, html string").coalesce(1)
    by_url = {r["url"]: [x["url"] for x in r["links"]] for r in pages.parse_pages(df.filter("url is not null"), "url").collect()}
    assert len(by_url) == 41 and by_url["https://s.example.org/3/"] == ["https://s.example.org/3/a", "https://s.example.org/b"]
    assert pages.parse_pages(df, "url", fields=["links"]).columns == ["url", "links"]
    whole = sorted(map(tuple, pages.parse_pages(df, "k").collect()))
    monkeypatch.setattr(pages, "RUN", 300)
    batch = pa.RecordBatch.from_pydict({"k": [r[0] for r in rows], "html": [r[2] for r in rows]})
    parts = list(pages._runs(batch, 1))
    assert sum(p.num_rows for p in parts) == 42 and len(parts) > 10 and max(p.num_rows for p in parts) < 10
    assert sorted(map(tuple, pages.parse_pages(df, "k").collect())) == whole and len(whole) == 42
    assert {r["k"]: r["text"] for r in pages.parse_pages(df, "k", fields=["text"]).collect()} == {r[0]: r[1] for r in whole}


def test_site_expansion_query(spark):
    from lodestream.plans import documents

    got = documents.h5b(spark, "/root/testdata/sf0.01").collect()
    assert len({(r["source"], r["url"]) for r in got}) == len(got) and all(r["rank"] <= 100 for r in got)
