"""Known answers on small tables."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.functions import scores, text, urls
from lodestream.operators import answers, dedup, filters, pages, ranking, report, retrieval, star, topics
from lodestream.sources import files, store
from lodestream.sources.store import shared_path
from lodestream.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_timeliness_steps(spark):
    at = dt.datetime(2024, 7, 1, 12)
    rows = [(d, at - dt.timedelta(days=d), at) for d in (0, 2, 3, 7, 14, 21, 30, 60, 90, 180, 181)] + [(-1, None, at)]
    got = {r["d"]: r["t"] for r in spark.createDataFrame(rows, "d int, p timestamp_ntz, c timestamp_ntz").select("d", scores.timeliness("p", "c").alias("t")).collect()}
    assert got == {0: 10, 2: 9, 3: 8, 7: 7, 14: 6, 21: 5, 30: 4, 60: 3, 90: 2, 180: 1, 181: 0, -1: 0}


def test_anchors_and_rank(spark):
    assert [one(spark, scores.anchored(F.lit(v))) for v in (7.0, 5.0, 2.0, 9.0, 0.0)] == [7, 3, 2, 9, 0]
    f = lambda *v: one(spark, scores.rank_score(*(F.lit(float(x)) for x in v)))
    assert f(9, 10, 8, 2, 10) == 8.45 and f(1, 10, 8, 2, 10) == 5.65


def test_domain_cap_order(spark):
    cap = lambda t: one(spark, scores.domain_cap(F.lit(t)))
    assert (cap("gpu for computer vision")["domain"], cap("a keyboard")["most"], cap("a gpu")["most"]) == ("computer_vision", 1.0, 2.0)
    assert cap("plain") is None


def test_han_pairs_and_language(spark):
    assert set(one(spark, text.term_set(F.lit("大模型 GPT4 发布 a")))) == {"大模型", "gpt4", "发布", "大模", "模型", "型发"}
    assert [one(spark, text.language(F.lit(t))) for t in ("大模型", "plain", "大 plain words", "12", None)] == ["zh", "en", "mixed", "unknown", "unknown"]


def test_lists_and_bytes(spark):
    assert one(spark, text.as_list(F.lit("a， b;；c"))) == ["a", "b", "c"]
    assert one(spark, text.as_list(F.lit('["x", " y ", ""]'))) == ["x", "y"]
    for n in range(4, 30):
        cut = one(spark, text.cut_bytes(F.lit("日本語のテキスト" * 3), n))
        assert len(cut.encode()) <= n and cut.endswith("...")
    assert one(spark, text.cut_bytes(F.lit("short"), 60)) == "short"


def test_urls(spark):
    assert one(spark, urls.strip_tracking(F.lit("https://a.com/x?utm_source=1&A=b%20c&d#f"))) == "https://a.com/x?A=b+c&d="
    art = lambda u: one(spark, urls.looks_like_article(F.lit(u)))
    assert art("https://a.com/2024/05/some") and art("https://a.com/p-123456") and art("https://a.com/x.html") and art("https://a.com/very-long-name")
    assert not (art("https://a.com/") or art("https://a.com/tag/long-enough-name") or art("https://a.com/a.png") or art("https://a.com/news"))
    assert one(spark, urls.same_domain(F.lit("https://x.A.com:80/p"), F.lit("a.com"))) and not one(spark, urls.same_domain(F.lit("https://ba.com/p"), F.lit("a.com")))
    assert one(spark, urls.title_from_url(F.lit("https://a.com/x/my-first_post.html"))) == "my first post"


def test_date_filters(spark):
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 2)), (2, dt.datetime(2025, 1, 2)), (3, None)], "i int, t timestamp_ntz")
    ends = (F.lit("2024-01-01").cast("timestamp_ntz"), F.lit("2024-12-31").cast("timestamp_ntz"))
    assert [r["i"] for r in filters.date_filter(rows, "t", *ends).orderBy("i").collect()] == [1, 3]
    assert [r["i"] for r in filters.date_filter(rows, "t", *ends, undated="drop").collect()] == [1]
    assert tuple(filters.date_filter_stats(rows, "t", *ends).first()) == (1, 1, 1)


def test_pool_of_sixty(spark):
    rows = spark.range(60).select("id", F.lit("s").alias("s"))
    out = ranking.candidate_pool(rows, "s", [F.col("id")], 100, 50).groupBy("pool").count().collect()
    assert {r["pool"]: r["count"] for r in out} == {"selected": 50, "deferred": 10}


def capped(rows, caps, target):
    used, out, n = {}, {}, 0
    for key, *values in rows:
        hit = next((c for c, v in zip(caps, values, strict=True) if caps[c] and used.get((c, v), 0) >= caps[c]), None)
        out[key] = f"{hit}_cap" if hit else "capacity" if n >= target else "selected"
        if out[key] == "selected":
            n += 1
            for c, v in zip(caps, values, strict=True):
                used[c, v] = used.get((c, v), 0) + 1
    return out


def test_many_caps(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("abc"), rng.choice("xyz")) for i in range(60)]
    caps = {"p": 4, "q": 5}
    df = spark.createDataFrame(rows, "k long, p string, q string").withColumn("g", F.lit(1))
    got = {r["k"]: r["outcome"] for r in ranking.select_capped(df, "g", [F.col("k")], caps, 9, "k").collect()}
    assert got == capped(rows, caps, 9)


def greedy(rows, threshold, most):
    made, out = [], {}
    for key, by, terms in rows:
        t = next((m for m in made if m[0] == by and (not most or len(m[2]) < most) and terms and m[1] and len(m[1] & terms) / len(m[1] | terms) >= threshold), None)
        if t is None:
            t = [by, set(), []]
            made.append(t)
        t[1] |= terms
        t[2].append(key)
        out[key] = t[2][0]
    return out


def test_clusters_match_the_plain_pass(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("uv"), {rng.choice("abcdefghijklmnop") * 2 for _ in range(rng.randint(0, 4))}) for i in range(150)]
    df = spark.createDataFrame([(k, b, sorted(t)) for k, b, t in rows], "k long, b string, t array<string>")
    for most in (0, 3):
        trace = []
        got = topics.greedy_topics(df, "k", "t", [F.col("k")], by="b", max_members=most, trace=trace).collect()
        assert {r["k"]: r["topic_id"] for r in got} == greedy(rows, 0.34, most) and all((r["k"] == r["topic_id"]) == (r["role"] == "lead") for r in got)
        assert trace[-1] == 0 and len(trace) < 20


def test_greedy_topics_of_hot_rows(spark):
    """One set held by most rows: one topic, or so many of three, without meeting each other."""
    df = spark.range(3_001).select(F.col("id").alias("k"), F.when(F.col("id") % 50 == 7, F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.concat(F.lit("w"), F.col("id").cast("string")))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("t"))
    whole = topics.greedy_topics(df.filter("id % 50 <> 7"), "k", "t", [F.col("k")]).groupBy("topic_id", "role").count().orderBy("count").collect()
    assert whole == [(0, "lead", 1), (0, "member", 2_940)]
    many = topics.greedy_topics(df.filter("id % 50 <> 7"), "k", "t", [F.col("k")], max_members=3).groupBy("topic_id").count().groupBy("count").agg(F.count("*")).orderBy(F.desc("count")).collect()
    assert many == [(3, 980), (1, 1)]
    for most, size in ((0, 400), (3, 20)):
        rows = [(r["k"], "", set(r["t"])) for r in df.filter(f"k < {size}").collect()]
        got = topics.greedy_topics(df.filter(f"k < {size}"), "k", "t", [F.col("k")], max_members=most).collect()
        assert {r["k"]: r["topic_id"] for r in got} == greedy(rows, 0.34, most)


def test_greedy_topics_in_rounds_that_no_chain_adds_to(spark):
    """Rounds follow from the number of rows of a ``by`` alone, also where full topics hand rows on; topics of earlier rounds take rows of later ones."""
    rng = random.Random(5)
    rows = [(i, "u" if i % 4 else "v", {"a", "b", "c"} if i % 3 else {rng.choice("abcdefghijk") for _ in range(rng.randint(0, 6))}) for i in range(160)]
    df = spark.createDataFrame([(k, b, sorted(t)) for k, b, t in rows], "k long, b string, t array<string>")
    for most in (0, 3):
        trace = []
        got = topics.greedy_topics(df, "k", "t", [F.col("k")], by="b", max_members=most, trace=trace, step=40).collect()
        assert {r["k"]: r["topic_id"] for r in got} == greedy(rows, 0.34, most)
        assert trace == [2, 1, 0]  # 120 rows of u


def test_greedy_topics_of_many_rows_in_one_round(spark):
    """20,000 rows of one group are one round, and each topic is found by what it shares besides the word that all rows have."""
    df = spark.range(20_000).select(F.col("id").alias("k"), F.expr("array('the', concat('a', id div 5), concat('b', id div 5), concat('c', id))").alias("t"))
    trace = []
    got = {r["k"]: r["topic_id"] for r in topics.greedy_topics(df, "k", "t", [F.col("k")], trace=trace).collect()}
    want = greedy([(k, "", {"the", "a", "b", f"c{k}"}) for k in range(5)], 0.34, 0)  # those of other fives share one word of seven or more
    assert trace == [0] and got == {k: k - k % 5 + want[k % 5] for k in range(20_000)}


def test_topics_near_a_set(spark):
    """Lists that are left out as the longest ones lose no topic: the same as all pairs give, also for sets that grew."""
    rng = np.random.default_rng(3)
    pick = lambda: np.unique(np.minimum(rng.zipf(1.3, rng.integers(1, 14)), 60))
    for threshold in (0.2, 0.34, 0.5, 1.0):
        sets = [pick() for _ in range(300)]
        held = topics._Held(sets, 100, threshold)
        for i in range(100):
            held.add(int(rng.integers(0, 300)) if i % 2 else len(held.sets), pick())
        for _ in range(200):
            terms = pick()
            own = set(terms.tolist())
            want = [i for i, s in enumerate(held.sets) if len(own & s) / len(own | s) >= threshold]
            assert list(held.near(terms)) == want
            known = rng.random(len(held.size)) < 0.5
            assert list(held.near(terms, known)) == [i for i in want if not known[i]]


def test_greedy_topics_by_titles_too(spark):
    """The larger of two similarities counts; both sets grow."""
    rng = random.Random(8)
    pick = lambda letters, most: sorted({rng.choice(letters) for _ in range(rng.randint(0, most))})
    rows = [(i, rng.randint(0, 9), pick("abcdefghijklmnopqrs", 7), pick("stuvwxyz", 4)) for i in range(130)]
    df = spark.createDataFrame(rows, "k long, s long, t array<string>, u array<string>")
    close = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    made, want = [], {}
    for k, _, t, u in sorted(rows, key=lambda r: (-r[1], r[0])):
        t, u = set(t), set(u)
        topic = next((m for m in made if max(close(m[1], t), close(m[2], u)) >= 0.34), None)
        if topic is None:
            topic = [k, set(), set()]
            made.append(topic)
        topic[1] |= t
        topic[2] |= u
        want[k] = topic[0]
    got = topics.greedy_topics(df, "k", "t", [-F.col("s")], titles="u").collect()
    assert {r["k"]: r["topic_id"] for r in got} == want
    assert topics.greedy_topics(df.limit(0), "k", "t", [-F.col("s")], titles="u").count() == 0


def test_chain_isnt_transitive(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["c", "d", "e", "f", "g", "h"]), (3, ["b", "c", "d"])], "k long, t array<string>")
    got = {r["k"]: r["topic_id"] for r in topics.greedy_topics(df, "k", "t", [F.col("k")]).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_failed_row_frees_its_fingerprint(spark):
    history = spark.createDataFrame([], "content_hash string")
    run = spark.createDataFrame([("a", True), ("b", False)], "content_hash string, ok boolean")
    assert [r["content_hash"] for r in dedup.commit_history(history, run.filter("ok")).collect()] == ["a"]


def test_pages(spark):
    html = "<html><head><title>T</title><meta name=author content=Ann><link rel=alternate type='application/rss+xml' href='/f.xml'></head><body><nav>menu</nav><article><h1>Head</h1><p>Body <b>text<p>more</article><a href='/2024/05/post'>go <img alt=pic></a><a href='/tag/x/'>no</a><script>var x=1</script></body>"
    p = pages.parse_pages(spark.createDataFrame([(1, html, "https://a.com/x"), (2, None, None), (3, "<p>&lt;unclosed", "https://[bad")], "page_id long, html string, url string"), "page_id")
    r = {x["page_id"]: x for x in p.collect()}
    assert r[1]["title"] == "Head" and r[1]["author"] == "Ann" and r[1]["main"].split("\n") == ["Head", "Body", "text", "more"] and "menu" not in r[1]["text"] and r[1]["feeds"] == ["https://a.com/f.xml"]
    assert r[2]["text"] == "" and r[3]["text"] == "<unclosed"
    assert [(x["url"], x["title"]) for x in pages.extract_links(p, "page_id").collect()] == [("https://a.com/2024/05/post", "go pic")]


def test_repair():
    assert answers.repair('{"a": [1, {"b": "x') == '{"a": [1, {"b": "x"}]}'
    assert answers.repair('```json\n{"a": 1}\n``` and more') == '{"a": 1}'
    assert answers.repair("none") is None and answers.repair(None) is None


def test_repair_of_concatenated_values():
    assert answers.repair('{"a": 1}{"b": 2}\n{"c": 3}') == '[{"a": 1}, {"b": 2}, {"c": 3}]'
    assert answers.repair('see: {"a": 1}, {"b": [2') == '[{"a": 1}, {"b": [2]}]'
    assert answers.repair('{"a": 1} as in [1]') == '{"a": 1}'


def chunks(t, size):
    parts = [s for p in t.split("\n\n") if p.strip() for s in [p.strip()[i : i + size] for i in range(0, len(p.strip()), size)]]
    out = []
    for p in parts:
        if out and len(out[-1]) + 2 + len(p) <= size:
            out[-1] += "\n\n" + p
        else:
            out.append(p)
    return out


def test_chunks(spark):
    rng = random.Random(3)
    rows = [(i, "\n\n".join("w" * rng.randint(0, 70) for _ in range(rng.randint(0, 8)))) for i in range(60)] + [(99, None)]
    got = {}
    for r in retrieval.chunk(spark.createDataFrame(rows, "k long, t string"), "k", "t", 50).orderBy("k", "chunk_no").collect():
        got.setdefault(r["k"], []).append(r["chunk"])
    assert got == {k: c for k, t in rows if (c := chunks(t or "", 50))}


def test_sitemaps_refuse_entities(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<urlset><url><loc> https://a.com/1 </loc><lastmod>2024-01-01</lastmod></url></urlset>")
    (tmp_path / "b.xml").write_text('<!DOCTYPE x [<!ENTITY e "v">]><urlset><url><loc>https://a.com/2</loc></url></urlset>')
    (tmp_path / "c.xml").write_text("<sitemapindex><sitemap><loc>https://a.com/s.xml</loc></sitemap></sitemapindex>")
    assert sorted((r["kind"], r["loc"]) for r in files.read_sitemap(spark, str(tmp_path)).collect()) == [("index", "https://a.com/s.xml"), ("page", "https://a.com/1")]


def test_report_checks(spark):
    df = spark.createDataFrame([("## A [[1]] u1", "## A", ["1"], ["u1"]), ("B [[2]] [[2]]", "## B", ["2"], ["u2"])], "t string, h string, i array<string>, l array<string>")
    assert [r["errors"] for r in report.check_sections(df, "t", F.col("h"), F.col("i"), F.col("l")).collect()] == [[], ["heading_missing", "marks_differ", "link_missing"]]


def test_streams_equal_batches(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(i, i % 7, t0 + dt.timedelta(hours=i)) for i in range(100)], "i long, k long, t timestamp_ntz")
    path = str(tmp_path / "in.parquet")
    rows.repartition(3).write.parquet(path)
    got = jobs.drain(jobs.dedup_stream(jobs.stream_table(spark, path, 10), "k", "t", "30 days"), "d")
    assert sorted(r["k"] for r in got.collect()) == list(range(7))
    # the last day stays open behind the watermark
    n = jobs.drain(jobs.window_counts(jobs.stream_table(spark, path, 10), "t", "1 day", "1 hour", "k"), "w")
    batch = rows.groupBy(F.window(F.col("t").cast("timestamp"), "1 day").alias("w"), "k").count().filter("w.end <= TIMESTAMP '2024-01-05 02:00:00'")
    assert sorted(map(tuple, n.select("start", "k", "n").collect())) == sorted(map(tuple, batch.select("w.start", "k", "count").collect()))
    assert shared_path(spark, "x") != shared_path(spark, "x")


def test_free_times(spark):
    from lodestream.functions.times import free_time

    at = dt.datetime(2024, 3, 10, 12)
    said = {"3 分钟前": at - dt.timedelta(minutes=3), "2周前": at - dt.timedelta(weeks=2), "前天": at - dt.timedelta(days=2), "2024-1-5 7:30 发布": dt.datetime(2024, 1, 5, 7, 30), "2024年1月5日": dt.datetime(2024, 1, 5), "2024/13/5": None, "none": None}
    df = spark.createDataFrame([(s, at) for s in said], "s string, at timestamp_ntz")
    assert {r["s"]: r["t"] for r in df.select("s", free_time("s", "at").alias("t")).collect()} == said


def test_absolute_links(spark):
    from urllib.parse import urljoin

    base = "https://a.com/x/y?q=1"
    links = ["z", "/z", "../z", "./z/../w", "?p=2", "//b.com/c", "https://b.com/d#e", "mailto:x", "", "z/w.html", "#f"]
    got = {r["u"]: r["v"] for r in spark.createDataFrame([(u, base) for u in links], "u string, b string").select("u", pages.absolute("u", "b").alias("v")).collect()}
    assert got == {u: urljoin(base, u).split("#")[0] for u in links}


def test_numbers_at_size(spark):
    n = 200_000
    rows = spark.range(n).select("id", F.pmod(F.xxhash64("id"), F.lit(997)).alias("k"), *(F.concat(F.lit(f"c{i}-"), F.col("id").cast("string")).alias(f"c{i}") for i in range(6)))
    got = star.numbered(rows, [F.col("k").desc(), F.col("id")]).select("n", "k", "id").toPandas()
    want = sorted(zip((-got["k"]).tolist(), got["id"].tolist(), strict=True))
    got = got.sort_values("n")
    assert got["n"].tolist() == list(range(1, n + 1)) and list(zip((-got["k"]).tolist(), got["id"].tolist(), strict=True)) == want
    within = star.numbered_within(rows.select("id", (F.col("id") % 3).alias("g")), "g", [F.col("id").desc()]).filter("g = 1").agg(F.min("n"), F.max("n"), F.countDistinct("n")).first()
    assert tuple(within) == (1, 66_667, 66_667)
    assert star.numbered(rows.limit(0), [F.col("id")]).count() == 0


def test_connected_topics(spark):
    rows = [(1, 9.0, ["a", "b", "c"], "x"), (2, 8.0, ["b", "c", "d"], "x"), (3, 7.0, ["c", "d", "e"], "x"), (4, 6.0, ["a", "b", "c"], "y"), (5, 5.0, ["a", "b", "c"], "x"), (6, 4.0, [], "x"), (7, 3.0, None, None), (8, 2.0, ["d", "c", "b"], "x")]
    df = spark.createDataFrame(rows, "k long, s double, t array<string>, g string")
    order = [-F.col("s")]
    got = lambda **kw: {r["k"]: r["topic_id"] for r in topics.connected_topics(df, "k", "t", order, by="g", threshold=0.5, **kw).collect()}
    assert got() == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1, 6: 6, 7: 7, 8: 1}
    assert got(max_members=2) == {1: 1, 2: 1, 3: 3, 5: 3, 8: 8, 4: 4, 6: 6, 7: 7}
    # in the pass, row 3 meets the grown set of topic 1
    passed = {r["k"]: r["topic_id"] for r in topics.greedy_topics(df, "k", "t", order, by="g", threshold=0.5).collect()}
    assert passed == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1, 6: 6, 7: 7, 8: 1} or passed[3] == 1
    assert topics.connected_topics(df.limit(0), "k", "t", order).count() == 0
    many = spark.createDataFrame([(i, float(i), ["same", "words", f"w{i}"], "x") for i in range(1200)], "k long, s double, t array<string>, g string")
    assert {r["topic_id"] for r in topics.connected_topics(many, "k", "t", order, threshold=0.4).collect()} == {1199}


def test_snapshot_by_time(spark, tmp_path):
    df = spark.createDataFrame([("h", 1)], "url_hash string, seq long")
    for number, at, seq in (("COL-9", "2024-01-01", 9), ("COL-10", "2024-01-02", 10), ("VAL-1.2", "2024-01-03", 12)):
        files.write_snapshot(df.withColumn("seq", F.lit(seq)), f"{tmp_path}/s", number, "seq", at)
    assert files.read_snapshot(spark, f"{tmp_path}/s").first()["seq"] == 10
    assert files.read_snapshot(spark, f"{tmp_path}/s", "VAL-1.2.json").first()["seq"] == 12


def test_main_content(spark):
    html = [
        "<body>x<div class='big post-content'>in <aside>no</aside><div class='ad'>no</div><form>no</form><p>side</div>out</body>",
        "<div id=content>last</div><main>second<nav>no</nav></main>", "<div role=main>r</div><article>first</article><article>later</article>", "<p>all</p>", "<div class='article-content'>a</div>", None,
    ]
    df = spark.createDataFrame(list(enumerate(html)), "k long, html string").withColumn("url", F.lit("https://a.b/"))
    assert [r["main"] for r in pages.parse_pages(df, "k").orderBy("k").collect()] == ["in\nside", "second", "first", "all", "a", ""]


def test_feeds_and_titles(spark):
    html = ["<p>x</p><?XML version='1.0'?><rss>y</rss>", "<link rel=alternate type='application/xml' href='/f'><link rel=alternate type='application/rss+xml' href='/f'>", "<link rel=alternate href='/no'>", None]
    df = spark.createDataFrame(list(enumerate(html)), "k long, html string").withColumn("url", F.lit("https://a.b/c/"))
    assert sorted(tuple(r) for r in pages.feed_links(df, "k").collect()) == [(0, "embedded", "<?XML version='1.0'?><rss>y</rss>"), (1, "link", "https://a.b/f")]
    links = "<a href='/x/long-one'>A long title</a><a href='/x/y2'>short</a><a href='/x/z3'>首页</a><a href='/x/w4'><img alt='an image title'></a>"
    got = pages.extract_links(pages.parse_pages(spark.createDataFrame([(1, links, "https://a.b/")], "k long, html string, url string"), "k"), "k").collect()
    assert sorted(r["url"] for r in got) == ["https://a.b/x/long-one", "https://a.b/x/w4"]


def test_chunk_function_agrees(spark):
    texts = ["a\n\nb", "x" * 5000, "\n\n".join(["p" * 700] * 9), " \n\n ", "", None, "q" * 1999 + "\n\n" + "r"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    spark.udtf.register("text_chunks", retrieval.TextChunks)
    one = sorted(tuple(r) for r in retrieval.chunk(df, "k", "t").collect())
    assert one == sorted(tuple(r) for r in spark.sql("SELECT d.k, c.chunk_no, c.chunk FROM {d} d, LATERAL text_chunks(d.t) c", d=df).collect())


def test_import_is_idempotent(spark):
    from lodestream.plans import jobs as plans

    held, payload = plans._star(spark, "/root/testdata/sf0.001")
    once = star.import_batch(held, payload, "COL-7")
    failed = once["batches"].first()
    assert failed["status"] == "partial_success" and failed["failed_count"] > 0
    good = payload | {k: payload[k].join(once["articles"].select("url_hash"), "url_hash", "left_semi") for k in ("analyses", "insights")}
    done = star.import_batch(held, good, "COL-7")
    again = star.import_batch(done, good, "COL-7")
    assert done["batches"].first()["status"] == "success" and all(again[k] is done[k] for k in done)
    assert star.import_batch(once, good, "COL-7")["links"].count() == done["links"].count()


def test_shared_folder_must_be_named_on_a_cluster():
    class Session:
        class conf:
            @staticmethod
            def get(*_):
                return None

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        store.shared_root(Session)


def test_similar_classes_and_counts_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topics, "LIST", 7)
    rng = random.Random(11)
    rows = [(i, rng.sample([f"w{j}" for j in range(60)], rng.randint(1, 9))) for i in range(150)]
    rows += [(i, ["a", "b", *rng.sample([f"v{j}" for j in range(12)], 4)]) for i in range(150, 260)] + [(300, ["w1", "w2"]), (301, ["w2", "w1"]), (302, []), (303, None)]
    similar = lambda a, b: bool(a and b) and len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.34
    near = {k: [j for j, b in rows if j != k and similar(a, b)] for k, a in rows}
    least = {k: k for k, _ in rows}
    while (new := {k: min([least[k], *(least[j] for j in near[k])]) for k in least}) != least:
        least = new
    df = spark.createDataFrame(rows, "k long, t array<string>")
    got = topics.similar_rows(df, "k", "t").collect()
    assert {r["k"]: (r["n_links"], r["component_id"]) for r in got} == {k: (len(near[k]), least[k]) for k in near} and len(got) == len(rows)
    assert {(r["a"], r["b"]) for r in topics.similar_pairs(df, "k", "t").collect()} == {(a, b) for a in near for b in near[a] if a < b}
    assert {r["k"]: r["topic_id"] for r in topics.connected_topics(df, "k", "t", [F.col("k")]).collect()} == least
    assert topics.similar_rows(df.limit(0), "k", "t").count() == 0


def test_pairs_within_a_class_are_not_made(spark):
    """A row of similar sets is one class by what stands side by side: no pairs are left to look for."""
    many = spark.createDataFrame([(i, "", ["x", "y", "z", f"{i:04d}"]) for i in range(3000)], "id long, by string, set array<string>")
    listed = topics._listed(many, 0.34)
    one = topics.similar_classes(many)
    assert one.select("root").distinct().count() == 1 and one.count() == 3000
    assert topics._met(listed.join(one.withColumnRenamed("root", "class"), "id"), 0.34, ["class"], "class").count() == 0


def test_similar_pairs_lists_every_two_rows_and_their_similarity(spark, monkeypatch, tmp_path):
    from lodestream.plans import documents

    monkeypatch.setattr(topics, "LIST", 5)
    rng = random.Random(12)
    titles = [" ".join(rng.sample([f"word{j}" for j in range(14)], 4)) for _ in range(40)] + ["one two three"] * 23 + ["three two One", "one two four", "", None]
    spark.createDataFrame([(i, t, "src0", "en") for i, t in enumerate(titles)], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = {i: set(t.lower().split()) for i, t in enumerate(titles) if t}
    want = {(a, b, round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 9)) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.34}
    got = [tuple(r) for r in documents.c8(spark, str(tmp_path)).select("a", "b", "similarity").collect()]
    assert set(got) == want and len(got) == len(want) > 276
