"""Queries of sources and sinks (S), streaming jobs (T) and plan expansion (F)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream import config as C
from lodestream.functions import sql, text, urls
from lodestream.operators import report, star
from lodestream.plans.catalog import query
from lodestream.plans.fixtures import ANALYSES, ARTICLES, RANK_SQL, RUNS, analyses, articles, repeatable, table
from lodestream.plans.scalars import KEY, STRIP_TRACKING
from lodestream.sources import feeds as feeds_
from lodestream.sources import files
from lodestream.sources.store import shared_path, written
from lodestream.streaming import jobs

A = repeatable(ARTICLES)
N = repeatable(ANALYSES)


@query("S1_feed_scan", A + "SELECT source_code, position, CASE WHEN title = '' THEN 'Untitled' ELSE title END AS title, url, publish_time, coalesce(summary, '') AS summary FROM (SELECT *, (row_number() OVER (PARTITION BY source_code, lang, ingest_seq // 5000 ORDER BY ingest_seq) - 1)::INT AS position FROM articles) WHERE ingest_seq % 9 <> 5 AND position < 100")
def s1(spark: SparkSession, sf: str) -> DataFrame:
    """The articles as feeds of up to 5,000, RSS for one half of the sources and Atom for the other, scanned back: the first hundred of each.

    Texts go as hex, as XML has no place for some characters, and trims.
    """
    path = shared_path(spark, "feed")
    a = articles(spark, sf).withColumn("atom", F.crc32(F.col("source_code").cast("binary")) % 2 == 0)
    tag = lambda name, c: F.coalesce(F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>")), F.lit(""))
    as_hex = lambda c: F.concat(F.lit("x"), F.hex(F.encode(F.nullif(c, F.lit("")), "UTF-8")))
    link = F.when(F.col("ingest_seq") % 9 == 5, "").otherwise(F.replace("url", F.lit("&"), F.lit("&amp;")))
    at = "publish_time"
    rss = F.concat(F.lit("<item>"), tag("title", as_hex("title")), tag("link", link), tag("pubDate", F.concat(F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))), tag("description", as_hex("summary")), F.lit("</item>"))
    atom = F.concat(
        F.lit("<entry>"), tag("title", as_hex("title")), F.lit('<link rel="enclosure" href="https://cdn.example.com/x"/>'), F.concat(F.lit('<link href="'), link, F.lit('"/>')),
        tag("published", F.concat(F.date_format(F.timestamp_add("HOUR", F.lit(2), at), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))), tag("summary", as_hex("summary")), F.lit("</entry>"),
    )
    rows = a.select("source_code", "atom", F.concat_ws("-", "lang", F.floor(F.col("ingest_seq") / 5000)).alias("feed"), "ingest_seq", F.when(F.col("atom"), atom).otherwise(rss).alias("xml"))
    feeds = rows.groupBy("source_code", "atom", "feed").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ingest_seq", "xml"))), lambda x: x["xml"]), "").alias("entries"))
    around = lambda a, b: F.concat(F.lit(a), "entries", F.lit(b))
    whole = F.when(F.col("atom"), around('<feed xmlns="http://www.w3.org/2005/Atom">', "</feed>")).otherwise(around('<rss version="2.0"><channel><title>news</title>', "</channel></rss>"))
    feeds.select("source_code", "feed", whole.alias("value")).write.partitionBy("source_code", "feed").text(path)
    text_of = lambda c, none: F.when(F.col(c) == none, none).otherwise(F.decode(F.unhex(F.substring(c, 2, 2**31 - 1)), "UTF-8")).alias(c)
    got = feeds_.read_feed(spark, f"{path}/*/*", per_feed=100)
    return got.select(F.regexp_extract("file", "source_code=([^/]*)", 1).alias("source_code"), "position", text_of("title", "Untitled"), "url", "publish_time", text_of("summary", ""))


@query("S2_sitemap_scan", "SELECT 'page' AS kind, 'https://example.com/' || o_orderkey::VARCHAR AS loc, o_orderdate AS lastmod FROM orders")
def s2(spark: SparkSession, sf: str) -> DataFrame:
    """Files of 50,000 addresses at most, as the protocol says: larger ones than 10 MB are left out when read."""
    path = shared_path(spark, "sitemap")
    table(spark, sf, "orders").select(F.concat(F.lit("https://example.com/"), F.col("o_orderkey").cast("string")).alias("loc"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("lastmod")).write.format("xml").option("rootTag", "urlset").option("rowTag", "url").option("maxRecordsPerFile", 50_000).save(path)
    return files.read_sitemap(spark, path).select("kind", "loc", "lastmod")


@query("S3_search_answers", "SELECT page_id, u AS position, CASE WHEN u = 0 THEN url ELSE url || '/2' END AS url, CASE WHEN u = 0 THEN 'first' ELSE 'second' END AS title FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages), (SELECT unnest([0, 1])::INT AS u)")
def s3(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("url"))
    item = lambda u, t, a, b: F.to_json(F.struct(u.alias(a), F.lit(t).alias(b)))
    both = lambda a, b: F.concat(F.lit("["), item(F.col("url"), "first", a, b), F.lit(","), item(F.concat("url", F.lit("/2")), "second", a, b), F.lit("]"))
    payload = F.when(F.col("page_id") % 3 == 0, both("url", "title")).when(F.col("page_id") % 3 == 1, F.concat(F.lit('{"results":'), both("link", "title"), F.lit("}"))).otherwise(F.concat(F.lit('{"webPages":{"value":'), both("url", "name"), F.lit("}}")))
    return files.flatten_search(p.select("page_id", payload.alias("payload")), "payload").select("page_id", "position", "url", "title")


@query("S4_S5_snapshot", A + "SELECT sha256(url) AS url_hash, max(ingest_seq) AS ingest_seq FROM articles WHERE ingest_seq % 2 = 1 GROUP BY 1")
def s4(spark: SparkSession, sf: str) -> DataFrame:
    """Batches written, one of them twice; the collection made last is read back, though another's number is higher as text."""
    root = shared_path(spark, "snapshots")
    rows = articles(spark, sf).select("ingest_seq", text.digest("url").alias("url_hash"))
    files.write_snapshot(rows.filter("ingest_seq % 2 = 0"), root, "COL-9", "ingest_seq", "2024-01-01")
    files.write_snapshot(rows, root, "COL-10", "ingest_seq", "2024-01-02")
    files.write_snapshot(rows.filter("ingest_seq % 2 = 1"), root, "COL-10", "ingest_seq", "2024-01-03")
    files.write_snapshot(rows, root, "VAL-99", "ingest_seq", "2024-01-04")
    return files.read_snapshot(spark, root).select("url_hash", "ingest_seq")


@query("S6_snapshot_list", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500")
def s6(spark: SparkSession, sf: str) -> DataFrame:
    return files.list_snapshots(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 9999)


@query("S7_snapshot_merge", A + "SELECT url, ingest_seq, lang FROM articles QUALIFY row_number() OVER (PARTITION BY url ORDER BY ingest_seq DESC) = 1")
def s7(spark: SparkSession, sf: str) -> DataFrame:
    return files.merge_snapshots(articles(spark, sf).select("url", "ingest_seq", "lang"), "url", "ingest_seq")


@query("S8_source_catalogue", "SELECT s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN 'primary' WHEN 1 THEN 'supplement' ELSE 'discovery' END AS role FROM supplier WHERE s_acctbal > 0")
def s8(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("s_nationkey") % 3
    return files.source_catalog(table(spark, sf, "supplier"), F.col("s_acctbal") > 0, {"primary": kind == 0, "supplement": kind == 1}, "discovery").select("s_suppkey", "role")


def _star(spark: SparkSession, sf: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """A star with a third of the articles, and a delivery of half of them with their analyses and insights."""
    a = articles(spark, sf).select("ingest_seq", F.concat(F.lit("h"), F.col("ingest_seq").cast("string")).alias("url_hash"), F.xxhash64(F.concat(F.lit("h"), F.col("ingest_seq").cast("string"))).alias("article_id"), "source_code", "publish_time", "crawl_time", "title", "lang")
    known = a.filter("ingest_seq % 3 = 0").select("url_hash", "article_id", F.when(F.col("ingest_seq") % 2 == 0, F.lit("")).otherwise(F.col("source_code")).alias("author"), F.lit(None).cast("timestamp_ntz").alias("publish_time"), "crawl_time", "title")
    scored = analyses(spark, sf).select("article_id", F.concat(F.lit("h"), (F.col("article_id") + F.when(F.col("article_id") % 50 == 0, 10**9).otherwise(0)).cast("string")).alias("url_hash"), "trend", "deep")
    none = lambda ddl: spark.createDataFrame([], ddl)
    star = {
        "articles": known, "analyses": none("batch_no string, article_id long, trend double"), "insights": none("batch_no string, article_id long, text string"),
        "links": none("batch_no string, article_id long, analysed boolean, selected boolean"), "batches": none("batch_no string, status string, article_count long, success_count long, failed_count long"),
    }
    half = scored.filter("article_id % 2 = 0")
    return star, {
        "articles": a.filter("ingest_seq % 2 = 0").select("url_hash", F.col("source_code").alias("author"), "publish_time", "crawl_time", "title"),
        "analyses": half.select("url_hash", "trend"), "insights": half.filter("deep").select("url_hash", F.lit("told").alias("text")),
    }


STAR = A.rstrip() + """, n AS (SELECT doc_id, toxic = 1 AS deep, doc_id % 50 <> 0 AS known FROM labels WHERE doc_id % 2 = 0),
 b AS (SELECT (SELECT count(*) FROM articles WHERE ingest_seq % 2 = 0) AS article_count, count(*) FILTER (known) AS success_count, count(*) FILTER (NOT known) + count(*) FILTER (NOT known AND deep) AS failed_count FROM n) """


@query("S9_import_batch", STAR + "SELECT 'COL-7' AS batch_no, CASE WHEN failed_count = 0 THEN 'success' WHEN success_count > 0 THEN 'partial_success' ELSE 'failed' END AS status, article_count, success_count, failed_count FROM b")
def s9(spark: SparkSession, sf: str) -> DataFrame:
    """The batch's row after a delivery into the whole star, and again: what is there already changes nothing."""
    star_, payload = _star(spark, sf)
    once = {k: written(v, k) for k, v in star.import_batch(star_, payload, "COL-7").items()}
    return star.import_batch(once, payload, "COL-7")["batches"]


@query("S9_import_articles", STAR + """SELECT 'h' || ingest_seq AS url_hash, CASE WHEN ingest_seq % 6 = 3 THEN source_code ELSE source_code END AS author, CASE WHEN ingest_seq % 2 = 0 THEN publish_time END AS publish_time, title,
 CASE WHEN ingest_seq % 2 = 0 THEN n.doc_id IS NOT NULL AND known END AS analysed, CASE WHEN ingest_seq % 2 = 0 THEN coalesce(deep AND known, FALSE) END AS selected, CASE WHEN ingest_seq % 2 = 0 AND known THEN (ingest_seq * 3 % 11)::DOUBLE END AS trend
 FROM articles LEFT JOIN n ON ingest_seq = doc_id WHERE ingest_seq % 3 = 0 OR ingest_seq % 2 = 0""")
def s9b(spark: SparkSession, sf: str) -> DataFrame:
    """Articles of the star after the delivery, with their links and analyses."""
    star_, payload = _star(spark, sf)
    done = star.import_batch(star_, payload, "COL-7")
    links, scored = done["links"].drop("batch_no"), done["analyses"].drop("batch_no")
    return done["articles"].join(links.hint("merge"), "article_id", "left").join(scored.hint("merge"), "article_id", "left").select("url_hash", "author", "publish_time", "title", "analysed", "selected", "trend")


@query("S10_audit_rows", N + "SELECT article_id, CASE WHEN category = 'cat3' AND trend <= 5 THEN 'discarded' ELSE 'analyzed' END AS disposition, CASE WHEN category = 'cat3' AND trend <= 5 THEN 'low_value' END AS reason, deep AS l3 FROM analyses")
def s10(spark: SparkSession, sf: str) -> DataFrame:
    a = analyses(spark, sf)
    low = (F.col("category") == "cat3") & (F.col("trend") <= 5)
    return files.audit_rows(a.filter(~low), a.filter(low).withColumn("reason", F.lit("low_value")), a.filter("deep"), "article_id")


@query("S11_deferred_status", N + "SELECT article_id, CASE WHEN article_id % 3 = 0 THEN 'refill_selected' ELSE 'deferred' END AS status FROM analyses WHERE trend < 5")
def s11(spark: SparkSession, sf: str) -> DataFrame:
    a = analyses(spark, sf).filter("trend < 5").select("article_id")
    return files.deferred_status(a, a.filter("article_id % 3 = 0"), "article_id")


@query("S12_dead_letters", N + "SELECT article_id, batch_id AS batch_no, 'rejected' AS reason FROM analyses WHERE status = 'failed'")
def s12(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "dead-letters")
    files.quarantine(analyses(spark, sf).filter("status = 'failed'").select("article_id", F.col("batch_id").alias("batch_no")), "rejected", path)
    back = spark.read.schema("article_id long, reason string, batch_no long").option("basePath", path).parquet(path)
    return back.select("article_id", "batch_no", "reason")


@query("S13_cards", repeatable(ANALYSES, ARTICLES) + "SELECT article_id, '# ' || coalesce(nullif(title, ''), 'N/A') || chr(10) || 'Score: ' || CASE WHEN article_id % 5 = 0 THEN 'N/A' ELSE format('{:.1f}', trend) END || chr(10) || chr(10) || coalesce(nullif(trim(summary, ' '), ''), 'N/A') AS card FROM analyses JOIN articles ON article_id = ingest_seq")
def s13(spark: SparkSession, sf: str) -> DataFrame:
    rows = analyses(spark, sf).join(articles(spark, sf), F.col("article_id") == F.col("ingest_seq")).withColumn("score", F.when(F.col("article_id") % 5 > 0, F.col("trend")))
    return report.render_cards(rows, "article_id", "title", "summary", "score")


@query("S13_insight_cards", repeatable(ANALYSES, ARTICLES) + """SELECT article_id, '# ' || coalesce(nullif(title, ''), 'N/A') || ' — 深度洞察' || chr(10) || chr(10) || '**来源**：' || source_code || chr(10) || '**资讯分类**：' || category || chr(10) || '**统一排序分**：' || CASE WHEN article_id % 5 = 0 THEN 'N/A' ELSE format('{:.1f}', trend) END || '/10' || chr(10) || chr(10)
 || '## 技术背景' || chr(10) || coalesce(nullif(trim(summary, ' '), ''), 'N/A') || chr(10) || chr(10) || '## 标准术语' || chr(10) || CASE article_id % 4 WHEN 0 THEN 'N/A' WHEN 1 THEN '- ' || category || ' (' || info_type || ') -> 词；别名：' || lang || '，x' WHEN 2 THEN '- ' || category || chr(10) || '- ' || info_type ELSE '- 词' END AS card FROM analyses JOIN articles ON article_id = ingest_seq""")
def s13b(spark: SparkSession, sf: str) -> DataFrame:
    """Insight cards with a list of terms, some of whose parts are missing."""
    rows = analyses(spark, sf).join(articles(spark, sf), F.col("article_id") == F.col("ingest_seq"))
    term = lambda t, a, z, *other: F.struct(t.cast("string").alias("term"), a.cast("string").alias("abbr"), z.cast("string").alias("zh"), F.array(*other).cast("array<string>").alias("aliases"))
    none, kind = F.lit(None), F.col("article_id") % 4
    terms = F.when(kind == 1, F.array(term(F.col("category"), F.col("info_type"), F.lit("词"), F.col("lang"), F.lit(" "), F.lit("x")))).when(kind == 2, F.array(term(F.col("category"), F.col("category"), none), term(none, F.col("info_type"), F.lit(" ")), term(none, none, none))).when(kind == 3, F.array(term(F.lit(""), none, F.lit("词"))))
    rows = rows.withColumn("terms", report.term_bullets(terms))
    return report.render_insights(rows, "article_id", {"来源": "source_code", "资讯分类": "category"}, {"技术背景": "summary", "标准术语": "terms"}, "title", F.when(F.col("article_id") % 5 > 0, F.col("trend")))


@query("S14_hydrate", f"SELECT p.page_id, coalesce(CASE WHEN d.page_id % 3 > 0 THEN length(d.html) END, -1) AS size FROM (SELECT page_id, {STRIP_TRACKING} AS u FROM pages) p LEFT JOIN (SELECT page_id, html, {STRIP_TRACKING} AS u FROM pages) d ON p.u = d.u AND d.page_id % 3 > 0")
def s14(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", "html", urls.strip_tracking("url").alias("u"))
    detail = p.filter("page_id % 3 > 0").select("u", F.length("html").cast("long").alias("size"))
    return files.hydrate(p.select("page_id", "u"), detail, "u", {"size": F.lit(-1).cast("long")}).select("page_id", "size")


@query("H6_sitemap_candidates", A + """, r AS (SELECT source_code, regexp_replace(url, '\\?.*$', '') || CASE WHEN contains(url, 'id=') THEN '?id=7' ELSE '' END AS url, publish_time, regexp_extract(url, '/news/([0-9]+)', 1) AS n FROM articles WHERE contains(source_code, 'src1'))
 SELECT * FROM (SELECT source_code, url, max(publish_time) AS lastmod FROM r WHERE coalesce(publish_time BETWEEN TIMESTAMP '2024-02-01' AND TIMESTAMP '2024-05-31 23:59:59', TRUE) AND NOT (starts_with(n, '1') AND NOT starts_with(n, '12'))
 AND length(n) >= 1 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source_code ORDER BY lastmod DESC NULLS LAST, url) <= 15""")
def h6(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of sitemaps: allowed hosts, robots rules, dates, article URLs, then the newest of each source."""
    rows = articles(spark, sf).select("source_code", F.concat(F.regexp_replace("url", r"/news/([0-9]+)", "/news/2024/05/$1")).alias("loc"), F.col("publish_time").alias("lastmod"))
    start, end = (F.lit(t).cast("timestamp_ntz") for t in ("2024-02-01", "2024-05-31 23:59:59"))
    rules = rows.select(urls.origin("loc").alias("origin")).distinct().select("origin", F.inline(F.expr("array(named_struct('rule_no', 1, 'allow', true, 'path_prefix', '/news/2024/05/12'), named_struct('rule_no', 2, 'allow', false, 'path_prefix', '/news/2024/05/1'))")))
    return files.sitemap_candidates(rows, "source_code", start, end, rules, F.array(F.lit("src1")), 15).withColumn("url", F.replace("url", F.lit("/2024/05/"), F.lit("/")))


@query("F1_source_plans", "SELECT s_suppkey, v AS variant_no, CASE v WHEN 1 THEN 'feed' ELSE 'site' END AS variant, CASE WHEN v = 1 AND s_suppkey % 4 = 0 THEN '9' ELSE '5' END AS minimum FROM supplier, (SELECT unnest([1, 2])::INT AS v)")
def f1(spark: SparkSession, sf: str) -> DataFrame:
    variants = spark.sql("SELECT * FROM VALUES (1, 'feed'), (2, 'site') AS v(variant_no, variant)")
    override = F.when((F.col("variant_no") == 1) & (F.col("s_suppkey") % 4 == 0), F.create_map(F.lit("minimum"), F.lit("9")))
    plans = files.expand_plans(table(spark, sf, "supplier").select("s_suppkey"), variants, {"minimum": "5"}, override)
    return plans.select("s_suppkey", "variant_no", "variant", F.element_at("options", "minimum").alias("minimum"))


TERMS = r"list_distinct(list_filter(string_split(regexp_replace(lower(title), '[^0-9a-zA-Z\x{4e00}-\x{9fff}]+', ' ', 'g'), ' '), lambda w: length(w) >= 2))"


@query("F2_sql_helpers", repeatable(ANALYSES, ARTICLES) + f"SELECT article_id, list_max(list_filter({C.ANCHORS}::DOUBLE[], lambda a: a <= engineering)) AS anchor, {RANK_SQL} AS rank, {KEY} AS key, len({TERMS}) AS n_terms, round(CASE WHEN len({TERMS}) = 0 THEN 0 ELSE 1.0 / len(list_distinct(list_concat({TERMS}, ['the']))) * list_contains({TERMS}, 'the')::INT END, 9) AS near FROM analyses JOIN articles ON article_id = ingest_seq")
def f2(spark: SparkSession, sf: str) -> DataFrame:
    sql.register(spark)
    rows = analyses(spark, sf).join(articles(spark, sf), F.col("article_id") == F.col("ingest_seq"))
    text_of = "SELECT article_id, anchor(engineering) AS anchor, rank_score(relevance, trend, engineering, depth, fresh) AS rank, title_key(title) AS key, CAST(size(term_set(title)) AS BIGINT) AS n_terms, round(jaccard(term_set(title), array('the')), 9) AS near FROM {rows}"
    return spark.sql(text_of, rows=rows)


# ---- streaming; each stream drains a table and is held against its batch twin


@query("T1_stream_dedup", "SELECT DISTINCT user_id FROM events")
def t1(spark: SparkSession, sf: str) -> DataFrame:
    stream = jobs.stream_table(spark, f"{sf}/events.parquet").select("user_id", "ts")
    return jobs.drain(jobs.dedup_stream(stream, "user_id", "ts", "60 days"), "dedup").select("user_id")


@query("T2_incremental_import", "SELECT 'h' || event_id AS url_hash, event_type AS title, event_id % 2 = 0 AS analysed, event_id % 10 = 0 AS selected FROM events")
def t2(spark: SparkSession, sf: str) -> DataFrame:
    """Each micro-batch of events is a delivery into the star: an article each, an analysis for every second, an insight for every tenth. The whole runs twice."""
    path = shared_path(spark, "import")
    none = lambda ddl: spark.createDataFrame([], ddl)
    star_ = {
        "articles": none("url_hash string, article_id long, author string, publish_time timestamp, crawl_time timestamp, title string"), "analyses": none("batch_no string, article_id long, trend double"),
        "insights": none("batch_no string, article_id long, text string"), "links": none("batch_no string, article_id long, analysed boolean, selected boolean"),
        "batches": none("batch_no string, status string, article_count long, success_count long, failed_count long"),
    }

    def payload(batch: DataFrame) -> dict[str, DataFrame]:
        name = F.concat(F.lit("h"), F.col("event_id").cast("string")).alias("url_hash")
        none = F.lit(None).cast("timestamp")
        return {
            "articles": batch.select(name, F.lit("").alias("author"), none.alias("publish_time"), none.alias("crawl_time"), F.col("event_type").alias("title")),
            "analyses": batch.filter("event_id % 2 = 0").select(name, F.col("value").alias("trend")), "insights": batch.filter("event_id % 10 = 0").select(name, F.lit("told").alias("text")),
        }

    events = jobs.stream_table(spark, f"{sf}/events.parquet").select("event_id", "event_type", "value")
    for _ in range(2):  # without the first run's state: all comes again
        jobs.import_stream(events, path, star_, payload)
    made = jobs.read_star(spark, path)
    return made["articles"].join(made["links"], "article_id").select("url_hash", "title", "analysed", "selected")


@query("T3_stream_health", repeatable(RUNS) + ", s AS (SELECT *, sum((status = 'success')::INT) OVER (PARTITION BY source_id ORDER BY finished_at, run_id) AS g FROM runs), m AS (SELECT source_id, max(g) AS g FROM s GROUP BY source_id) SELECT source_id, count(*) FILTER (status <> 'success') AS failures FROM s JOIN m USING (source_id, g) GROUP BY source_id")
def t3(spark: SparkSession, sf: str) -> DataFrame:
    stream = jobs.stream_table(spark, f"{sf}/events.parquet").selectExpr("event_id AS run_id", "user_id AS source_id", "CAST(ts AS TIMESTAMP) AS finished_at", "CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'partial' ELSE 'success' END AS status")
    out = jobs.drain(jobs.health_stream(stream, "source_id", "finished_at", "status", "run_id"), "health")
    return out.select("source_id", "failures")


@query("T4_window_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def t4(spark: SparkSession, sf: str) -> DataFrame:
    """The batch twin of window_counts()."""
    return table(spark, sf, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("T4_stream_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events WHERE time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY GROUP BY ALL")
def t4b(spark: SparkSession, sf: str) -> DataFrame:
    """The stream, drained: windows that the watermark, two days behind the latest event, has passed."""
    stream = jobs.stream_table(spark, f"{sf}/events.parquet").select("ts", "event_type")
    return jobs.drain(jobs.window_counts(stream, "ts", "1 day", "2 days", "event_type"), "windows").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


