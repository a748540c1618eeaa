"""Queries of the scalar functions (X) over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream import config as C
from lodestream.functions import scores, text, times, urls
from lodestream.plans.catalog import query
from lodestream.plans.fixtures import ANALYSES, ARTICLES, RANK_SQL, analyses, articles, contains_any, count_in, quoted, repeatable, table
from lodestream.sources import files

A = repeatable(ARTICLES)


@query("X1_url_content_hash", A + "SELECT ingest_seq, sha256(url) AS url_hash, sha256(body) AS content_hash FROM articles")
def x1(spark: SparkSession, sf: str) -> DataFrame:
    return articles(spark, sf).select("ingest_seq", text.digest("url").alias("url_hash"), text.digest("body").alias("content_hash"))


@query("X2_strip_fragment", "SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM pages")
def x2(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", urls.strip_fragment("url").alias("url"))


STRIP_TRACKING = f"""(SELECT CASE WHEN q <> '' THEN base || '?' || q ELSE base END FROM (SELECT regexp_replace(u, '\\?.*$', '') AS base,
  array_to_string(list_transform(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT list_contains({quoted(C.TRACKING_KEYS)}, lower(string_split(p, '=')[1]))),
    lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END), '&') AS q FROM (SELECT regexp_replace(url, '#.*$', '') AS u)))"""


@query("X3_strip_tracking", f"SELECT page_id, {STRIP_TRACKING} AS url FROM pages")
def x3(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", urls.strip_tracking("url").alias("url"))


@query("X5_origin_host", "SELECT page_id, CASE WHEN regexp_extract(url, '^(https?://[^/?#]+)', 1) <> '' THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/' ELSE '' END AS origin, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host FROM pages")
def x5(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", urls.origin("url").alias("origin"), urls.bare_host("url").alias("host"))


PATH = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"


@query("X6_title_from_url", f"SELECT page_id, CASE WHEN t <> '' THEN t ELSE url END AS title FROM (SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_extract(regexp_replace({PATH}, '/+$', ''), '([^/]*)$', 1), '(?i)\\.(html?|aspx?)$', ''), '[-_]+', ' ', 'g'), ' ') AS t FROM pages)")
def x6(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", urls.title_from_url("url").alias("title"))


KEY = "regexp_replace(lower(title), '[^0-9a-zA-Z\\x{4e00}-\\x{9fff}]+', '', 'g')"


@query("X7_title_key", A + f"SELECT ingest_seq, {KEY} AS key FROM articles")
def x7(spark: SparkSession, sf: str) -> DataFrame:
    return articles(spark, sf).select("ingest_seq", text.title_key("title").alias("key"))


@query("X8_clean_text", r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t\x{a0}]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS clean FROM documents")
def x8(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.clean("text").alias("clean"))


@query("X9_list_values", "SELECT doc_id, list_filter(list_transform(string_split(translate(text, ';', ','), ','), lambda x: trim(x, ' ')), lambda x: x <> '') AS vals FROM documents")
def x9(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.as_list("text").alias("vals"))


@query("X10_bool_values", "SELECT doc_id, coalesce(lower(trim(v, ' ')) IN ('true', '1', 'yes', '是'), FALSE) AS flag FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN ' YES ' WHEN doc_id % 3 = 0 THEN quality::VARCHAR WHEN doc_id % 3 = 1 THEN NULL ELSE '是' END AS v FROM labels)")
def x10(spark: SparkSession, sf: str) -> DataFrame:
    v = F.expr("CASE WHEN toxic = 1 THEN ' YES ' WHEN doc_id % 3 = 0 THEN CAST(quality AS STRING) WHEN doc_id % 3 = 1 THEN NULL ELSE '是' END")
    return table(spark, sf, "labels").select("doc_id", text.as_bool(v).alias("flag"))


@query("X11_number_values", "SELECT event_id, least(greatest(coalesce(TRY_CAST(v AS DOUBLE), 0.5), 0.0), 1.0) AS confidence FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN event_type ELSE (value / 50)::VARCHAR END AS v FROM events)")
def x11(spark: SparkSession, sf: str) -> DataFrame:
    v = F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise((F.col("value") / 50).cast("string"))
    return table(spark, sf, "events").select("event_id", text.as_number(v, 0.5, 0.0, 1.0).alias("confidence"))


@query("X12_object_values", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '{\"note\":\"' || event_type || '\"}' ELSE json(props)::VARCHAR END AS detail FROM events")
def x12(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, F.col("event_type")).otherwise(F.col("props")).alias("v"))
    return rows.select("event_id", text.as_object("v").alias("detail"))


@query("X13_standard_terms", "SELECT doc_id, list_transform(list_filter(string_split(text, ' '), lambda x: trim(x, ' ') <> '')[1:10], lambda x: trim(x, ' ')) AS terms FROM documents")
def x13(spark: SparkSession, sf: str) -> DataFrame:
    """Names of up to ten terms, given as texts in even rows and as objects in odd ones."""
    words = F.split("text", " ")
    given = F.when(F.col("doc_id") % 2 == 0, F.to_json(words)).otherwise(F.to_json(F.transform(words, lambda w: F.struct(w.alias("term")))))
    return table(spark, sf, "documents").select("doc_id", F.transform(text.standard_terms(given), lambda t: t["term"]).alias("terms"))


SCORES = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{\"trend\": \"x\", \"score_trend\": ' || round(value, 1)::VARCHAR || '}' ELSE '{\"trend\": ' || round(value, 1)::VARCHAR || '}' END AS j FROM events"


@query("X14_score_extraction", f"SELECT event_id, coalesce(CASE WHEN a BETWEEN 0 AND 10 THEN a END, CASE WHEN b BETWEEN 0 AND 10 THEN b END, 0.0) AS trend FROM (SELECT event_id, TRY_CAST(j->>'$.trend' AS DOUBLE) AS a, TRY_CAST(j->>'$.score_trend' AS DOUBLE) AS b FROM ({SCORES}))")
def x14(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", F.expr("CASE WHEN event_id % 3 = 0 THEN concat('{\"trend\": \"x\", \"score_trend\": ', CAST(round(value, 1) AS STRING), '}') ELSE concat('{\"trend\": ', CAST(round(value, 1) AS STRING), '}') END AS j"))
    return rows.select("event_id", scores.score_of(F.try_parse_json("j"), C.SCORE_KEYS["trend"]).alias("trend"))


@query("X15_anchor", repeatable(ANALYSES) + f"SELECT article_id, list_max(list_filter({C.ANCHORS}::DOUBLE[], lambda a: a <= engineering)) AS anchor FROM analyses")
def x15(spark: SparkSession, sf: str) -> DataFrame:
    return analyses(spark, sf).select("article_id", scores.anchored("engineering").alias("anchor"))


BANDS = " ".join(f"WHEN days <= {d} THEN {s}::DOUBLE" for d, s in C.TIMELINESS)


@query("X16_timeliness", A + f"SELECT ingest_seq, CASE WHEN days IS NULL THEN 0.0::DOUBLE {BANDS} ELSE 0.0::DOUBLE END AS timeliness FROM (SELECT ingest_seq, greatest(0, floor(epoch(crawl_time - publish_time) / 86400)) AS days0, CASE WHEN publish_time IS NULL THEN NULL ELSE greatest(0, floor(epoch(crawl_time - publish_time) / 86400)) END AS days FROM articles)")
def x16(spark: SparkSession, sf: str) -> DataFrame:
    return articles(spark, sf).select("ingest_seq", scores.timeliness("publish_time", "crawl_time").alias("timeliness"))


@query("X17_rank_score", repeatable(ANALYSES) + f"SELECT article_id, {RANK_SQL} AS rank_score FROM analyses")
def x17(spark: SparkSession, sf: str) -> DataFrame:
    return analyses(spark, sf).select("article_id", scores.rank_score("relevance", "trend", "engineering", "depth", "fresh").alias("rank_score"))


@query("X18_score_fallback", repeatable(ANALYSES) + "SELECT article_id, coalesce(CASE WHEN article_id % 3 > 0 THEN trend END, CASE WHEN article_id % 2 > 0 THEN depth END, 0.0) AS score FROM analyses")
def x18(spark: SparkSession, sf: str) -> DataFrame:
    return analyses(spark, sf).select("article_id", scores.score_or(F.when(F.col("article_id") % 3 > 0, F.col("trend")), F.when(F.col("article_id") % 2 > 0, F.col("depth"))).alias("score"))


CAP_TERMS = [("vision", 1.0, ["the", "der"]), ("device", 1.0, ["que", "des"]), ("hardware", 2.0, ["on", "en"])]
CAP_SQL = lambda value: "CASE " + " ".join(f"WHEN {contains_any('t', terms)} THEN {value(domain, most)}" for domain, most, terms in CAP_TERMS) + " END"


@query("X19_domain_cap", A + f"SELECT ingest_seq, {CAP_SQL(lambda d, m: chr(39) + d + chr(39))} AS domain, least(5.0, coalesce({CAP_SQL(lambda d, m: f'{m}::DOUBLE')}, 10.0)) AS relevance FROM (SELECT ingest_seq, lower(title) AS t FROM articles)")
def x19(spark: SparkSession, sf: str) -> DataFrame:
    cap = scores.domain_cap(F.lower("title"), CAP_TERMS)
    return articles(spark, sf).select("ingest_seq", cap["domain"].alias("domain"), F.least(F.lit(5.0), F.coalesce(cap["most"], F.lit(10.0))).alias("relevance"))


WORDS = {"one": ["tion", "er", "the"], "two": ["en", "que", "st"], "three": ["an", "de", "ou"]}
PREDICT_SQL = "CASE WHEN greatest({0}, {1}, {2}) = 0 THEN 'rest' WHEN {0} >= {1} AND {0} >= {2} THEN 'one' WHEN {1} >= {2} THEN 'two' ELSE 'three' END".format(*(count_in("t", w) for w in WORDS.values()))
CANDIDATE_SQL = f"({count_in('t', C.RELEVANCE_TERMS)} * 5.0 + CASE WHEN coalesce(summary, '') <> '' THEN 2.0 ELSE 0.0 END + confidence * 5.0)::DOUBLE"
LOW_TEXT = "lower(title || ' ' || coalesce(summary, ''))"


@query("X20_category_prediction", A + f"SELECT ingest_seq, {PREDICT_SQL} AS category FROM (SELECT ingest_seq, lower(title) AS t FROM articles)")
def x20(spark: SparkSession, sf: str) -> DataFrame:
    return articles(spark, sf).select("ingest_seq", scores.predict_category(F.lower("title"), "source_code", WORDS, "rest").alias("category"))


@query("X21_candidate_score", A + f"SELECT ingest_seq, {CANDIDATE_SQL} AS score FROM (SELECT *, {LOW_TEXT} AS t FROM articles)")
def x21(spark: SparkSession, sf: str) -> DataFrame:
    low = F.lower(F.concat("title", F.lit(" "), F.coalesce("summary", F.lit(""))))
    return articles(spark, sf).select("ingest_seq", scores.candidate_score(low, "summary", "confidence").alias("score"))


LABELS = ["大模型基础技术", " LLM应用 ", "医疗AI", "开源", "", "金融", "其他", "Agent与智能体平台"]
_ALLOWED = [*C.CATEGORY_KEYWORDS, C.CATCH_ALL]
NORMAL_SQL = f"CASE WHEN raw = '' THEN '{C.CATCH_ALL}' WHEN list_contains({quoted(_ALLOWED)}, raw) THEN raw " + " ".join(f"WHEN contains(raw, '{k}') THEN '{v}'" for k, v in C.CATEGORY_SYNONYMS) + f" WHEN {contains_any('raw', C.OTHER_VERTICALS)} THEN '{C.CATCH_ALL}' " + " ".join(f"WHEN contains(raw, '{n}') OR contains('{n}', raw) THEN '{n}'" for n in _ALLOWED) + f" ELSE '{C.CATCH_ALL}' END"


@query("X22_category_normaliser", f"SELECT doc_id, {NORMAL_SQL} AS category FROM (SELECT doc_id, trim({quoted(LABELS)}[(doc_id % {len(LABELS)} + 1)::INT] || CASE WHEN doc_id % 3 > 0 THEN string_split(text, ' ')[1] ELSE '' END, ' ') AS raw FROM documents)")
def x22(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as a model may give them: alone, or followed by a word of the text."""
    label = F.concat(F.element_at(F.array(*map(F.lit, LABELS)), (F.col("doc_id") % len(LABELS) + 1).cast("int")), F.when(F.col("doc_id") % 3 > 0, F.split("text", " ")[0]).otherwise(""))
    return table(spark, sf, "documents").select("doc_id", scores.normal_category(label).alias("category"))


@query("X23_language", r"SELECT doc_id, CASE WHEN han > 0 AND latin > 2 * han THEN 'mixed' WHEN han > 0 THEN 'zh' WHEN latin > 0 THEN 'en' ELSE 'unknown' END AS language FROM (SELECT doc_id, length(regexp_replace(t, '[^\x{4e00}-\x{9fff}]', '', 'g')) AS han, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS latin FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '人工智能' || left(text, 6) WHEN doc_id % 4 = 1 THEN '12' ELSE text END AS t FROM documents))")
def x23(spark: SparkSession, sf: str) -> DataFrame:
    t = F.expr("CASE WHEN doc_id % 4 = 0 THEN concat('人工智能', left(text, 6)) WHEN doc_id % 4 = 1 THEN '12' ELSE text END")
    return table(spark, sf, "documents").select("doc_id", text.language(t).alias("language"))


@query("X24_input_text", A + "SELECT ingest_seq, coalesce(nullif(concat_ws(chr(10) || chr(10), nullif(trim(substr(summary, 1, 1200), ' '), ''), nullif(trim(substr(body, 1, 3500), ' '), '')), ''), title, '') AS input FROM articles")
def x24(spark: SparkSession, sf: str) -> DataFrame:
    return articles(spark, sf).select("ingest_seq", text.input_text("summary", "body", "title").alias("input"))


@query("X25_iso_time", "SELECT event_id, ts AS at FROM events")
def x25(spark: SparkSession, sf: str) -> DataFrame:
    """The zone is dropped, the wall clock kept."""
    iso = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(F.col("event_id") % 2 == 0, "Z").otherwise("+08:00"))
    return table(spark, sf, "events").select("event_id", times.wall_time(iso).alias("at"))


@query("X27_cut_bytes", "SELECT doc_id, CASE WHEN strlen(text) <= 900 THEN text ELSE left(text, list_max(list_filter(range(224, 898), lambda n: strlen(left(text, n)) <= 897))) || '...' END AS cut FROM documents")
def x27(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.cut_bytes("text", 900).alias("cut"))


@query("X28_alias_mapping", repeatable(ANALYSES) + "SELECT article_id, CASE category WHEN 'cat1' THEN 'first' WHEN 'cat2' THEN 'second' ELSE category END AS category FROM analyses")
def x28(spark: SparkSession, sf: str) -> DataFrame:
    return analyses(spark, sf).select("article_id", text.aliased("category", {"cat1": "first", "cat2": "second"}).alias("category"))


@query("X29_first_sentence", r"SELECT doc_id, substr(CASE WHEN cut <> '' THEN cut ELSE t END, 1, 180) AS sentence FROM (SELECT doc_id, t, regexp_extract(t, '^((?s:.)*?[。！？.!?])', 1) AS cut FROM (SELECT doc_id, trim(text, ' ') AS t FROM documents))")
def x29(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.first_sentence("text").alias("sentence"))


@query("X30_table_cell", r"SELECT doc_id, replace(replace(text, '|', '\|'), chr(10), ' ') AS cell FROM documents")
def x30(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.table_cell("text").alias("cell"))


@query("X31_strip_fence", "SELECT event_id, props AS body FROM events")
def x31(spark: SparkSession, sf: str) -> DataFrame:
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return table(spark, sf, "events").select("event_id", text.strip_fence(fenced).alias("body"))


@query("X32_labelled_bullets", "SELECT event_id, '- ' || (json_keys(props))[1] || ': ' || (props->>('$.' || (json_keys(props))[1])) AS bullets FROM events")
def x32(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", text.bullets(F.from_json("props", "map<string,string>")).alias("bullets"))


@query("X33_date_range", "SELECT event_id, s AS range_start, e AS range_end, CASE WHEN s > e THEN 'invalid_range' ELSE 'ok' END AS outcome FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 DAY ELSE ts - to_days(CASE event_type WHEN 'view' THEN 30 WHEN 'click' THEN 90 ELSE 7 END) END AS s, ts AS e FROM events)")
def x33(spark: SparkSession, sf: str) -> DataFrame:
    days = F.expr("CASE event_type WHEN 'view' THEN 30 WHEN 'click' THEN 90 ELSE 7 END")
    start = F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.expr("INTERVAL 1 DAY"))
    return table(spark, sf, "events").select("event_id", times.date_range(start, F.col("ts"), days).alias("r")).select("event_id", "r.*")


@query("X34_batch_number", "SELECT o_orderkey, n, CASE WHEN n LIKE 'COL-%' THEN 'COL' WHEN n LIKE 'IMP-%' THEN 'IMP' ELSE '' END AS kind, regexp_full_match(n, '[A-Za-z0-9._-]+') AS valid FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'COL-' WHEN 1 THEN 'IMP-' ELSE 'x/' END || o_orderkey::VARCHAR AS n FROM orders)")
def x34(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.expr("concat(CASE o_orderkey % 3 WHEN 0 THEN 'COL-' WHEN 1 THEN 'IMP-' ELSE 'x/' END, CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 2 = 0 THEN '.json' ELSE '' END)")
    return table(spark, sf, "orders").select("o_orderkey", text.batch_number(raw).alias("b")).select("o_orderkey", F.col("b.number").alias("n"), "b.kind", "b.valid")


@query("X35_search_query", "SELECT lang, 'ai ' || lang || ' ('|| array_to_string(list_transform((list_sort(list(DISTINCT source)))[1:8], lambda s: 'site:' || s || '.example.com'), ' OR ') || ') after:2024-01-01 before:2024-03-31' AS query FROM documents GROUP BY lang")
def x35(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("lang", F.concat("source", F.lit(".example.com")).alias("site"), F.array(F.lit("ai"), F.col("lang")).alias("terms"))
    return files.search_queries(rows, "lang", "site", "terms", F.lit("2024-01-01").cast("date"), F.lit("2024-03-31").cast("date"))


@query("X36_fingerprint_source", A + "SELECT ingest_seq, sha256(coalesce(CASE WHEN ingest_seq % 5 > 0 AND trim(body, ' ') <> '' THEN body END, CASE WHEN trim(summary, ' ') <> '' THEN summary END, url)) AS fingerprint FROM articles")
def x36(spark: SparkSession, sf: str) -> DataFrame:
    return articles(spark, sf).select("ingest_seq", text.fingerprint(F.when(F.col("ingest_seq") % 5 > 0, F.col("body")), F.col("summary"), F.col("url")).alias("fingerprint"))


@query("X37_insight_text", A + "SELECT ingest_seq, coalesce(nullif(CASE WHEN ingest_seq % 4 > 1 THEN body END, ''), nullif(CASE WHEN ingest_seq % 2 = 1 THEN title END, ''), nullif(summary, ''), '') AS text FROM articles")
def x37(spark: SparkSession, sf: str) -> DataFrame:
    return articles(spark, sf).select("ingest_seq", text.first_text(F.when(F.col("ingest_seq") % 4 > 1, F.col("body")), F.when(F.col("ingest_seq") % 2 == 1, F.col("title")), "summary").alias("text"))


@query("X38_file_name", A + "SELECT ingest_seq, substr(sha256(url), 1, 16) || '_' || substr(regexp_replace(title, '[^0-9A-Za-z]+', '_', 'g'), 1, 30) || '.md' AS name, coalesce(summary, '') AS summary_tag, source_code || ',' || lang AS labels FROM articles")
def x38(spark: SparkSession, sf: str) -> DataFrame:
    tags = text.tag_map({"summary": "summary"}, {"labels": F.array("source_code", "lang")})
    return articles(spark, sf).select("ingest_seq", text.file_name("url", "title").alias("name"), tags.alias("t")).select("ingest_seq", "name", F.col("t.summary").alias("summary_tag"), F.col("t.labels").alias("labels"))


LINK_SQL = "CASE page_id % 4 WHEN 0 THEN 'next/p' || page_id WHEN 1 THEN '/top/' || page_id WHEN 2 THEN '//other.example.net/x' ELSE 'https://a.example.com/y#z' END"
ABSOLUTE_SQL = "CASE page_id % 4 WHEN 0 THEN regexp_extract(url, '^([A-Za-z]+://[^/?#]+(?:/[^?#]*/|/))', 1) || 'next/p' || page_id WHEN 1 THEN regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || '/top/' || page_id WHEN 2 THEN regexp_extract(url, '^([A-Za-z]+:)', 1) || '//other.example.net/x' ELSE 'https://a.example.com/y' END"


@query("X4_absolute_url", f"SELECT page_id, {ABSOLUTE_SQL} AS url FROM pages")
def x4(spark: SparkSession, sf: str) -> DataFrame:
    from lodestream.operators.pages import absolute

    link = F.expr("CASE page_id % 4 WHEN 0 THEN concat('next/p', page_id) WHEN 1 THEN concat('/top/', page_id) WHEN 2 THEN '//other.example.net/x' ELSE 'https://a.example.com/y#z' END")
    return table(spark, sf, "pages").select("page_id", absolute(link, "url").alias("url"))


@query("X26_free_text_time", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN ts - to_minutes(event_id % 90) WHEN 1 THEN ts - to_hours((event_id % 50)::INT) WHEN 2 THEN ts - to_days((event_id % 20)::INT) WHEN 3 THEN ts - to_days(1) WHEN 4 THEN date_trunc('minute', ts) ELSE NULL END AS at FROM events")
def x26(spark: SparkSession, sf: str) -> DataFrame:
    from lodestream.functions.times import free_time

    said = F.expr("CASE event_id % 6 WHEN 0 THEN concat(event_id % 90, ' 分钟前') WHEN 1 THEN concat('更新 ', event_id % 50, '小时前') WHEN 2 THEN concat(event_id % 20, '天前') WHEN 3 THEN '昨天 更新' WHEN 4 THEN date_format(CAST(ts AS TIMESTAMP), 'yyyy-M-d H:mm') ELSE 'soon' END")
    return table(spark, sf, "events").select("event_id", free_time(said, "ts").alias("at"))
