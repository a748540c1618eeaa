"""Queries of ranking and capped selection (W), and of the candidate pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions import scores, text
from lodestream.operators import dedup, ranking
from lodestream.plans.catalog import query
from lodestream.plans.fixtures import ANALYSES, ARTICLES, RANK_SQL, RUNS, analyses, articles, repeatable, runs, table
from lodestream.plans.scalars import CANDIDATE_SQL, KEY, LOW_TEXT

A = repeatable(ARTICLES)
N = repeatable(ANALYSES)


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    low = F.lower(F.concat("title", F.lit(" "), F.coalesce("summary", F.lit(""))))
    return articles(spark, sf).select("ingest_seq", "source_code", "title", "publish_time", "url", scores.candidate_score(low, "summary", "confidence").alias("score"))


def _best() -> list:
    return [F.col("score").desc(), F.col("publish_time").desc_nulls_last(), F.col("ingest_seq")]


POOL_SQL = A + f""", s AS (SELECT ingest_seq, source_code, title, publish_time, url, {CANDIDATE_SQL} AS score FROM (SELECT *, {LOW_TEXT} AS t FROM articles)),
 d AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY url ORDER BY ingest_seq) = 1),
 k AS (SELECT * FROM (SELECT *, {KEY} AS key FROM d) QUALIFY key = '' OR row_number() OVER (PARTITION BY source_code, key ORDER BY score DESC, publish_time DESC NULLS LAST, ingest_seq) = 1),
 p AS (SELECT *, row_number() OVER (PARTITION BY source_code ORDER BY score DESC, publish_time DESC NULLS LAST, ingest_seq) AS rank FROM k)
SELECT ingest_seq, source_code, score, rank, CASE WHEN rank <= 20 THEN 'selected' ELSE 'deferred' END AS pool FROM p WHERE rank <= 40"""


@query("W2_candidate_pool", POOL_SQL)
def w2(spark: SparkSession, sf: str) -> DataFrame:
    """The collection's first steps end to end: url dedup, score, title dedup, pool."""
    first = dedup.dedup_first(_scored(spark, sf), "url", ["ingest_seq"])
    unique = dedup.dedup_title(first, "source_code", "title", _best())
    return ranking.candidate_pool(unique, "source_code", _best(), 40, 20).select("ingest_seq", "source_code", "score", "rank", "pool")


@query("W3_category_refill", N + ", g AS (SELECT category FROM analyses GROUP BY category HAVING count(*) % 2 = 0) SELECT article_id, category, r AS refill_rank FROM (SELECT article_id, category, row_number() OVER (PARTITION BY category ORDER BY trend DESC, article_id) AS r FROM analyses JOIN g USING (category)) WHERE r <= 5")
def w3(spark: SparkSession, sf: str) -> DataFrame:
    a = analyses(spark, sf)
    gaps = a.groupBy("category").count().filter("count % 2 = 0")
    return ranking.select_refill(a, gaps, "category", [F.col("trend").desc(), F.col("article_id")], 5).select("article_id", "category", "refill_rank")


SIX = "rank_score DESC, relevance DESC, engineering DESC, trend DESC, depth DESC, fresh DESC, article_id"


def _six(spark: SparkSession, sf: str) -> tuple[DataFrame, list]:
    rows = analyses(spark, sf).withColumn("rank_score", scores.rank_score("relevance", "trend", "engineering", "depth", "fresh"))
    return rows, [*(F.col(c).desc() for c in ("rank_score", "relevance", "engineering", "trend", "depth", "fresh")), F.col("article_id")]


@query("W4_top_k_six_keys", N + f"SELECT article_id, rank_score FROM (SELECT *, {RANK_SQL} AS rank_score FROM analyses) ORDER BY {SIX} LIMIT 50")
def w4(spark: SparkSession, sf: str) -> DataFrame:
    rows, order = _six(spark, sf)
    return ranking.select_top(rows, order, 50).select("article_id", "rank_score")


@query("C6_selection_outcomes", N + f"SELECT article_id, CASE WHEN rank_score < 4 THEN 'below_threshold' WHEN row_number() OVER (PARTITION BY rank_score >= 4 ORDER BY {SIX}) <= 50 THEN 'selected' ELSE 'excluded_by_capacity' END AS outcome FROM (SELECT *, {RANK_SQL} AS rank_score FROM analyses)")
def c6(spark: SparkSession, sf: str) -> DataFrame:
    rows, order = _six(spark, sf)
    out = ranking.top_outcomes(rows.filter("rank_score >= 4"), "article_id", order, 50).select("article_id", "outcome")
    return out.unionByName(rows.filter("rank_score < 4").select("article_id", F.lit("below_threshold").alias("outcome")))


@query("W5_capped_one_cap", N + "SELECT batch_id, article_id, CASE WHEN c > 3 THEN 'category_cap' WHEN row_number() OVER (PARTITION BY batch_id, c <= 3 ORDER BY trend DESC, article_id) > 14 THEN 'capacity' ELSE 'selected' END AS outcome FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, category ORDER BY trend DESC, article_id) AS c FROM analyses)")
def w5(spark: SparkSession, sf: str) -> DataFrame:
    """With one cap windows do: the rank within the category, then among those under the cap."""
    from pyspark.sql import Window

    order = [F.col("trend").desc(), F.col("article_id")]
    a = analyses(spark, sf).withColumn("c", F.row_number().over(Window.partitionBy("batch_id", "category").orderBy(*order)))
    n = F.row_number().over(Window.partitionBy("batch_id", F.col("c") <= 3).orderBy(*order))
    return a.withColumn("n", n).select("batch_id", "article_id", F.when(F.col("c") > 3, "category_cap").when(F.col("n") > 14, "capacity").otherwise("selected").alias("outcome"))


@query("W5_capped_many_caps", "WITH RECURSIVE " + N.strip().removeprefix("WITH ") + """, w AS (SELECT batch_id, article_id, category, info_type, row_number() OVER (PARTITION BY batch_id ORDER BY trend DESC, article_id) AS n FROM analyses),
 f(batch_id, n, article_id, outcome, held) AS (SELECT DISTINCT batch_id, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, []::VARCHAR[] FROM w UNION ALL
   SELECT batch_id, n, article_id, o, CASE WHEN o = 'selected' THEN held || [category, info_type] ELSE held END FROM (SELECT w.*, held, CASE WHEN len(list_filter(held, lambda x_: x_ = category)) >= 3 THEN 'category_cap' WHEN len(list_filter(held, lambda x_: x_ = info_type)) >= 5 THEN 'info_type_cap' WHEN len(held) >= 28 THEN 'capacity' ELSE 'selected' END AS o FROM f JOIN w ON w.batch_id = f.batch_id AND w.n = f.n + 1))
 SELECT batch_id, article_id, outcome FROM f WHERE n > 0""")
def w5b(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.select_capped(analyses(spark, sf), "batch_id", [F.col("trend").desc(), F.col("article_id")], {"category": 3, "info_type": 5}, 14, "article_id")


@query("W6_display_order", N + "SELECT article_id, category, coalesce(list_position(['cat3', 'cat1'], category), 3)::INT AS place FROM analyses")
def w6(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.display_order(analyses(spark, sf), "category", ["cat3", "cat1"], "trend", "article_id").select("article_id", "category", F.col("place").cast("int").alias("place"))


@query("W7_period_limits", "SELECT o_orderkey, period, CASE period WHEN 'weekly' THEN 60 ELSE 100 END AS candidates, CASE period WHEN 'weekly' THEN 30 ELSE 50 END AS initial FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'quarterly' WHEN o_orderkey % 11 + 1 <= 7 THEN 'weekly' ELSE 'monthly' END AS period FROM orders)")
def w7(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("s"), F.date_add("o_orderdate", (F.col("o_orderkey") % 11).cast("int")).alias("e"), F.when(F.col("o_orderkey") % 5 == 0, "quarterly").alias("period"))
    limits = {"weekly": (60, 30), "monthly": (100, 50), "quarterly": (100, 50)}
    return ranking.processing_limits(asked, "s", "e", limits, ("candidates", "initial")).select("o_orderkey", "period", "candidates", "initial")


@query("W8_report_target", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 8 WHEN '2-HIGH' THEN 14 WHEN '3-MEDIUM' THEN 18 ELSE 12 END AS target FROM orders")
def w8(spark: SparkSession, sf: str) -> DataFrame:
    targets = {"1-URGENT": 8, "2-HIGH": 14, "3-MEDIUM": 18}
    return table(spark, sf, "orders").select("o_orderkey", scores.target_for(F.col("o_orderpriority"), targets, 12).alias("target"))


@query("W9_round_robin", N + "SELECT article_id, category FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY trend DESC, article_id) AS turn FROM analyses) ORDER BY turn, category LIMIT 30")
def w9(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.round_robin(analyses(spark, sf), "category", "category", [F.col("trend").desc(), F.col("article_id")], 30).select("article_id", "category")


@query("W10_best_variant", repeatable(RUNS) + ", a AS (SELECT source_id, run_id, n, 20 AS least, status = 'failed' AS bad FROM runs) SELECT source_id, coalesce(min(run_id) FILTER (n >= least AND n > 0), arg_max(run_id, (n, -run_id))) AS chosen, coalesce(arg_min(n, run_id) FILTER (n >= least AND n > 0), max(n)) AS n, CASE WHEN count(*) FILTER (n >= least AND n > 0) > 0 THEN 'success' WHEN max(n) > 0 THEN 'partial' WHEN bool_or(bad) THEN 'failed' ELSE 'empty' END AS status FROM a GROUP BY source_id")
def w10(spark: SparkSession, sf: str) -> DataFrame:
    a = runs(spark, sf).select("source_id", "run_id", "n", F.lit(20).alias("least"), F.when(F.col("status") == "failed", "x").alias("error"))
    return ranking.choose_variant(a, "source_id", "run_id", "n", "least", "error")


@query("W11_newest_urls", A + "SELECT source_code, url, ingest_seq, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source_code ORDER BY publish_time DESC NULLS LAST, ingest_seq) AS r FROM articles) WHERE r <= 10")
def w11(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.top_urls(articles(spark, sf), "source_code", "publish_time", "ingest_seq", 10).select("source_code", "url", "ingest_seq", "rank")


@query("W12_circuit_breaker", repeatable(RUNS) + "SELECT run_id, coalesce(sum((status = 'failed')::INT) OVER (PARTITION BY source_id ORDER BY finished_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 3 AND status <> 'failed' AS use_detail FROM runs")
def w12(spark: SparkSession, sf: str) -> DataFrame:
    rows = runs(spark, sf).withColumn("bad", F.col("status") == "failed")
    return ranking.breaker(rows, "source_id", ["finished_at", "run_id"], "bad", 3).select("run_id", "use_detail")


@query("C1_term_sets", A + r"SELECT ingest_seq, array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(title), '[^0-9a-zA-Z\x{4e00}-\x{9fff}]+', ' ', 'g'), ' '), lambda w: length(w) >= 2) || [lower(lang), lower(source_code)])), ' ') AS terms FROM articles")
def c1(spark: SparkSession, sf: str) -> DataFrame:
    return articles(spark, sf).select("ingest_seq", F.array_join(F.array_sort(text.term_set("title", F.array("lang", "source_code"))), " ").alias("terms"))


@query("C2_set_similarity", A + r", t AS (SELECT ingest_seq, list_distinct(list_filter(string_split(regexp_replace(lower(title), '[^0-9a-zA-Z\x{4e00}-\x{9fff}]+', ' ', 'g'), ' '), lambda w: length(w) >= 2)) AS s FROM articles) SELECT a.ingest_seq, round(CASE WHEN len(a.s) = 0 OR len(b.s) = 0 THEN 0.0 ELSE len(list_intersect(a.s, b.s)) / len(list_distinct(a.s || b.s)) END, 9) AS similarity FROM t a JOIN t b ON b.ingest_seq = a.ingest_seq + 1")
def c2(spark: SparkSession, sf: str) -> DataFrame:
    t = articles(spark, sf).select("ingest_seq", text.term_set("title").alias("s"))
    b = t.select((F.col("ingest_seq") - 1).alias("ingest_seq"), F.col("s").alias("o"))
    return t.join(b, "ingest_seq").select("ingest_seq", F.round(text.jaccard("s", "o"), 9).alias("similarity"))
