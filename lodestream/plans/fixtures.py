"""Tables of the pipeline's shapes, derived from the given ones, for Spark and as SQL views.

Nothing is made up beyond columns computed from the rows of the tables, so work
grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS ingest_seq",
        "source AS source_code",
        "trim(left(text, 60)) AS title",
        "concat('https://', source, '.example.com/news/', CAST(CASE WHEN doc_id % 10 = 3 THEN doc_id - 1 ELSE doc_id END AS STRING), CASE WHEN doc_id % 4 = 1 THEN '?utm_source=feed&id=7' ELSE '' END) AS url",
        "text AS body",
        "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE substr(text, 61, 200) END AS summary",
        "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE timestampadd(HOUR, CAST(doc_id * 5 % 4800 AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00') END AS publish_time",
        "TIMESTAMP_NTZ '2024-07-20 12:00:00' AS crawl_time",
        "CASE WHEN doc_id % 9 = 0 THEN NULL ELSE doc_id % 9 <> 4 END AS related",
        "(doc_id % 11) / 10.0D AS confidence",
        "lang",
    )


ARTICLES = """articles AS (SELECT doc_id AS ingest_seq, source AS source_code, trim(left(text, 60), ' ') AS title,
  'https://' || source || '.example.com/news/' || (CASE WHEN doc_id % 10 = 3 THEN doc_id - 1 ELSE doc_id END)::VARCHAR || CASE WHEN doc_id % 4 = 1 THEN '?utm_source=feed&id=7' ELSE '' END AS url,
  text AS body, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE substr(text, 61, 200) END AS summary,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + to_hours((doc_id * 5 % 4800)::INT) END AS publish_time,
  TIMESTAMP '2024-07-20 12:00:00' AS crawl_time, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE doc_id % 9 <> 4 END AS related,
  (doc_id % 11) / 10.0::DOUBLE AS confidence, lang FROM documents)"""


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scored row for each labelled document, in batches of 500 numbers."""
    return table(spark, sf_dir, "labels").selectExpr(
        "doc_id AS article_id",
        "CAST(floor(doc_id / 500) AS BIGINT) AS batch_id",
        "CAST(doc_id % 11 AS DOUBLE) AS relevance",
        "CAST(doc_id * 3 % 11 AS DOUBLE) AS trend",
        "CAST(doc_id * 7 % 101 AS DOUBLE) / 10 AS engineering",
        "CAST(doc_id * 13 % 101 AS DOUBLE) / 10 AS depth",
        "CAST(doc_id % 6 AS DOUBLE) AS fresh",
        "concat('cat', CAST(doc_id * 17 % 8 AS STRING)) AS category",
        "concat('type', CAST(doc_id * 5 % 4 AS STRING)) AS info_type",
        "CASE WHEN quality = 1 THEN 'success' ELSE 'failed' END AS status",
        "toxic = 1 AS deep",
    )


ANALYSES = """analyses AS (SELECT doc_id AS article_id, floor(doc_id / 500)::BIGINT AS batch_id, (doc_id % 11)::DOUBLE AS relevance, (doc_id * 3 % 11)::DOUBLE AS trend,
  (doc_id * 7 % 101)::DOUBLE / 10 AS engineering, (doc_id * 13 % 101)::DOUBLE / 10 AS depth, (doc_id % 6)::DOUBLE AS fresh, 'cat' || (doc_id * 17 % 8) AS category,
  'type' || (doc_id * 5 % 4) AS info_type, CASE WHEN quality = 1 THEN 'success' ELSE 'failed' END AS status, toxic = 1 AS deep FROM labels)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection run for each event: source, time, status, count."""
    return table(spark, sf_dir, "events").selectExpr("event_id AS run_id", "user_id AS source_id", "ts AS finished_at", "CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'partial' ELSE 'success' END AS status", "CAST(floor(value) AS BIGINT) AS n")


RUNS = "runs AS (SELECT event_id AS run_id, user_id AS source_id, ts AS finished_at, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'partial' ELSE 'success' END AS status, floor(value)::BIGINT AS n FROM events)"

# the rank score of a row of analyses, in decimals
RANK_SQL = "round(relevance::DECIMAL(6,3) * 0.35::DECIMAL(3,2) + trend::DECIMAL(6,3) * 0.30::DECIMAL(3,2) + engineering::DECIMAL(6,3) * 0.20::DECIMAL(3,2) + depth::DECIMAL(6,3) * 0.10::DECIMAL(3,2) + fresh::DECIMAL(6,3) * 0.05::DECIMAL(3,2), 2)::DOUBLE"


def quoted(values: list[str]) -> str:
    """An SQL list of strings."""
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def contains_any(column: str, values: list[str]) -> str:
    return f"(len(list_filter({quoted(values)}, lambda kw_: contains({column}, kw_))) > 0)"


def count_in(column: str, values: list[str]) -> str:
    return f"len(list_filter({quoted(values)}, lambda kw_: contains({column}, kw_)))"


def repeatable(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


__all__ = ["ANALYSES", "ARTICLES", "F", "RANK_SQL", "RUNS", "analyses", "articles", "contains_any", "count_in", "quoted", "repeatable", "runs", "table"]
