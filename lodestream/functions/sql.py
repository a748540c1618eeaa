"""The functions by name, for SQL text: temporary SQL functions of a session, which Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lodestream import config as C

HAN = r"\\x{4e00}-\\x{9fff}"
DEFINITIONS = {
    "title_key(title STRING) RETURNS STRING": f"regexp_replace(lower(title), '[^0-9a-zA-Z{HAN}]+', '')",
    "words_of(title STRING) RETURNS ARRAY<STRING>": f"filter(split(regexp_replace(lower(coalesce(title, '')), '[^0-9a-zA-Z{HAN}]+', ' '), ' '), w -> length(w) >= 2)",
    "han_pairs(han STRING) RETURNS ARRAY<STRING>": "CASE WHEN length(han) >= 2 THEN transform(sequence(1, length(han) - 1), i -> substring(han, i, 2)) ELSE cast(array() AS ARRAY<STRING>) END",
    "term_set(title STRING) RETURNS ARRAY<STRING>": f"array_distinct(concat(words_of(title), han_pairs(regexp_replace(coalesce(title, ''), '[^{HAN}]', ''))))",
    "jaccard(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE": "CASE WHEN size(a) = 0 OR size(b) = 0 THEN 0.0D ELSE size(array_intersect(a, b)) / size(array_union(a, b)) END",
    "anchor(v DOUBLE) RETURNS DOUBLE": f"array_max(filter(array({', '.join(f'{a}D' for a in C.ANCHORS)}), a -> a <= v))",
    "rank_score(relevance DOUBLE, trend DOUBLE, engineering DOUBLE, depth DOUBLE, fresh DOUBLE) RETURNS DOUBLE": "cast(round("
    + " + ".join(f"cast(coalesce({c}, 0) AS DECIMAL(6,3)) * cast({w} AS DECIMAL(3,2))" for c, w in zip(("relevance", "trend", "engineering", "depth", "fresh"), C.RANK_WEIGHTS.values(), strict=True))
    + ", 2) AS DOUBLE)",
}


def register(spark: SparkSession) -> list[str]:
    """Names of the functions, which SQL text of this session may use from now on."""
    for head, body in DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in DEFINITIONS]
