"""Exact deduplication and set operations by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.text import digest, title_key


def dedup_first(df: DataFrame, key: str | list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in a total order.

    Groups are reduced before the shuffle: the least row of each key and task
    goes on, so a key with very many rows is no hot spot.
    """
    keys = [key] if isinstance(key, str) else key
    names = [f"_o{i}" for i in range(len(order))]
    rest = [c for c in df.columns if c not in keys]
    least = F.min(F.struct(*(F.col(n) for n in names), F.struct(*(F.col(c) for c in rest)).alias("_row"))).alias("_first")
    return df.withColumns(dict(zip(names, (F.col(o) if isinstance(o, str) else o for o in order), strict=True))).groupBy(*keys).agg(least).select(*keys, "_first._row.*").select(*df.columns)


def dedup_history(df: DataFrame, history: DataFrame, key: str) -> DataFrame:
    return df.join(history.select(key).distinct(), key, "left_anti")


def dedup_content(df: DataFrame, text: str, order: list[Column | str], history: DataFrame) -> DataFrame:
    """By digest of the text; history holds content_hash. Rows without text pass."""
    keyed = df.withColumn("content_hash", F.when(F.coalesce(F.col(text), F.lit("")) != "", digest(text)))
    first = dedup_first(keyed.filter("content_hash is not null"), "content_hash", order)
    return dedup_history(first, history, "content_hash").unionByName(keyed.filter("content_hash is null"))


def commit_history(history: DataFrame, succeeded: DataFrame) -> DataFrame:
    """Only rows that succeeded enter, so a failed row's fingerprint stays free."""
    return history.unionByName(succeeded.select(*history.columns)).distinct()


def dedup_title(df: DataFrame, source: str, title: str, order: list[Column]) -> DataFrame:
    """The best of each source and normalised title; rows with an empty key never collapse."""
    keyed = df.withColumn("_key", title_key(title))
    w = Window.partitionBy(source, "_key").orderBy(*order)
    first = keyed.filter("_key <> ''").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return first.unionByName(keyed.filter("coalesce(_key, '') = ''")).drop("_key")


def keep_latest(df: DataFrame, key: str | list[str], ts: str) -> DataFrame:
    """The latest time of each key, null lowest."""
    return df.groupBy(*([key] if isinstance(key, str) else key)).agg(F.max(ts).alias(ts))


def ordered_union(first: DataFrame, second: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The second list is added where unseen; the first ``most`` stay."""
    both = first.withColumn("_p", F.lit(0)).unionByName(second.withColumn("_p", F.lit(1)))
    return dedup_first(both, key, ["_p", order]).orderBy("_p", order).limit(most).drop("_p")


def same_multiset(a: Column, b: Column) -> Column:
    return F.array_sort(a).eqNullSafe(F.array_sort(b))
