"""Counts, gaps, funnels and health of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distribution(df: DataFrame, key: str, default: str = "unknown") -> DataFrame:
    return df.groupBy(F.coalesce(F.nullif(F.col(key), F.lit("")), F.lit(default)).alias(key)).count()


def pool_stats(ranked: DataFrame, source: str, rank: str, limit: int, initial: int) -> DataFrame:
    n = F.col(rank)
    return ranked.groupBy(source).agg(F.count(F.lit(1)).alias("discovered"), F.count_if(n <= limit).alias("candidates"), (F.count(F.lit(1)) > limit).alias("cap_hit"), F.count_if(n <= initial).alias("initial"), F.count_if((n > initial) & (n <= limit)).alias("deferred"))


def category_gaps(df: DataFrame, category: str, catalogue: DataFrame, least: int) -> DataFrame:
    """``catalogue``: (category, ordinal) without the catch-all. Those with fewer rows than ``least``."""
    counts = df.groupBy(category).count()
    return catalogue.join(counts, category, "left").select(category, "ordinal", F.coalesce("count", F.lit(0)).alias("n")).filter(F.col("n") < least)


def coverage_gaps(df: DataFrame, category: str, source: str, catalogue: DataFrame, least: int, ratio: float) -> DataFrame:
    """Gaps; if there are none and one source has more than ``ratio`` of the rows, all categories by ascending count."""
    counts = catalogue.join(df.groupBy(category).count(), category, "left").select(category, "ordinal", F.coalesce("count", F.lit(0)).alias("n"))
    top = df.groupBy(source).count().agg((F.max("count") / F.sum("count")).alias("top"))
    short = counts.agg(F.count_if(F.col("n") < least).alias("short"))
    both = counts.join(F.broadcast(top.join(F.broadcast(short))))  # one row
    return both.filter((F.col("n") < least) | ((F.col("short") == 0) & (F.col("top") > ratio))).select(category, "ordinal", "n")


def funnel(df: DataFrame, stage: str, outcome: str, outcomes: list[str]) -> DataFrame:
    return df.groupBy(stage).agg(*(F.count_if(F.col(outcome) == o).alias(o) for o in outcomes), F.count(F.lit(1)).alias("total"))


def source_health(history: DataFrame, source: str, ts: str, status: str, n: str, tie: str) -> DataFrame:
    """Length of the present run of failures, last success, last count.

    The run is what comes after the last success, so two aggregations do what a
    running sum would, and heavy sources are reduced before the shuffle.
    """
    ok = F.col(status) == "success"
    at = F.struct(ts, tie)
    last = history.groupBy(source).agg(F.max(F.when(ok, at)).alias("_ok"), F.max(F.struct(ts, tie, n)).alias("_last"))
    joined = history.join(last, source)
    after = F.col("_ok").isNull() | (at > F.col("_ok"))
    return joined.groupBy(source).agg(F.count_if(after).alias("failures"), F.max(F.col(f"_ok.{ts}")).alias("last_success"), F.max(F.col(f"_last.{n}")).alias("last_count"))


def batch_status(outcomes: DataFrame, batch: str, ok: Column, error: Column, most: int = 50) -> DataFrame:
    """success, partial_success or failed, and the first errors in order."""
    out = outcomes.groupBy(batch).agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))
    status = F.when(F.col("failed") == 0, "success").when(F.col("succeeded") > 0, "partial_success").otherwise("failed")
    w = Window.partitionBy(batch).orderBy("_e")
    first = outcomes.filter(~ok).withColumn("_e", error).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)
    errors = first.groupBy(batch).agg(F.array_join(F.array_sort(F.collect_list("_e")), ";").alias("errors"))
    return out.withColumn("status", status).join(errors, batch, "left").withColumn("errors", F.coalesce("errors", F.lit("")))


def explode_counts(df: DataFrame, arr: str, name: str) -> DataFrame:
    return df.select(F.explode(arr).alias(name)).groupBy(name).count()


def pool_counts(df: DataFrame, source: str, limit: int, initial: int) -> DataFrame:
    """As pool_stats, for pools that rank every row: counts tell it, without ranks."""
    n = F.col("discovered")
    kept = lambda most: F.least(n, F.lit(most))
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("discovered")).select(source, "discovered", kept(limit).alias("candidates"), (n > limit).alias("cap_hit"), kept(initial).alias("initial"), F.greatest(kept(limit) - initial, F.lit(0)).alias("deferred"))


def run_summary(runs: DataFrame, status: str, source: str, n: str, enough: int) -> DataFrame:
    """Of each status: sources, articles, runs with enough of them."""
    return runs.groupBy(status).agg(F.countDistinct(source).alias("sources"), F.sum(n).alias("articles"), F.count_if(F.col(n) >= enough).alias("with_content"))


def probe_summary(probes: DataFrame, source: str, reachable: Column, said: str) -> DataFrame:
    """Of each source: probes, how many reached it, and what the others said."""
    bad = F.array_join(F.array_sort(F.collect_set(F.when(~reachable, F.col(said)))), ",")
    return probes.groupBy(source).agg(F.count(F.lit(1)).alias("probes"), F.count_if(reachable).alias("reachable"), F.nullif(bad, F.lit("")).alias("bad"))


def corroborated(df: DataFrame, topic: str, source: str, least: int) -> DataFrame:
    """Topics that at least so many sources carry, with their number and names in order."""
    names = F.array_sort(F.collect_set(source))
    return df.groupBy(topic).agg(names.alias("s")).filter(F.size("s") >= least).select(topic, F.size("s").cast("long").alias("n"), F.array_join("s", ",").alias("sources"))


def share(df: DataFrame, group: str, inside: Column) -> DataFrame:
    """The share of rows inside, four decimals; 0 where there is none to tell."""
    return df.groupBy(group).agg(F.coalesce(F.round(F.avg(inside.cast("int")), 4), F.lit(0.0)).alias("share"))


def reason_counts(df: DataFrame, reason: str, fine: str = "success") -> DataFrame:
    return df.filter(F.col(reason) != fine).groupBy(reason).count()


def operation_metrics(df: DataFrame, batch: str, scored: Column, chosen: Column, category: str) -> DataFrame:
    """Of each batch: rows collected, scored and chosen, and categories."""
    return df.groupBy(batch).agg(F.count(F.lit(1)).alias("l1"), F.count_if(scored).alias("l2"), F.count_if(chosen).alias("l3"), F.countDistinct(category).alias("categories"))


def operation_maps(df: DataFrame, batch: str, stages: dict[str, Column], by: list[str]) -> DataFrame:
    """Of each batch: how many rows each stage has, and maps of their counts by each column of ``by`` ('unknown' where it is empty), keys in order.

    Counted by value first, so a map is made of as many rows as it has keys.
    """
    out = df.groupBy(batch).agg(*(F.count_if(c).alias(f"{s}_count") for s, c in stages.items()))
    for column in by:
        value = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("unknown"))
        counts = df.groupBy(batch, value.alias("_v")).agg(*(F.count_if(c).alias(s) for s, c in stages.items()))
        made = counts.groupBy(batch).agg(*(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(s) > 0, F.struct("_v", s))))).alias(f"{s}_by_{column}") for s in stages))
        out = out.join(made, batch)
    return out


def never_less(df: DataFrame, group: str, stored: Column, name: str = "n") -> DataFrame:
    """A count that a later import can't shrink: the stored one, or the rows there are."""
    return df.groupBy(group).agg(F.greatest(F.max(stored), F.count(F.lit(1))).alias(name))
