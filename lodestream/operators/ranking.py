"""Ranking, capped selection and top-k. Every order ends in a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators.filters import small
from lodestream.sources.store import discard, written


def candidate_pool(df: DataFrame, source: str, order: list[Column], limit: int, initial: int) -> DataFrame:
    """The best ``limit`` of each source: the first ``initial`` selected, the rest deferred. The rank filter lets Spark cut groups before the shuffle."""
    w = Window.partitionBy(source).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).withColumn("pool", F.when(F.col("rank") <= initial, "selected").otherwise("deferred"))


def select_refill(deferred: DataFrame, gaps: DataFrame, category: str, order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(category).orderBy(*order)
    return deferred.join(small(gaps.select(category)), category).withColumn("refill_rank", F.row_number().over(w)).filter(F.col("refill_rank") <= k)


def select_top(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_outcomes(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """Each row with selected or excluded_by_capacity; only the k best are ranked in one task."""
    best = small(select_top(df, order, k).select(key, F.lit(True).alias("_in")))
    return df.join(best, key, "left").withColumn("outcome", F.when(F.col("_in"), "selected").otherwise("excluded_by_capacity")).drop("_in")


def select_capped(topics: DataFrame, group: str, order: list[Column], caps: dict[str, int], target: int, key: str) -> DataFrame:
    """Greedy choice in order under several caps (0: none), tested as listed, then the target: one outcome for each topic.

    Found in rounds of windows, with no group in one value. A row's verdict
    depends on how many earlier ones of its value were selected. A round counts, for
    each row, those known to be selected and those still open; a row is full if the
    selected alone reach the cap, and free if even all open ones before it wouldn't.
    The first open row of a group is always decided, and mostly all but a few are.
    """
    fields = [c for c in caps if caps[c] > 0]
    rows = topics.select(group, F.col(key).alias("_key"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_c_{c}") for c in fields), F.row_number().over(Window.partitionBy(group).orderBy(*order)).alias("_n"), F.lit(None).cast("string").alias("_done"))
    rows = written(rows, "caps")
    chosen, free = F.col("_done") == "selected", F.col("_done").isNull()
    within = lambda *by: Window.partitionBy(group, *by).orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    count = lambda what, w: F.coalesce(F.sum(what.cast("int")).over(w), F.lit(0))
    while True:
        marked = F.coalesce(chosen, F.lit(False))
        seen = rows
        for c in (*fields, None):
            w, name = within(*([f"_c_{c}"] if c else [])), c or "target"
            seen = seen.withColumn(f"_in_{name}", count(marked, w)).withColumn(f"_open_{name}", count(free, w))
        verdict, sure = None, F.lit(True)
        for c in (*fields, None):
            name, cap, reason = c or "target", caps[c] if c else target, f"{c}_cap" if c else "capacity"
            full, spare = F.col(f"_in_{name}") >= cap, F.col(f"_in_{name}") + F.col(f"_open_{name}") < cap
            # what comes before in the list must be known not to hold
            verdict = F.when(full, reason) if verdict is None else verdict.when(sure & full, reason)
            sure = sure & spare
        verdict = verdict.when(sure, "selected")
        new = written(seen.withColumn("_done", F.coalesce("_done", verdict)).select(*rows.columns), "caps")
        discard(rows)
        rows = new
        if not rows.filter(free).take(1):
            return rows.select(group, F.col("_key").alias(key), F.col("_done").alias("outcome"))


def display_order(df: DataFrame, category: str, order: list[str], score: str, key: str) -> DataFrame:
    at = F.array_position(F.array(*map(F.lit, order)), F.col(category))
    return df.withColumn("place", F.when(at == 0, len(order) + 1).otherwise(at)).orderBy("place", F.col(score).desc(), key)


def processing_limits(requests: DataFrame, start: str, end: str, limits: dict[str, tuple[int, ...]], names: tuple[str, ...]) -> DataFrame:
    """Period from the request, or weekly for spans of at most seven days counting both ends, else monthly; then its limits."""
    auto = F.when(F.datediff(end, start) + 1 <= 7, "weekly").otherwise("monthly")
    out = requests.withColumn("period", F.when(F.col("period").isin(*limits), F.col("period")).otherwise(auto))
    for i, n in enumerate(names):
        out = out.withColumn(n, F.element_at(F.create_map(*(x for p, v in limits.items() for x in (F.lit(p), F.lit(v[i])))), F.col("period")))
    return out


def round_robin(df: DataFrame, group: str, place: str, order: list[Column], k: int) -> DataFrame:
    """One of each group in turn, groups by ``place``, until k rows."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= k).orderBy("turn", place).limit(k)


def choose_variant(attempts: DataFrame, source: str, ordinal: str, count: str, least: str, error: str) -> DataFrame:
    """The first attempt that meets its minimum, else the largest, the first of equals; success, partial, failed or empty."""
    met = F.col(count) >= F.col(least)
    best = attempts.groupBy(source).agg(
        F.min(F.when(met & (F.col(count) > 0), F.struct(ordinal, count))).alias("_met"),
        F.max(F.struct(F.col(count).alias("n"), (-F.col(ordinal)).alias("o"))).alias("_most"),
        F.bool_or(F.col(error).isNotNull()).alias("_error"),
        F.bool_and(F.col(error).isNotNull()).alias("_all"),
    )
    status = F.when(F.col("_met").isNotNull(), "success").when(F.col("_most.n") > 0, "partial").when(F.col("_error"), "failed").otherwise("empty")
    return best.select(source, F.coalesce(f"_met.{ordinal}", -F.col("_most.o")).alias("chosen"), F.coalesce(f"_met.{count}", "_most.n").alias("n"), status.alias("status"))


def top_urls(df: DataFrame, source: str, ts: str, url: str, k: int) -> DataFrame:
    w = Window.partitionBy(source).orderBy(F.col(ts).desc_nulls_last(), url)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def breaker(pages: DataFrame, source: str, order: list[str], flag: str, n: int) -> DataFrame:
    """Once n flagged pages were seen of a source, later rows keep what the list had."""
    w = Window.partitionBy(source).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum(F.col(flag).cast("int")).over(w), F.lit(0))
    return pages.withColumn("use_detail", (seen < n) & ~F.col(flag))
