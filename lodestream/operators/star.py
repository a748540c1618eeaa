"""Joins over the persistent tables: lookups, upserts by key, links and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions import scores
from lodestream.operators.dedup import dedup_first
from lodestream.operators.filters import small
from lodestream.sources.store import written


def with_source(df: DataFrame, sources: DataFrame, key: str = "source_code") -> DataFrame:
    return df.join(small(sources), key, "left")


def resolve_source(df: DataFrame, sources: DataFrame, default: int = 1) -> DataFrame:
    return df.join(small(sources.select("source_code", "source_id")), "source_code", "left").withColumn("source_id", F.coalesce("source_id", F.lit(default)))


def latest_batch(batches: DataFrame, relations: DataFrame, selected: bool = False) -> DataFrame:
    """The newest successful batch that has (selected) relations: no row or one."""
    linked = relations.filter("selected") if selected else relations
    return batches.filter("status = 'success'").join(linked, "batch_id", "left_semi").orderBy(F.col("batch_id").desc()).limit(1)


def resolve_batch(requests: DataFrame, batches: DataFrame) -> DataFrame:
    found = requests.join(batches.select("batch_no", "status"), "batch_no", "left")
    return found.withColumn("outcome", F.when(F.col("status").isNull(), "not_found").when(F.col("status") != "success", "not_success").otherwise("ok"))


def upsert(existing: DataFrame, incoming: DataFrame, key: str, fill: list[str], empty_counts: list[str] = ()) -> DataFrame:
    """Old rows keep their values; columns in ``fill`` are taken from the new row where null (or empty). One row each, with what happened."""
    old, new = existing.alias("old"), incoming.alias("new")
    gap = {c: F.col(f"old.{c}").isNull() | ((F.col(f"old.{c}") == "") if c in empty_counts else F.lit(False)) for c in fill}
    known = F.col(f"old.{key}").isNotNull()
    out = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    columns = [F.coalesce(f"old.{key}", f"new.{key}").alias(key)]
    for c in existing.columns:
        if c != key:
            columns.append((F.when(known & ~gap[c], F.col(f"old.{c}")).otherwise(F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}"))) if c in fill else F.when(known, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}"))).alias(c))
    filled = F.array_compact(F.array(*(F.when(known & gap[c] & F.col(f"new.{c}").isNotNull(), c) for c in fill)))
    seen = F.col(f"new.{key}").isNotNull()
    return out.select(*columns, F.when(known & seen, "duplicate_skipped").when(seen, "imported").otherwise("unchanged").alias("outcome"), F.when(seen, filled).otherwise(F.array().cast("array<string>")).alias("filled"))


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new, keys, "left_anti").unionByName(new)


def link_by_hash(rows: DataFrame, known: DataFrame, key: str = "url_hash") -> tuple[DataFrame, DataFrame]:
    """(linked rows with article_id, failures with their reason)."""
    return rows.join(known.select(key, "article_id"), key), rows.join(known, key, "left_anti").withColumn("reason", F.lit("article_not_found"))


def tag_rules(df: DataFrame, text: Column, rules: DataFrame) -> DataFrame:
    """``rules``: source_code, alias, keywords. Adds the ordered aliases whose rule names the source and hits the text."""
    keyed = df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_text", F.lower(text))
    hits = keyed.select("_row", "source_code", "_text").join(small(rules), "source_code").filter(F.exists("keywords", lambda k: F.contains("_text", k)))
    tags = hits.groupBy("_row").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    return keyed.join(tags.hint("merge"), "_row", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>"))).drop("_row", "_text")


def overlay_outcomes(selection: DataFrame, execution: DataFrame, key: str) -> DataFrame:
    """A later execution result takes the place of ``selected``."""
    later = execution.select(key, F.col("outcome").alias("_later"))
    return selection.join(later, key, "left").withColumn("outcome", F.when((F.col("outcome") == "selected") & F.col("_later").isNotNull(), F.col("_later")).otherwise(F.col("outcome"))).drop("_later")


def attach_responses(requests: DataFrame, responses: DataFrame, keys: list[str]) -> DataFrame:
    return requests.join(responses, keys, "left").withColumn("answered", F.col("content").isNotNull())


def numbered(df: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """A global row number without a single-task window: range partitions, numbers within, offsets from counts.

    The rows are written once with the number of their range, as ranges that are
    dealt anew may differ. The sort key must be total. Nulls sort as ``order``
    says; an empty table gives no row.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = placed.groupBy("_part").count()
    # one row for each partition
    offsets = counts.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.withColumn("_within", within).join(small(offsets), "_part").withColumn(name, F.col("_within") + F.col("_before")).drop("_part", "_within", "_before")


def numbered_within(df: DataFrame, group: str, order: list[Column], name: str = "n") -> DataFrame:
    """Row numbers from 1 within each group, as ``numbered`` gives them: a group of any size is dealt to many tasks."""
    rows = written(numbered(df, [F.col(group), *order], "_n"), "numbered")
    first = rows.groupBy(F.col(group).alias("_g")).agg(F.min("_n").alias("_first"))
    return rows.join(first.hint("merge"), F.col(group).eqNullSafe(F.col("_g"))).withColumn(name, F.col("_n") - F.col("_first") + 1).drop("_n", "_g", "_first")


def batch_report(articles: DataFrame, analyses: DataFrame, batch: DataFrame, least: float = 6.0) -> DataFrame:
    """Rows of a report: successful analyses of the batch with their article, the score with its fallback, a yes or no for deep ones that score enough."""
    rows = analyses.filter("status = 'success'").join(small(batch.select("batch_id")), "batch_id").join(articles.select("article_id", "title"), "article_id")
    score = scores.score_or("rank", "trend")
    return rows.select("article_id", "title", "category", score.alias("score"), F.when((score >= least) & F.col("deep"), "是").otherwise("否").alias("selected"))


def briefing_candidates(relations: DataFrame, batches: DataFrame, articles: DataFrame, analyses: DataFrame, sources: DataFrame, start: Column, end: Column) -> DataFrame:
    """Selected relations with batch, article, analysis and source, the batch's time within the range. Columns of all five stay."""
    inside = batches.filter(F.col("batch_time").between(start, end))
    rows = relations.filter("selected").join(inside, "batch_id").join(articles, "article_id")
    return rows.join(analyses, "analysis_id").join(sources, "source_id")


def target_batch(batches: DataFrame, relations: DataFrame, batch_no: str | None = None) -> DataFrame:
    """(batch_id): the last successful batch, by number, that has relations; or the one named, under the same conditions. At most one row."""
    good = batches.filter(F.col("status") == "success")
    if batch_no:
        good = good.filter(F.col("batch_no") == batch_no)
    return good.join(relations.select("batch_id").distinct(), "batch_id", "left_semi").agg(F.max("batch_id").alias("batch_id")).filter("batch_id is not null")


def detail_text(detail: str, field: str) -> Column:
    """A text in a JSON column; null where the JSON is broken, lacks it, or holds an empty text."""
    return F.nullif(F.try_variant_get(F.try_parse_json(detail), f"$.{field}", "string"), F.lit(""))


def star_report(batches: DataFrame, relations: DataFrame, articles: DataFrame, analyses: DataFrame, insights: DataFrame, batch_no: str | None = None, least: float = 6.0) -> DataFrame:
    """The numbered report of one batch: its relations with article and successful analysis, and the insight where there is a successful one of the batch.

    ``relations``: batch_id, article_id, analysis_id, insight_id, chosen. The
    score is the rank score, else the value score; a row is selected ('是') if it
    scores ``least``, was chosen and has an insight. Reasons come from the JSON
    column ``detail``, empty ones as null. Order: score and time down (null last),
    then article_id. Without such a batch there is no row.
    """
    target = F.broadcast(target_batch(batches, relations, batch_no))  # one row at most
    ours = lambda df: df.join(target, "batch_id")
    told = ours(insights.filter(F.col("status") == "success").select("batch_id", "insight_id")).select("insight_id", F.lit(True).alias("told"))
    fields = [c for c in analyses.columns if c not in ("batch_id", "status", "article_id")]
    rows = ours(relations).join(ours(analyses.filter(F.col("status") == "success")).select(*fields), "analysis_id").join(articles.select("article_id", "title", "publish_time"), "article_id").join(told, "insight_id", "left")
    score = F.coalesce("rank_score", "value_score")
    rows = rows.withColumn("score", score).withColumn("selected", F.when((score >= least) & F.col("chosen") & F.col("told"), "是").otherwise("否"))
    rows = rows.withColumns({f: detail_text("detail", f) for f in REASONS})
    return numbered(rows.select("article_id", "title", "publish_time", "category", *REASONS, "score", "selected"), [F.col("score").desc_nulls_last(), F.col("publish_time").desc_nulls_last(), F.col("article_id")])


REASONS = ("org_relevance_reason", "trend_reason")


def star_briefing(batch_id: int, relations: DataFrame, articles: DataFrame, analyses: DataFrame, insights: DataFrame, sources: DataFrame, start: Column, end: Column, aliases: dict[str, str], other: str) -> DataFrame:
    """Candidates of a briefing: chosen relations of one batch with article (its time within the range), source, successful analysis and successful insight of that batch.

    The title is the one in the analysis' detail, else the article's, which also
    stays as original_title; a category has its alias, and ``other`` where there is none.
    """
    of = lambda df: df.filter(F.col("batch_id") == batch_id)
    good = lambda df: of(df).filter(F.col("status") == "success").drop("batch_id", "status")
    inside = articles.filter(F.col("publish_time").between(start, end)).select("article_id", "source_id", F.col("title").alias("original_title"), "url", "publish_time")
    rows = of(relations).filter("chosen").select("article_id", "analysis_id", "insight_id").join(inside, "article_id").join(good(analyses).drop("article_id"), "analysis_id").join(good(insights).drop("article_id"), "insight_id").join(sources, "source_id")
    named = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair)), F.col("category")), F.nullif("category", F.lit("")), F.lit(other))
    title = F.coalesce(F.nullif(F.trim(detail_text("detail", "title_cn")), F.lit("")), F.col("original_title"))
    return rows.withColumns({"title": title, "category": named, "score": F.coalesce("rank_score", "value_score", F.lit(0.0))}).drop("detail", "rank_score", "value_score")


def link_selected(relations: DataFrame, insights: DataFrame, keys: list[str]) -> DataFrame:
    """Relations with ``selected``: an insight of the same keys exists."""
    marks = insights.select(*keys).distinct().withColumn("_has", F.lit(True))
    return relations.join(marks, keys, "left").withColumn("selected", F.coalesce("_has", F.lit(False))).drop("_has")


def upsert_links(old: DataFrame, new: DataFrame, keys: list[str], counts: list[str] = ()) -> DataFrame:
    """New links take the place of old ones with the same keys; the columns in ``counts`` never shrink."""
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("_new", F.lit(1)))
    newest = [F.max_by(c, "_new").alias(c) if c not in counts else F.max(c).alias(c) for c in rest]
    return both.groupBy(*keys).agg(*newest).select(*old.columns)


def import_batch(star: dict[str, DataFrame], payload: dict[str, DataFrame], batch_no: str) -> dict[str, DataFrame]:
    """One delivery into the star: articles, analyses, insights, links and the batch's row. A batch that succeeded before changes nothing.

    ``star``: articles (url_hash, article_id, author, publish_time, crawl_time, title), analyses and insights (batch_no,
    article_id, ...), links (batch_no, article_id, analysed, selected), batches (batch_no, status, article_count,
    success_count, failed_count). ``payload``: articles without article_id, analyses and insights with url_hash in its place.
    Rows whose article is unknown are failures, counted in the batch. An article_id is the hash of its url_hash.
    """
    if star["batches"].filter((F.col("batch_no") == batch_no) & (F.col("status") == "success")).take(1):
        return star
    incoming = payload["articles"].withColumn("article_id", F.xxhash64("url_hash")).select(*star["articles"].columns)
    incoming = dedup_first(incoming, "url_hash", [F.xxhash64(*incoming.columns)])
    outcome = written(upsert(star["articles"], incoming, "url_hash", ["publish_time", "crawl_time", "author"], ["author"]), "articles")
    articles = outcome.select(*star["articles"].columns)
    made, failed = {}, []
    for name in ("analyses", "insights"):
        linked, lost = link_by_hash(payload[name].withColumn("batch_no", F.lit(batch_no)), articles.select("url_hash", "article_id"))
        linked = linked.select(*star[name].columns)
        made[name] = dedup_first(linked, ["batch_no", "article_id"], [F.xxhash64(*linked.columns)])
        failed.append(lost.select("url_hash"))
    seen = outcome.filter("outcome <> 'unchanged'").select("article_id")
    marks = seen.select(F.lit(batch_no).alias("batch_no"), "article_id").join(made["analyses"].select("article_id", F.lit(True).alias("analysed")), "article_id", "left").withColumn("analysed", F.coalesce("analysed", F.lit(False)))
    links = link_selected(marks, made["insights"], ["article_id"]).select(*star["links"].columns)
    n = seen.agg(F.count(F.lit(1)).alias("article_count")).join(made["analyses"].agg(F.count(F.lit(1)).alias("success_count")).hint("broadcast")).join(failed[0].unionByName(failed[1]).agg(F.count(F.lit(1)).alias("failed_count")).hint("broadcast"))  # one row each
    status = F.when(F.col("failed_count") == 0, "success").when(F.col("success_count") > 0, "partial_success").otherwise("failed")
    row = n.select(F.lit(batch_no).alias("batch_no"), status.alias("status"), "article_count", "success_count", "failed_count").select(*star["batches"].columns)
    return {
        "articles": articles,
        "analyses": replace_by_key(star["analyses"], made["analyses"], ["batch_no", "article_id"]),
        "insights": replace_by_key(star["insights"], made["insights"], ["batch_no", "article_id"]),
        "links": upsert_links(star["links"], links, ["batch_no", "article_id"]),
        "batches": upsert_links(star["batches"], row, ["batch_no"], ["article_count"]),
    }


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
