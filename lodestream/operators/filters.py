"""Row filters and flags. Each takes and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions import urls
from lodestream.functions.text import any_in

#: Configuration tables of more rows than this are joined by a shuffle.
SMALL_ROWS = 100_000


def small(config: DataFrame) -> DataFrame:
    """A configuration table for a join: broadcast behind a check of its size, else shuffled."""
    return config.hint("broadcast" if config.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else "merge")


def date_filter(df: DataFrame, ts: str, start: Column, end: Column, undated: str = "keep") -> DataFrame:
    return df.filter(F.coalesce(F.col(ts).between(start, end), F.lit(undated == "keep")))


def date_filter_stats(df: DataFrame, ts: str, start: Column, end: Column) -> DataFrame:
    inside = F.col(ts).between(start, end)
    return df.agg(F.count_if(inside).alias("in_range"), F.count_if(~inside).alias("out_of_range"), F.count_if(F.col(ts).isNull()).alias("unresolved"))


def sufficient(df: DataFrame, body: str, summary: str, title: str, least: int) -> DataFrame:
    """Enough text; and where there is no body, a text that isn't just the title."""
    own = F.trim(F.coalesce(F.col(body), F.lit("")))
    content = F.when(own != "", own).otherwise(F.trim(F.coalesce(F.col(summary), F.lit(""))))
    return df.filter((F.length(content) >= least) & ((own != "") | (content != F.trim(F.coalesce(F.col(title), F.lit(""))))))


def flag_discard(df: DataFrame, category: str, score: str, catch_all: str, most: float = 5.0) -> DataFrame:
    return df.withColumn("discarded", (F.coalesce(F.col(category), F.lit("")) == catch_all) & (F.coalesce(F.col(score).try_cast("double"), F.lit(0.0)) <= most))


def title_ok(title: Column, blocked: list[str], include: Column, exclude: Column) -> Column:
    """``include`` and ``exclude``: lists of keywords of the source; null or empty tells nothing."""
    t = F.trim(F.coalesce(title, F.lit("")))
    low = F.lower(t)
    hit = lambda words: F.coalesce(F.exists(words, lambda k: F.contains(low, F.lower(k))), F.lit(False))
    return (F.length(t) >= 6) & ~t.isin(*blocked) & ~hit(exclude) & ((F.coalesce(F.size(include), F.lit(0)) <= 0) | hit(include))


def host_allowed(url: Column, allowed: Column) -> Column:
    """Any allowed text occurs in the host; an empty list passes."""
    return (F.size(allowed) <= 0) | F.exists(allowed, lambda a: F.contains(urls.host(url), F.lower(a)))


def match_source(df: DataFrame, url: str, sources: DataFrame) -> DataFrame:
    """Adds source_code of the first source (by ordinal) whose domain is the host or a parent of it: an equi-join on host endings."""
    labels = F.split(urls.bare_host(url), r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keyed = df.withColumn("_row", F.monotonically_increasing_id())
    found = keyed.select("_row", F.explode(endings).alias("domain")).join(small(sources.select(F.lower("domain").alias("domain"), "ordinal", "source_code")), "domain")
    first = found.groupBy("_row").agg(F.min_by("source_code", "ordinal").alias("source_code"))
    return keyed.join(first.hint("merge"), "_row", "left").drop("_row")


def robots_filter(df: DataFrame, url: str, rules: DataFrame) -> DataFrame:
    """Drops rows whose first matching rule (origin, rule_no, allow, path_prefix) disallows them; no rule allows."""
    each = df.select(F.col(url).alias("_url"), urls.origin(url).alias("origin"), urls.path(url).alias("_path")).distinct()
    hits = each.join(small(rules), "origin").filter(F.startswith("_path", "path_prefix"))
    verdict = hits.groupBy("_url").agg(F.min_by("allow", "rule_no").alias("allow")).filter(~F.col("allow"))
    return df.join(verdict.hint("merge"), F.col(url) == F.col("_url"), "left_anti")


def page_flags(df: DataFrame, text: str, markers: list[str], shells: list[str], least: int) -> DataFrame:
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    return df.withColumn("challenge", any_in(low, markers)).withColumn("shell", (F.length(F.trim(low)) < least) | any_in(low, shells))


def drop_unrelated(df: DataFrame, flag: str) -> DataFrame:
    """Only an explicit false goes."""
    return df.filter(~F.col(flag).eqNullSafe(F.lit(False)))


def eligibility(df: DataFrame, score: str, body: str, triggered: str, least: float, least_chars: int, require_full: bool = True) -> DataFrame:
    short = F.length(F.trim(F.coalesce(F.col(body), F.lit("")))) < least_chars
    reason = F.when(F.col(score).isNull(), "missing_score").when(F.col(score) < least, "below_threshold")
    if require_full:
        reason = reason.when(short, "no_full_content")
    return df.withColumn("reason", reason.when(~F.coalesce(F.col(triggered), F.lit(False)), "not_triggered").otherwise("eligible"))


def check_contract(df: DataFrame, required: list[str], scores: list[str], counts: list[str]) -> DataFrame:
    """Adds ``errors``: codes of the broken rules of each row, as data."""
    rules = [F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", f"missing_{c}") for c in required]
    rules += [F.when(~F.col(c).between(0, 10), f"range_{c}") for c in scores]
    rules += [F.when(F.col(c) < 0, f"negative_{c}") for c in counts]
    return df.withColumn("errors", F.array_compact(F.array(*rules)))


def map_select(c: Column, keys: list[str]) -> Column:
    return F.map_filter(c, lambda k, _: k.isin(*keys))


def content_type_ok(c: Column, allowed: list[str]) -> Column:
    kind = F.lower(F.trim(F.split_part(F.coalesce(c, F.lit("")), F.lit(";"), F.lit(1))))
    return (kind == "") | kind.isin(*allowed)


def needs_routing(explicit: Column, *lists: Column) -> Column:
    """A source's flag where it is set; else whether any of its keyword lists has entries."""
    some = F.lit(False)
    for held in lists:
        some = some | F.coalesce(F.size(held) > 0, F.lit(False))
    return F.coalesce(explicit, some)


def import_rows(df: DataFrame, kind: str, tags: dict[str, Column] | None = None) -> DataFrame:
    """Rows of a stage as the import takes them: digests, no null text, and lists only."""
    from lodestream.functions.text import digest

    empty = F.array().cast("array<string>")
    lists = {name: F.coalesce(c, empty) for name, c in (tags or {}).items()}
    if kind == "article":
        return df.withColumns({"url_hash": digest("url"), "raw_summary": F.coalesce("summary", F.lit("")), **lists}).select("ingest_seq", "url_hash", "title", "raw_summary", *lists)
    return df.withColumns({"url_hash": digest("url"), **lists})
