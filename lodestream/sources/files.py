"""Scans of sitemaps and search answers, and snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def read_sitemap(spark: SparkSession, path: str, most_bytes: int = 10_000_000) -> DataFrame:
    """(kind, loc, lastmod, file); files that are too large or declare entities are left out."""
    raw = spark.read.format("binaryFile").load(path)
    bad = raw.filter((F.col("length") > most_bytes) | F.upper(F.substring(F.col("content"), 1, 2000).cast("string")).rlike("<!(DOCTYPE|ENTITY)")).select(F.regexp_replace("path", "^file:/+", "/").alias("bad"))
    kinds = [spark.read.schema("loc string, lastmod string").format("xml").option("rowTag", t).load(path).select(F.lit(k).alias("kind"), F.trim("loc").alias("loc"), F.col("lastmod").try_cast("timestamp_ntz").alias("lastmod"), F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("file")) for t, k in (("url", "page"), ("sitemap", "index"))]
    both = reduce(DataFrame.unionByName, kinds)
    return both.join(bad, F.col("file") == F.col("bad"), "left_anti").filter("loc is not null")


def flatten_search(df: DataFrame, payload: str) -> DataFrame:
    """Three shapes of an answer (a list, ``results``, ``webPages.value``) as rows: position, url, title, snippet, date."""
    item = "array<struct<url:string,link:string,title:string,name:string,snippet:string,description:string,date:string,published:string,datePublished:string>>"
    v = F.try_parse_json(payload)
    found = F.coalesce(F.from_json(F.when(F.startswith(F.ltrim(payload), F.lit("[")), F.col(payload)), item), F.from_json(F.to_json(F.try_variant_get(v, "$.results", "variant")), item), F.from_json(F.to_json(F.try_variant_get(v, "$.webPages.value", "variant")), item))
    rows = df.select("*", F.posexplode(found).alias("position", "r"))
    first = lambda *names: F.coalesce(*(F.nullif(F.col(f"r.{n}"), F.lit("")) for n in names))
    return rows.withColumns({"url": first("url", "link"), "title": first("title", "name"), "snippet": first("snippet", "description"), "date": first("date", "published", "datePublished")}).drop("r").filter("url is not null")


BATCH_NUMBER = r"[A-Za-z0-9._-]+"


def write_snapshot(df: DataFrame, root: str, batch_no: str, order: str, created_at: str | None = None) -> None:
    """The last row of each url_hash under the batch's partition, which is replaced, and a header row with the time (now, if none is given)."""
    from lodestream.operators.dedup import dedup_first

    last = dedup_first(df, "url_hash", [F.col(order) * -1])
    spark = df.sparkSession
    last.withColumn("batch_no", F.lit(batch_no)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_no").parquet(f"{root}/articles")
    made = spark.read.parquet(f"{root}/articles").filter(F.col("batch_no") == batch_no)
    created = F.lit(created_at).cast("timestamp") if created_at else F.current_timestamp()
    head = made.agg(F.count(F.lit(1)).alias("article_count")).select(F.lit(batch_no).alias("batch_no"), "article_count", created.alias("created_at"))
    head.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_no").parquet(f"{root}/headers")


def read_snapshot(spark: SparkSession, root: str, batch_no: str | None = None) -> DataFrame:
    """A named batch, or the one made last of those whose number starts with COL-; of equal times, the last by number."""
    import re

    if batch_no is not None:
        batch_no = batch_no.removesuffix(".json")
        if not re.fullmatch(BATCH_NUMBER, batch_no):
            raise ValueError("batch numbers hold letters, digits, and . _ -")
    else:
        heads = spark.read.parquet(f"{root}/headers").filter("batch_no LIKE 'COL-%'")
        batch_no = heads.agg(F.max(F.struct("created_at", "batch_no")).alias("h")).first()["h"]["batch_no"]
    return spark.read.parquet(f"{root}/articles").filter(F.col("batch_no") == batch_no)


def list_snapshots(headers: DataFrame, created: str, batch: str, limit: int) -> DataFrame:
    return headers.orderBy(F.col(created).desc(), F.col(batch).desc()).limit(max(1, min(500, limit)))


def merge_snapshots(df: DataFrame, key: str, created: str, keep: str = "newest") -> DataFrame:
    """One row of each key over all batches. ``created`` is a number or time that orders batches."""
    rest = [c for c in df.columns if c != key]
    pick = (F.max if keep == "newest" else F.min)(F.struct(created, *(c for c in rest if c != created)))
    return df.groupBy(key).agg(pick.alias("_r")).select(key, "_r.*").select(*df.columns)


def quarantine(df: DataFrame, reason: str, path: str) -> None:
    """Rows that couldn't be sent, by batch, kept for replay."""
    df.withColumn("reason", F.lit(reason)).write.mode("append").partitionBy("batch_no").parquet(path)


def source_catalog(df: DataFrame, enabled: Column, role: dict[str, Column], default: str) -> DataFrame:
    """Sources in use, with the role of the first rule that holds."""
    out = None
    for name, rule in role.items():
        out = F.when(rule, name) if out is None else out.when(rule, name)
    return df.filter(enabled).withColumn("role", F.lit(default) if out is None else out.otherwise(default))


def audit_rows(analysed: DataFrame, discarded: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """What became of each article: analyzed, or discarded for its ``reason``; and whether it was chosen."""
    both = analysed.select(key, F.lit("analyzed").alias("disposition"), F.lit(None).cast("string").alias("reason")).unionByName(discarded.select(key, F.lit("discarded").alias("disposition"), "reason"))
    marks = chosen.select(key).distinct().withColumn("l3", F.lit(True))
    return both.join(marks, key, "left").select(key, "disposition", "reason", F.coalesce("l3", F.lit(False)).alias("l3"))


def deferred_status(deferred: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """Deferred candidates, and those of them that a refill took."""
    marks = taken.select(key).distinct().withColumn("_taken", F.lit(True))
    return deferred.join(marks, key, "left").withColumn("status", F.when(F.col("_taken"), "refill_selected").otherwise("deferred")).drop("_taken")


def hydrate(candidates: DataFrame, pages: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """Candidates with what their page says, by ``key``; ``fields`` stand in where there is no page or it lacks them."""
    page = pages.select(key, *(F.col(c).alias(f"_page_{c}") for c in fields))
    out = candidates.join(page, key, "left")
    return out.withColumns({c: F.coalesce(f"_page_{c}", other) for c, other in fields.items()}).drop(*(f"_page_{c}" for c in fields))


def expand_plans(sources: DataFrame, variants: DataFrame, defaults: dict[str, str], override: Column) -> DataFrame:
    """A row for each source and variant in order, its options the defaults with the source's override on top.

    ``variants``: a configuration table (variant_no, variant).
    """
    plans = sources.join(variants.hint("broadcast" if variants.limit(1001).count() <= 1000 else "merge"))
    held = F.create_map(*(F.lit(x) for pair in defaults.items() for x in pair))
    merged = F.map_zip_with(held, F.coalesce(override, F.create_map().cast("map<string,string>")), lambda k, a, b: F.coalesce(b, a))
    return plans.withColumn("options", merged)


def search_queries(df: DataFrame, category: str, site: str, terms: str, after: Column | None = None, before: Column | None = None, most: int = 8) -> DataFrame:
    """A query of each category: its terms, at most so many site clauses in order, and the dates where given."""
    sites = F.transform(F.slice(F.array_sort(F.collect_set(site)), 1, most), lambda s: F.concat(F.lit("site:"), s))
    words = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(terms)))), " ")
    out = df.groupBy(category).agg(words.alias("words"), sites.alias("sites"))
    clause = F.when(F.size("sites") > 0, F.concat(F.lit("("), F.array_join("sites", " OR "), F.lit(")")))
    dates = [F.concat(F.lit(f"{name}:"), F.date_format(c, "yyyy-MM-dd")) for name, c in (("after", after), ("before", before)) if c is not None]
    return out.select(category, F.concat_ws(" ", F.nullif("words", F.lit("")), clause, *dates).alias("query"))


def sitemap_candidates(rows: DataFrame, source: str, start: Column, end: Column, rules: DataFrame | None, allowed: Column, most: int) -> DataFrame:
    """Sitemap rows (``source``, loc, lastmod) as candidates: hosts that are allowed, robots rules, dates in range or none, article URLs
    without tracking parameters, the newest time of each, and the newest so many of each source."""
    from lodestream.functions import urls
    from lodestream.operators.dedup import keep_latest
    from lodestream.operators.filters import date_filter, host_allowed, robots_filter
    from lodestream.operators.ranking import top_urls

    kept = date_filter(rows.select(source, urls.strip_tracking("loc").alias("url"), F.col("lastmod")).filter(host_allowed(F.col("url"), allowed)), "lastmod", start, end)
    kept = kept.filter(urls.looks_like_article("url"))
    if rules is not None:
        kept = robots_filter(kept, "url", rules)
    return top_urls(keep_latest(kept, [source, "url"], "lastmod"), source, "lastmod", "url", most).select(source, "url", "lastmod")
