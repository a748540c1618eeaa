"""Report sections, assembly and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions.text import first_sentence, table_cell


def lines(rows: DataFrame, by: str, order: list[str], line: Column, name: str, head: str = "", sep: str = "\n") -> DataFrame:
    """One text for each ``by``: the lines in order below a head."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))), lambda x: x["_line"]), sep)
    return rows.groupBy(by).agg(F.concat(F.lit(head), text).alias(name))


def topic_material(rows: DataFrame, by: str, order: list[str], title: str, body: str) -> DataFrame:
    return lines(rows, by, order, F.concat_ws("\n", F.concat(F.lit("## "), F.col(title)), F.substring(F.coalesce(body, F.lit("")), 1, 300)), "material", sep="\n\n")


def overview(rows: DataFrame, by: str, order: list[str], title: str, body: str) -> DataFrame:
    return lines(rows, by, order, F.concat(F.lit("- "), F.col(title), F.lit(": "), first_sentence(body)), "overview")


def source_index(rows: DataFrame, by: str, order: list[str], title: str, source: str, ts: str) -> DataFrame:
    day = F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit("unknown"))
    return lines(rows, by, order, F.concat(F.lit("| "), table_cell(title), F.lit(" | "), table_cell(source), F.lit(" | "), day, F.lit(" |")), "index", "| title | source | date |\n| --- | --- | --- |\n")


def assemble(parts: DataFrame, by: str, place: str, text: str) -> DataFrame:
    """Parts in order, empty ones dropped, an empty line between."""
    kept = parts.filter(F.coalesce(F.trim(text), F.lit("")) != "")
    return lines(kept, by, [place], F.trim(F.col(text)), "report", sep="\n\n")


def check_sections(sections: DataFrame, text: str, heading: Column, ids: Column, links: Column) -> DataFrame:
    """Error codes: heading missing, marks that aren't just the expected ones, a topic without its link."""
    marks = F.array_sort(F.regexp_extract_all(F.col(text), F.lit(r"\[\[(\d+)\]\]"), F.lit(1)))
    rules = [F.when(~F.contains(F.col(text), heading), "heading_missing"), F.when(~marks.eqNullSafe(F.array_sort(ids)), "marks_differ"), F.when(F.exists(links, lambda u: ~F.contains(F.col(text), u)), "link_missing")]
    return sections.withColumn("errors", F.array_compact(F.array(*rules)))


def check_report(sections: DataFrame, by: str) -> DataFrame:
    return sections.groupBy(by).agg(F.bool_and(F.size("errors") == 0).alias("ok"), F.sum(F.size("errors")).alias("n_errors"))


def topic_index(members: DataFrame, by: str, topic: str, order: list[str], title: str, source: str, ts: str, url: str) -> DataFrame:
    """The source index of a report: a line for each topic with its first member's title, source, date and link, and the sources of the others in order ('-' if none)."""
    cols = F.struct(*order, F.col(title).alias("_title"), F.col(source).alias("_source"), F.col(ts).alias("_ts"), F.col(url).alias("_url"))
    held = members.groupBy(by, topic).agg(F.array_sort(F.collect_list(cols)).alias("m"))
    others = F.array_join(F.transform(F.slice("m", 2, 2**31 - 2), lambda x: x["_source"]), "、")
    first = F.col("m")[0]
    day = F.coalesce(F.date_format(first["_ts"], "yyyy-MM-dd"), F.lit("日期未知"))
    cells = [table_cell(first["_title"]), table_cell(first["_source"]), table_cell(F.coalesce(F.nullif(others, F.lit("")), F.lit("-"))), day, F.concat(F.lit("[原文]("), F.coalesce(first["_url"], F.lit("")), F.lit(")"))]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return lines(held.select(by, topic, line.alias("_text")), by, [topic], F.col("_text"), "index", "| 主题 | 主来源 | 补充来源 | 发布日期 | 链接 |\n|---|---|---|---|---|\n")


def report_counts(members: DataFrame, contents: DataFrame, by: str, topic: str, order: list[str], title: str, category: str, url: str) -> DataFrame:
    """A report's text against its topics: how many stand in the overview, the body (marks ``[[topic]]``) and the index, the links that are missing, and whether all is as it should be.

    ``members``: a row for each article of a topic; ``contents``: (by, content).
    A group is a report, whose topics its selection bounds.
    """
    one = members.groupBy(by, topic).agg(F.min(F.struct(*order, F.col(title).alias("_title"), F.col(category).alias("_category"))).alias("f"), F.collect_set(F.nullif(url, F.lit(""))).alias("urls"))
    held = one.groupBy(by).agg(F.count(F.lit(1)).alias("topics"), F.collect_list(F.struct(F.col(topic).cast("string").alias("topic"), F.col("f._title").alias("title"), F.col("f._category").alias("category"))).alias("ts"), F.flatten(F.collect_list("urls")).alias("urls"))
    rows = held.join(contents, by, "left").withColumn("content", F.coalesce("content", F.lit("")))
    has = lambda text: F.contains(F.col("content"), text)
    marks = F.regexp_extract_all("content", F.lit(r"\[\[(\d+)\]\]"), F.lit(1))
    out = rows.withColumns({
        "in_overview": F.size(F.filter("ts", lambda t: has(F.concat(F.lit("【"), t["category"], F.lit("】["), t["title"], F.lit("]"))))), "in_body": F.size(marks),
        "in_index": F.size(F.filter("ts", lambda t: has(F.concat(F.lit("| "), table_cell(t["title"]), F.lit(" |"))))), "missing_urls": F.array_sort(F.filter(F.array_distinct("urls"), lambda u: ~has(u))),
    })
    same = F.array_sort(marks) == F.array_sort(F.transform("ts", lambda t: t["topic"]))
    valid = same & (F.col("in_overview") == F.col("topics")) & (F.col("in_index") == F.col("topics")) & (F.size("missing_urls") == 0)
    return out.select(by, "topics", "in_overview", "in_body", "in_index", "missing_urls", valid.alias("valid"))


def draft(rows: DataFrame, by: str, article: str) -> DataFrame:
    return rows.groupBy(by).agg(F.array_sort(F.collect_set(article)).alias("article_ids")).withColumn("review_status", F.lit("pending"))


def briefing_outcome(rows: DataFrame, candidates: str, selected: str, ok: str) -> DataFrame:
    out = F.when(F.col(candidates) == 0, "skipped_no_candidates").when(F.col(selected) == 0, "skipped_none_selected").when(~F.col(ok), "failed_check").otherwise("success")
    return rows.withColumn("outcome", out)


def render_cards(df: DataFrame, key: str, title: str, body: str, score: str) -> DataFrame:
    missing = F.lit("N/A")
    value = lambda c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), missing)
    number = F.when(F.col(score).isNotNull(), F.format_string("%.1f", F.col(score))).otherwise(missing)
    return df.select(key, F.concat_ws("\n", F.concat(F.lit("# "), value(title)), F.concat(F.lit("Score: "), number), F.lit(""), value(body)).alias("card"))


def term_bullets(terms: Column) -> Column:
    """An array of (term, abbr, zh, aliases) as lines ``- term (abbr) -> zh；别名：aliases``; what is missing is left out, N/A where nothing is left."""
    some = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))

    def line(t: Column) -> Column:
        term, abbr, zh = some(t["term"]), some(t["abbr"]), some(t["zh"])
        abbr = F.when(~abbr.eqNullSafe(term), abbr)
        head = F.when(term.isNotNull() & abbr.isNotNull(), F.concat(term, F.lit(" ("), abbr, F.lit(")"))).otherwise(F.coalesce(term, abbr))
        head = F.when(head.isNotNull() & zh.isNotNull(), F.concat(head, F.lit(" -> "), zh)).otherwise(F.coalesce(head, zh))
        other = F.nullif(F.array_join(F.filter(F.transform(t["aliases"], some), lambda a: a.isNotNull()), "，"), F.lit(""))
        return F.when(other.isNotNull(), F.concat(F.coalesce(head, F.lit("")), F.lit("；别名："), other)).otherwise(head)

    lines_ = F.filter(F.transform(F.coalesce(terms, F.array().cast("array<struct<term:string,abbr:string,zh:string,aliases:array<string>>>")), line), lambda x: x.isNotNull())
    return F.when(F.size(lines_) > 0, F.array_join(F.transform(lines_, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise("N/A")


def render_insights(df: DataFrame, key: str, fields: dict[str, str], sections: dict[str, str], title: str, score: Column) -> DataFrame:
    """(key, card): a title, labelled fields, the score with one decimal, then a section for each text; N/A for what is empty."""
    value = lambda c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("N/A"))
    number = F.when(score.isNotNull(), F.format_string("%.1f", score)).otherwise("N/A")
    head = [F.concat(F.lit(f"**{label}**："), value(c)) for label, c in fields.items()]
    parts = [F.concat(F.lit(f"## {label}\n"), value(c)) for label, c in sections.items()]
    top = F.concat_ws("\n", *head, F.concat(F.lit("**统一排序分**："), number, F.lit("/10")))
    return df.select(key, F.concat_ws("\n\n", F.concat(F.lit("# "), value(title), F.lit(" — 深度洞察")), top, *parts).alias("card"))
