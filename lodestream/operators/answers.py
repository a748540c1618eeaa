"""Requests to a model and its stored answers: batching, tolerant decoding, routing, scoring."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream import config as C
from lodestream.functions import scores, text
from lodestream.operators.star import numbered_within


def build_requests(df: DataFrame, group: str, order: str, fields: list[str], size: int = 20) -> DataFrame:
    """Groups of ``size`` rows of a group in order, as one JSON array with an index within the batch. A group of any size is numbered by many tasks."""
    n = F.col("_at") - 1
    rows = numbered_within(df.select(group, *dict.fromkeys([order, *fields])), group, [F.col(order)], "_at").withColumn("batch_no", F.floor(n / size).cast("int")).withColumn("item_index", (n % size).cast("int"))
    items = F.array_sort(F.collect_list(F.struct("item_index", *fields)))
    return rows.groupBy(group, "batch_no").agg(F.to_json(items).alias("payload"), F.count(F.lit(1)).alias("n"))


def repair(raw: str | None) -> str | None:
    """JSON text from an answer that was cut off or wrapped, or null. Values that follow each other become one array."""
    if not raw:
        return None
    begin = min((i for i in (raw.find("{"), raw.find("[")) if i >= 0), default=-1)
    if begin < 0:
        return None
    body, found = raw[begin:], []
    while body[:1] in ("{", "["):  # something after the first value: more values, or text
        try:
            value, end = json.JSONDecoder().raw_decode(body)
        except ValueError:
            break
        found.append(value)
        body = body[end:].lstrip(" \t\r\n,;")
    if found:
        if body[:1] in ("{", "[") and (last := _closed(body)) is not None:
            found.append(last)
        return json.dumps(found if len(found) > 1 else found[0], ensure_ascii=False)
    value = _closed(body)
    return None if value is None else json.dumps(value, ensure_ascii=False)


def _closed(body: str) -> dict | list | None:
    """The value that was cut off, with what is open closed."""
    stack, quoted, escape = [], False, False
    for c in body:
        if quoted:
            quoted, escape = (c != '"' or escape), (c == "\\" and not escape)
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
    tail = ('"' if quoted else "") + "".join(reversed(stack))
    for end in (tail, " null" + tail, ": null" + tail):
        try:
            return json.loads(body.rstrip().rstrip(",") + end)
        except ValueError:
            continue
    return None


@F.pandas_udf(T.StringType())
def _repair(raw: pd.Series) -> pd.Series:
    return raw.map(repair)


def decode_responses(df: DataFrame, content: str) -> DataFrame:
    """Adds ``answer`` (variant) and ``decode`` (parsed, repaired, failed). Only answers that don't parse go through Python."""
    plain = F.try_parse_json(text.strip_fence(content))
    direct = df.withColumn("answer", plain)
    good = direct.filter("answer is not null").withColumn("decode", F.lit("parsed"))
    bad = direct.filter("answer is null").withColumn("answer", F.try_parse_json(_repair(F.col(content))))
    return good.unionByName(bad.withColumn("decode", F.when(F.col("answer").isNotNull(), "repaired").otherwise("failed")))


def apply_routing(items: DataFrame, answers: DataFrame, keys: list[str], index: str, least: float) -> DataFrame:
    """A batch whose answered indexes aren't just the expected ones falls back to rules as a whole; low confidence is undecided."""
    want = items.groupBy(*keys).agg(F.array_sort(F.collect_list(index)).alias("_want"))
    have = answers.groupBy(*keys).agg(F.array_sort(F.collect_list(index)).alias("_have"))
    ok = want.join(have, keys, "left").select(*keys, F.coalesce(F.col("_want") == F.col("_have"), F.lit(False)).alias("_ok"))
    rows = items.join(ok, keys).join(answers, [*keys, index], "left")
    related = F.when(F.col("_ok") & (F.col("confidence") >= least), F.col("ai_related"))
    return rows.withColumn("related", related).withColumn("method", F.when(F.col("_ok"), "model").otherwise("rule")).drop("_ok")


def render(template: str, values: dict[str, Column]) -> Column:
    """The template with each {name} replaced."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def annotate(df: DataFrame, answer: str = "answer", deep_from: float = 7.0) -> DataFrame:
    """All columns of a scored article from its decoded answer in one projection."""
    a = F.col(answer)
    word = lambda k: F.trim(F.coalesce(F.try_variant_get(a, f"$.{k}", "string"), F.lit("")))
    many = lambda k: F.coalesce(F.try_variant_get(a, f"$.{k}", "array<string>"), text.as_list(F.try_variant_get(a, f"$.{k}", "string")))
    found = {k: scores.score_of(a, names) for k, names in C.SCORE_KEYS.items()}
    rows = df.withColumns({f"score_{k}": v for k, v in found.items()} | {"title_cn": F.coalesce(F.nullif(word("title_cn"), F.lit("")), F.trim("title")), "category": scores.normal_category(word("category")), "tech_tags": many("tech_tags"), "keywords": many("keywords")})
    cap = scores.domain_cap(F.lower(F.concat_ws(" ", "title", word("category"), word("sub_category"), F.array_join("tech_tags", " "))))
    rows = rows.withColumn("_cap", cap).withColumn("score_org_relevance", F.least(scores.anchored("score_org_relevance"), F.coalesce("_cap.most", F.lit(10.0)))).withColumn("capped_by", F.col("_cap.domain")).drop("_cap")
    rows = rows.withColumn("score_timeliness", scores.timeliness("publish_time", "crawl_time"))
    rank = scores.rank_score("score_org_relevance", "score_trend", "score_engineering", "score_tech_depth", "score_timeliness")
    deep = F.coalesce(F.try_variant_get(a, "$.need_deep_analysis", "boolean"), F.col("rank_score") >= deep_from)
    return rows.withColumn("rank_score", rank).withColumn("need_deep_analysis", deep)
