"""Scores and categories of articles from built-in functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestream import config as C
from lodestream.functions.text import _c, any_in


def hits(text: Column, terms: list[str]) -> Column:
    """How many distinct terms are substrings."""
    return F.size(F.filter(F.array(*(F.lit(t) for t in terms)), lambda t: F.contains(text, t)))


def predict_category(text: Column | str, source_category: Column | str, lists: dict[str, list[str]] | None = None, catch_all: str = C.CATCH_ALL) -> Column:
    """Most keyword hits, the first listed on a tie; else the source's if it is one of them; else the catch-all."""
    lists = C.CATEGORY_KEYWORDS if lists is None else lists
    best = F.array_max(F.array(*(F.struct(hits(_c(text), k).alias("n"), F.lit(-i).alias("at"), F.lit(c).alias("category")) for i, (c, k) in enumerate(lists.items()))))
    own = _c(source_category)
    return F.when(best["n"] > 0, best["category"]).when(own.isin(*lists, catch_all), own).otherwise(catch_all)


def candidate_score(text: Column | str, summary: Column | str, confidence: Column | str, terms: list[str] | None = None) -> Column:
    return hits(_c(text), C.RELEVANCE_TERMS if terms is None else terms) * 5.0 + F.when(F.coalesce(_c(summary), F.lit("")) != "", 2.0).otherwise(0.0) + F.coalesce(_c(confidence), F.lit(0.0)) * 5.0


def timeliness(published: Column | str, crawled: Column | str, bands: list[tuple[int, float]] | None = None) -> Column:
    """By whole days between the two; 0 without a date."""
    seconds = F.timestamp_diff("SECOND", _c(published), _c(crawled))
    days = F.greatest(F.lit(0), F.floor(seconds / 86400))
    out = F.when(_c(published).isNull(), 0.0)
    for most, score in C.TIMELINESS if bands is None else bands:
        out = out.when(days <= most, score)
    return out.otherwise(0.0)


def anchored(score: Column | str, ladder: list[float] | None = None) -> Column:
    return F.array_max(F.filter(F.array(*(F.lit(a) for a in (C.ANCHORS if ladder is None else ladder))), lambda a: a <= _c(score)))


def rank_score(relevance: Column | str, trend: Column | str, engineering: Column | str, depth: Column | str, fresh: Column | str) -> Column:
    """Weighted sum in decimals, two places, as double."""
    parts = zip((relevance, trend, engineering, depth, fresh), C.RANK_WEIGHTS.values(), strict=True)
    total = reduce(lambda a, b: a + b, (F.coalesce(_c(c), F.lit(0.0)).cast("decimal(6,3)") * F.lit(w).cast("decimal(3,2)") for c, w in parts))
    return F.round(total, 2).cast("double")


def score_of(answer: Column, keys: list[str]) -> Column:
    """The first of the keys whose value is a number from 0 to 10; else 0. ``answer``: a variant."""
    values = (F.try_variant_get(answer, f'$["{k}"]', "double") for k in keys)
    return F.coalesce(*(F.when(v.between(0, 10), v) for v in values), F.lit(0.0))


def domain_cap(text: Column | str, rules: list[tuple[str, float, list[str]]] | None = None) -> Column:
    """(domain, most) of the first rule with a term in the text, else null."""
    out = None
    for domain, most, terms in C.DOMAIN_CAPS if rules is None else rules:
        hit, value = any_in(_c(text), terms), F.struct(F.lit(domain).alias("domain"), F.lit(most).alias("most"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def normal_category(label: Column | str, allowed: list[str] | None = None, catch_all: str = C.CATCH_ALL) -> Column:
    """Exact, by synonym, other verticals to the catch-all, by either containing the other, else the catch-all."""
    allowed = [*C.CATEGORY_KEYWORDS, catch_all] if allowed is None else allowed
    raw = F.trim(F.coalesce(_c(label), F.lit("")))
    last = catch_all if catch_all in allowed else ""
    out = F.when(raw == "", last).when(raw.isin(*allowed), raw)
    for part, target in C.CATEGORY_SYNONYMS:
        if target in allowed:
            out = out.when(F.contains(raw, F.lit(part)), target)
    for term in C.OTHER_VERTICALS:
        out = out.when(F.contains(raw, F.lit(term)), last)
    for name in allowed:
        out = out.when(F.contains(raw, F.lit(name)) | F.contains(F.lit(name), raw), name)
    return out.otherwise(last)


def is_event(info_type: Column | str) -> Column:
    return ~any_in(F.lower(F.coalesce(_c(info_type), F.lit(""))), C.OPINION_TERMS)


def score_or(*choices: Column | str) -> Column:
    """The first score that is there, else 0."""
    return F.coalesce(*(_c(c) for c in choices), F.lit(0.0))


def target_for(kind: Column | str, targets: dict[str, int], default: int) -> Column:
    """How many topics a kind of report has."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in targets.items() for x in pair)), _c(kind)), F.lit(default))
