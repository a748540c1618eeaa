"""URL columns from built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestream import config as C
from lodestream.functions.text import _c


def strip_fragment(url: Column | str) -> Column:
    return F.regexp_replace(_c(url), "#.*$", "")


def path(url: Column | str) -> Column:
    return F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def host(url: Column | str) -> Column:
    """Host and port in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def bare_host(url: Column | str) -> Column:
    return F.regexp_replace(host(url), ":.*$", "")


def origin(url: Column | str) -> Column:
    found = F.regexp_extract(_c(url), r"^(https?://[^/?#]+)", 1)
    return F.when(found != "", F.concat(found, F.lit("/"))).otherwise("")


def strip_tracking(url: Column | str, keys: list[str] = C.TRACKING_KEYS) -> Column:
    """Without fragment and tracking parameters; the others are encoded anew, blank values kept."""
    url = strip_fragment(url)
    query = F.regexp_extract(url, r"\?(.*)$", 1)
    code = lambda c: F.replace(F.replace(F.url_encode(F.try_url_decode(c)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_replace(p, "^[^=]*=?", "").alias("v")))
    kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*keys))
    text = F.array_join(F.transform(kept, lambda p: F.concat(code(p["k"]), F.lit("="), code(p["v"]))), "&")
    base = F.regexp_replace(url, r"\?.*$", "")
    return F.when(text != "", F.concat(base, F.lit("?"), text)).otherwise(base)


def title_from_url(url: Column | str) -> Column:
    last = F.regexp_extract(F.try_url_decode(F.regexp_replace(path(url), "/+$", "")), "([^/]*)$", 1)
    words = F.trim(F.regexp_replace(F.regexp_replace(last, r"(?i)\.(html?|aspx?)$", ""), "[-_]+", " "))
    return F.when(words != "", words).otherwise(_c(url))


def _ends(c: Column, endings: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, endings)), lambda e: F.endswith(c, e))


def looks_like_article(url: Column | str) -> Column:
    """Dated, numbered, deep or long-named paths; no assets, listings or index names."""
    p = F.regexp_replace(F.lower(F.try_url_decode(path(url))), "/+$", "")
    parts = F.filter(F.split(p, "/"), lambda s: s != "")
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    never = (p == "") | _ends(p, C.ASSET_ENDINGS) | F.arrays_overlap(parts, F.array(*map(F.lit, C.NON_ARTICLE_SEGMENTS))) | last.isin(*C.LISTING_HINTS, *C.INDEX_NAMES)
    signs = p.rlike(r"/20\d{2}/(0?[1-9]|1[0-2])(/|$)") | p.rlike(r"(^|[-_/])\d{5,}([-_/]|$)") | _ends(p, [".html", ".htm"]) | ((F.size(parts) >= 2) & (F.length(last) >= 6)) | (F.contains(last, F.lit("-")) & (F.length(last) >= 10))
    return F.coalesce(~never & signs, F.lit(False))


def looks_like_listing(url: Column | str, of_host: Column | str) -> Column:
    p = F.lower(F.try_url_decode(path(url)))
    parts = F.filter(F.split(p, "/"), lambda s: s != "")
    return F.coalesce((host(url) == _c(of_host)) & ~_ends(p, C.ASSET_ENDINGS) & (F.size(parts) <= 3) & ((F.size(parts) == 0) | F.exists(F.array(*map(F.lit, C.LISTING_HINTS)), lambda h: F.contains(p, h))), F.lit(False))


def article_url_ok(url: Column | str, domain: Column | str | None = None, listing: Column | str | None = None, pattern: Column | None = None) -> Column:
    """The rule of configured sites: scheme, host, path, endings, an optional pattern, and not the listing itself."""
    u, p = _c(url), F.lower(path(url))
    ok = u.rlike("^https?://") & ~p.isin("", "/") & ~_ends(p, C.BLOCKED_ENDINGS) & ~F.exists(F.array(*map(F.lit, C.BLOCKED_PATHS)), lambda k: F.contains(p, k))
    if domain is not None:
        ok = ok & F.contains(host(u), _c(domain))
    if listing is not None:
        ok = ok & (F.rtrim(u, F.lit("/")) != F.rtrim(_c(listing), F.lit("/")))
    if pattern is not None:
        ok = ok & F.when(F.coalesce(pattern, F.lit("")) == "", True).otherwise(F.rlike(u, pattern))
    return F.coalesce(ok, F.lit(False))


def same_domain(url: Column | str, domain: Column | str) -> Column:
    d = F.regexp_replace(F.lower(_c(domain)), ":.*$", "")
    return F.coalesce((d != "") & ((bare_host(url) == d) | F.endswith(bare_host(url), F.concat(F.lit("."), d))), F.lit(False))
