"""Text, list and fingerprint columns from built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = r"\x{4e00}-\x{9fff}"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def digest(c: Column | str) -> Column:
    return F.sha2(_c(c), 256)


def fingerprint(*texts: Column | str) -> Column:
    """Digest of the first text that isn't empty."""
    return digest(F.coalesce(*(F.when(F.trim(_c(t)) != "", _c(t)) for t in texts)))


def title_key(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(_c(c)), f"[^0-9a-zA-Z{HAN}]+", "")


def clean(c: Column | str) -> Column:
    """Line ends unified, runs of blanks one blank, runs of empty lines one, trimmed."""
    c = F.regexp_replace(_c(c), r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t\x{a0}]+", " ")
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def as_list(c: Column | str) -> Column:
    """JSON array text or separated text to distinct-free list of trimmed, non-empty values."""
    c = _c(c)
    plain = F.split(F.translate(c, "，；;", ",,,"), ",")
    values = F.when(F.startswith(F.ltrim(c), F.lit("[")), F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))).otherwise(plain)
    return F.coalesce(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def as_bool(c: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(_c(c).cast("string"))).isin("true", "1", "yes", "是"), F.lit(False))


def as_number(c: Column | str, default: float = 0.0, low: float | None = None, high: float | None = None) -> Column:
    out = F.coalesce(_c(c).try_cast("double"), F.lit(default))
    if low is not None:
        out = F.greatest(out, F.lit(low))
    return F.least(out, F.lit(high)) if high is not None else out


def language(c: Column | str) -> Column:
    """By script: mixed, zh, en or unknown."""
    c = F.coalesce(_c(c), F.lit(""))
    han = F.length(F.regexp_replace(c, f"[^{HAN}]", ""))
    latin = F.length(F.regexp_replace(c, "[^A-Za-z]", ""))
    return F.when((han > 0) & (latin > 2 * han), "mixed").when(han > 0, "zh").when(latin > 0, "en").otherwise("unknown")


def input_text(summary: Column | str, body: Column | str, title: Column | str) -> Column:
    head = F.nullif(F.trim(F.substring(_c(summary), 1, 1200)), F.lit(""))
    rest = F.nullif(F.trim(F.substring(_c(body), 1, 3500)), F.lit(""))
    return F.coalesce(F.nullif(F.concat_ws("\n\n", head, rest), F.lit("")), _c(title), F.lit(""))


def first_sentence(c: Column | str, most: int = 180) -> Column:
    whole = F.trim(_c(c))
    cut = F.regexp_extract(whole, r"^([\s\S]*?[。！？.!?])", 1)
    return F.substring(F.when(cut != "", cut).otherwise(whole), 1, most)


def table_cell(c: Column | str) -> Column:
    return F.replace(F.replace(F.coalesce(_c(c), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def strip_fence(c: Column | str) -> Column:
    c = F.trim(_c(c))
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"^```[a-zA-Z]*[ \t]*\n?", ""), r"\n?```$", ""))


def cut_bytes(c: Column | str, most: int, suffix: str = "...") -> Column:
    """At most so many UTF-8 bytes with the suffix, never within a character."""
    c = _c(c)
    room = most - len(suffix.encode())
    raw = F.encode(c, "UTF-8")
    part = F.coalesce(*(F.try_validate_utf8(F.substring(raw, 1, room - k).cast("string")) for k in range(4)))
    return F.when(F.octet_length(c) <= most, c).otherwise(F.concat(part, F.lit(suffix)))


def term_set(title: Column | str, *arrays: Column | str) -> Column:
    """Words of two characters or more, pairs of neighbouring Han characters, and all listed values, in lower case."""
    low = F.lower(F.coalesce(_c(title), F.lit("")))
    words = F.regexp_extract_all(low, F.lit(f"[0-9a-zA-Z{HAN}]{{2,}}"), F.lit(0))
    han = F.regexp_replace(low, f"[^{HAN}]+", "")
    # a text of ASCII alone, which most are, is told without a pattern
    pairs = F.when((F.octet_length(low) > F.length(low)) & (F.length(han) >= 2), F.transform(F.sequence(F.lit(1), F.length(han) - 1), lambda i: F.substring(han, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    out = F.array_union(words, pairs)
    for a in arrays:
        out = F.array_union(out, F.coalesce(F.transform(_c(a), lambda x: F.lower(x)), F.array().cast("array<string>")))
    return F.array_distinct(out)


def jaccard(a: Column | str, b: Column | str) -> Column:
    a, b = _c(a), _c(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def any_in(c: Column, terms: list[str]) -> Column:
    """Any term is a substring."""
    return F.exists(F.array(*(F.lit(t.lower()) for t in terms)), lambda t: F.contains(c, t)) if terms else F.lit(False)


def as_object(c: Column | str) -> Column:
    """JSON text of an object; anything else becomes the note of one."""
    parsed = F.try_parse_json(_c(c))
    is_object = F.coalesce(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), F.lit(False))
    return F.when(is_object, F.to_json(parsed)).otherwise(F.to_json(F.struct(_c(c).alias("note"))))


TERM = "struct<term:string,abbr:string,zh:string,aliases:array<string>>"


def standard_terms(c: Column | str, most: int = 10) -> Column:
    """JSON array text of names or of objects to at most so many terms with a name."""
    named = F.from_json(_c(c), f"array<{TERM}>")
    plain = F.transform(F.from_json(_c(c), "array<string>"), lambda t: F.named_struct(F.lit("term"), t, F.lit("abbr"), F.lit(None).cast("string"), F.lit("zh"), F.lit(None).cast("string"), F.lit("aliases"), F.lit(None).cast("array<string>")))
    both = F.when(F.exists(named, lambda t: t["term"].isNotNull()), named).otherwise(plain)
    trimmed = F.transform(both, lambda t: t.withField("term", F.trim(t["term"])).withField("aliases", F.coalesce(t["aliases"], F.array().cast("array<string>"))))
    return F.slice(F.filter(trimmed, lambda t: F.coalesce(t["term"], F.lit("")) != ""), 1, most)


def aliased(c: Column | str, names: dict[str, str]) -> Column:
    """The name that stands for a label, else the label."""
    held = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.try_element_at(held, _c(c)), _c(c))


def bullets(entries: Column | str) -> Column:
    """A map of texts as lines of label and value."""
    return F.array_join(F.transform(F.map_entries(_c(entries)), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "\n")


def first_text(*texts: Column | str) -> Column:
    """The first text that isn't empty, else the empty one."""
    return F.coalesce(*(F.nullif(_c(t), F.lit("")) for t in texts), F.lit(""))


def file_name(url: Column | str, title: Column | str, end: str = ".md") -> Column:
    """16 characters of the URL's digest and 30 of the title, other characters than letters and digits as one underscore."""
    return F.concat(F.substring(digest(url), 1, 16), F.lit("_"), F.substring(F.regexp_replace(_c(title), "[^0-9A-Za-z]+", "_"), 1, 30), F.lit(end))


def tag_map(tags: dict[str, Column | str], lists: dict[str, Column | str]) -> Column:
    """A document's tags: fixed keys with one value, null as empty, and lists joined by commas."""
    pairs = [(k, F.coalesce(_c(v).cast("string"), F.lit(""))) for k, v in tags.items()] + [(k, F.array_join(F.coalesce(_c(v), F.array().cast("array<string>")), ",")) for k, v in lists.items()]
    return F.create_map(*(x for k, v in pairs for x in (F.lit(k), v)))


def batch_number(c: Column | str) -> Column:
    """number, kind (the prefix that names it, or empty) and valid."""
    n = F.regexp_replace(_c(c), r"\.json$", "")
    return F.struct(n.alias("number"), F.regexp_extract(n, "^(COL|IMP|RERUN|VAL)-", 1).alias("kind"), n.rlike(r"^[A-Za-z0-9._-]+$").alias("valid"))
