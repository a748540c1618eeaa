"""Times from free text, relative to a reference column, from built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestream.functions.text import _c

# Words for units of time before the reference, in seconds, tried in order.
AGO = [("分钟前", 60), ("小时前", 3600), ("天前", 86400), ("周前", 604800)]
# Words for whole days before the reference, in order.
DAYS = [("昨天", 1), ("前天", 2)]
# A date with a time, then a date alone.
DATE_TIME = r"(\d{4})-(\d{1,2})-(\d{1,2})[T\s](\d{1,2}):(\d{1,2})"
DATE = r"(\d{4})[-/.年](\d{1,2})[-/.月](\d{1,2})"

# A feed's time as mail has it; months; zones by hours from UTC.
RFC_822 = r"^(?:[A-Za-z]+,? )?(\d{1,2})[ -]([A-Za-z]{3})[a-z]*[ -](\d{4}|\d{2}) (\d{1,2}):(\d{2})(?::(\d{2}))?(?: ([A-Za-z]+|[+-]\d{2}:?\d{2}))?$"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ZONES = {"GMT": 0, "UT": 0, "UTC": 0, "Z": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}


def free_time(text: Column | str, reference: Column | str) -> Column:
    """Null where the text holds no time, or an impossible one."""
    raw, at = F.trim(F.regexp_replace(_c(text), r"\s+", " ")), _c(reference)
    out = None
    for word, seconds in AGO:
        n = F.regexp_extract(raw, rf"(\d+)\s*{word}", 1)
        back = F.timestamp_add("SECOND", -n.try_cast("int") * seconds, at)
        out = F.when(n != "", back) if out is None else out.when(n != "", back)
    for word, days in DAYS:
        out = out.when(F.contains(raw, F.lit(word)), F.timestamp_add("DAY", F.lit(-days), at))
    part = lambda p, i: F.lpad(F.regexp_extract(raw, p, i), 2 if i > 1 else 4, "0")
    day = lambda p: F.concat_ws("-", part(p, 1), part(p, 2), part(p, 3))
    out = out.when(raw.rlike(DATE_TIME), F.concat(day(DATE_TIME), F.lit(" "), part(DATE_TIME, 4), F.lit(":"), part(DATE_TIME, 5), F.lit(":00")).try_cast("timestamp_ntz"))
    return out.when(raw.rlike(DATE), day(DATE).try_cast("timestamp_ntz"))


def wall_time(c: Column | str) -> Column:
    """An ISO time's wall clock: the zone is dropped, not converted. A date alone is midnight; null where there is neither."""
    raw = F.trim(_c(c))
    whole = F.regexp_replace(raw, r"(Z|[+-]\d{2}:?\d{2})$", "").try_cast("timestamp_ntz")
    return F.coalesce(whole, F.regexp_extract(raw, r"^\d{4}-\d{2}-\d{2}", 0).try_cast("timestamp_ntz"))


def feed_time(c: Column | str) -> Column:
    """A feed's time in UTC: RFC 822 (the day's name and seconds may be missing, years may have two digits) or ISO 8601 (no zone: UTC). Null for anything else."""
    raw = F.trim(F.regexp_replace(_c(c), r"\s+", " "))
    part = lambda i: F.regexp_extract(raw, RFC_822, i)
    month = F.element_at(F.create_map(*(x for i, m in enumerate(MONTHS) for x in (F.lit(m), F.lit(f"{i + 1:02d}")))), F.lower(part(2)))
    year = F.when(F.length(part(3)) == 2, F.concat(F.when(part(3) < "50", "20").otherwise("19"), part(3))).otherwise(part(3))
    seconds = F.when(part(6) == "", "00").otherwise(part(6))
    mail = F.concat(year, F.lit("-"), month, F.lit("-"), F.lpad(part(1), 2, "0"), F.lit(" "), F.lpad(part(4), 2, "0"), F.lit(":"), part(5), F.lit(":"), seconds).try_cast("timestamp_ntz")
    named = F.element_at(F.create_map(*(F.lit(x) for z, h in ZONES.items() for x in (z, h * 60))), F.upper(part(7)))
    mail = F.timestamp_add("MINUTE", -F.coalesce(named, _minutes(part(7)), F.lit(0)), mail)
    zone = F.regexp_extract(raw, r"[T ]\d{1,2}:\d{2}.*?(Z|[+-]\d{2}:?\d{2})$", 1)
    iso = F.timestamp_add("MINUTE", -F.coalesce(_minutes(zone), F.lit(0)), wall_time(raw))
    return F.when(raw.rlike(RFC_822), mail).when(raw.rlike(r"^\d{4}-\d{2}-\d{2}"), iso)


def _minutes(zone: Column) -> Column:
    """Of +hh:mm or +hhmm; null for anything else."""
    digits = F.regexp_replace(zone, ":", "")
    n = (F.substring(digits, 2, 2).try_cast("int") * 60 + F.substring(digits, 4, 2).try_cast("int")) * F.when(F.startswith(digits, F.lit("-")), -1).otherwise(1)
    return F.when(digits.rlike(r"^[+-]\d{4}$"), n)


def date_range(start: Column, end: Column, days: Column) -> Column:
    """range_start (``days`` before the end where not given), range_end and outcome."""
    begin = F.coalesce(start, end - F.make_dt_interval(days))
    return F.struct(begin.alias("range_start"), end.alias("range_end"), F.when(begin > end, "invalid_range").otherwise("ok").alias("outcome"))
