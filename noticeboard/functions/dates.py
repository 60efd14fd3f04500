"""Dates, progress and number formats. What depends on the time takes it as an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeboard.functions.text import strip

#: fixed values: how notices write dates
PATTERNS = ("yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "yyyy年M月d日")


def parsed(c: Column, now: Column) -> Column:
    """the first pattern that fits; blank or odd ones are now."""
    v = strip(c)
    return F.coalesce(*[F.try_to_timestamp(v, F.lit(p)) for p in PATTERNS], now)


def deadline(c: Column) -> Column:
    """a date as it is, with / or . for -, or the first Y年M月D日 anywhere; else null."""
    v = strip(F.coalesce(c, F.lit("")))
    plain = F.regexp_replace(v, "[/.]", "-")
    han = F.concat_ws("-", *[F.nullif(F.regexp_extract(v, r"(\d{4})年(\d{1,2})月(\d{1,2})日", i), F.lit("")) for i in (1, 2, 3)])
    day = lambda x: F.when(x.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(x, F.lit("yyyy-M-d"))).cast("date")
    return F.coalesce(day(plain), day(han))


def deadline_status(date: Column, today: Column, soon: int = 3, names: tuple[str, ...] = ("已截止", "即将截止", "报名中", "未说明")) -> Column:
    """over, soon over, open, unknown."""
    days = F.datediff(date, today)
    return F.when(days < 0, names[0]).when(days <= soon, names[1]).when(days > soon, names[2]).otherwise(names[3])


def moment(c: Column) -> Column:
    """ISO 8601, Z allowed, no zone is UTC; odd ones are null."""
    return F.expr("try_cast(null as timestamp)") if c is None else F.try_to_timestamp(strip(c))


def progress(c: Column, fallback: int = 0) -> Column:
    """a percentage between 0 and 100."""
    return F.least(F.greatest(F.coalesce(c.try_cast("int"), F.lit(fallback)), F.lit(0)), F.lit(100))


def duration_ms(start: Column, end: Column) -> Column:
    """never negative."""
    return F.greatest(F.timestamp_diff("MILLISECOND", start, end), F.lit(0))


def progress_between(start: int, end: int, done: Column, total: Column) -> Column:
    """done/total mapped to a range, half to even."""
    lo, hi = sorted((max(0, min(start, 100)), max(0, min(end, 100))))
    share = F.least(F.greatest(done / F.nullif(total, F.lit(0)), F.lit(0.0)), F.lit(1.0))
    return F.when(total <= 0, F.lit(max(0, min(start, 100)))).otherwise(F.bround(lo + (hi - lo) * share, 0).cast("int"))


def percent(part: Column, total: Column) -> Column:
    """a share as text, half up; no total is 0%."""
    return F.when(total > 0, F.concat(F.round(100.0 * part / total, 0).cast("int").cast("string"), F.lit("%"))).otherwise("0%")


def ratio(part: Column, total: Column) -> Column:
    """A share of four digits; 0 without a total."""
    return F.when(total > 0, F.round(part / total, 4)).otherwise(F.lit(0.0))


def comparable(c: Column) -> Column:
    """a time for comparison: without a zone it is UTC, which the session's zone has to be; a day is its midnight."""
    return c.cast("timestamp")


def interval_text(seconds: Column, empty: str = "--") -> Column:
    """seconds, minutes (half up), whole hours, or hours and minutes."""
    whole = lambda c: F.round(c, 0).cast("bigint").cast("string")
    hours = F.floor(seconds / 3600).cast("string")
    long = F.when(seconds % 3600 == 0, F.concat(hours, F.lit(" 小时"))).otherwise(F.concat(hours, F.lit(" 小时 "), whole((seconds % 3600) / 60), F.lit(" 分钟")))
    return F.when(seconds.isNull() | (seconds <= 0), empty).when(seconds < 60, F.concat(seconds.cast("string"), F.lit(" 秒"))).when(seconds < 3600, F.concat(whole(seconds / 60), F.lit(" 分钟"))).otherwise(long)


def duration_text(ms: Column, empty: str = "--") -> Column:
    """milliseconds under a second, else whole seconds, else minutes and seconds."""
    s = F.floor(ms / 1000)
    text = lambda c: c.cast("bigint").cast("string")
    return F.when(ms.isNull() | (ms < 0), empty).when(ms < 1000, F.concat(text(F.round(ms, 0)), F.lit("ms"))).when(s < 60, F.concat(text(s), F.lit("秒"))).otherwise(F.concat(text(F.floor(s / 60)), F.lit("分"), text(s % 60), F.lit("秒")))
