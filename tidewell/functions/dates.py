"""Date expressions.  Nothing reads the clock: "today" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEOUL = "Asia/Seoul"


def parse_mixed_date(c: Column) -> Column:
    """DAT-01 and DAT-02: a spreadsheet's serial number, year-month-day with - . or /, or month-day-year; else null."""
    text = F.regexp_replace(F.trim(c), r"[./]", "-")
    text = F.regexp_replace(text, r"\s+", "")
    serial = F.when(F.trim(c).rlike(r"^\d{5}(\.\d+)?$"), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(F.trim(c).try_cast("double")).cast("int")))
    year_first = F.regexp_extract(text, r"^(\d{4}-\d{1,2}-\d{1,2})", 1)
    month_first = F.regexp_replace(F.regexp_extract(text, r"^(\d{1,2}-\d{1,2}-\d{4})$", 1), r"^(\d+)-(\d+)-(\d+)$", "$3-$1-$2")
    return F.coalesce(serial, F.nullif(year_first, F.lit("")).try_cast("date"), F.nullif(month_first, F.lit("")).try_cast("date"))


def parse_review_date(c: Column, as_of: Column) -> Column:
    """DAT-03: a review's date: an instant (then the day in Seoul), a date with two or four digits of the year, month and
    day only (last year's if that lies more than a day ahead), or words for today, yesterday and so many days or weeks ago."""
    text = F.trim(c)
    number = lambda pattern: F.regexp_extract(text, pattern, 1).try_cast("int")
    instant = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T"), seoul_date(F.try_to_timestamp(text)))
    dotted = F.regexp_replace(F.regexp_replace(text, r"\.?\s*[월화수목금토일]?$", ""), r"\.\s*", "-")
    full = F.when(dotted.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), dotted.try_cast("date"))
    short = F.when(dotted.rlike(r"^\d{2}-\d{1,2}-\d{1,2}$"), F.concat(F.lit("20"), dotted).try_cast("date"))
    day = F.when(dotted.rlike(r"^\d{1,2}-\d{1,2}$"), F.concat_ws("-", F.year(as_of).cast("string"), dotted).try_cast("date"))
    day = F.when(day > F.date_add(as_of, 1), F.add_months(day, -12)).otherwise(day)
    # Words for today, yesterday and the day before
    words = F.when(text.contains("오늘"), as_of).when(text.contains("어제"), F.date_sub(as_of, 1)).when(text.contains("그제") | text.contains("그저께"), F.date_sub(as_of, 2))
    ago = F.coalesce(F.date_sub(as_of, number(r"^(\d+)\s*일\s*전")), F.date_sub(as_of, number(r"^(\d+)\s*주\s*전") * 7))
    return F.coalesce(instant, full, short, day, words, ago)


def seoul_date(instant: Column) -> Column:
    """DAT-04: the day in Seoul of an instant, which is kept in UTC."""
    return F.to_date(F.from_utc_timestamp(instant, SEOUL))


def bucket(day: Column, granularity: str) -> Column:
    """DAT-06 and DAT-08: the first day of the day, week (from Monday), month or year."""
    if granularity not in ("day", "week", "month", "year"):
        raise ValueError(f"no such granularity: {granularity}")
    return F.to_date(F.date_trunc(granularity, day))


def bucket_label(day: Column, granularity: str) -> Column:
    return F.date_format(day, {"day": "yyyy-MM-dd", "week": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[granularity])


def spine(first: Column, last: Column, step: str = "1 day") -> Column:
    """DAT-09: the array of days (or weeks, months) from first to last, both included; empty if last is earlier."""
    return F.when(first <= last, F.sequence(first, last, F.expr(f"interval {step}"))).otherwise(F.array().cast("array<date>"))


def next_range(newest: Column, end: Column, days: int) -> Column:
    """DAT-10: what to collect next: from the day after the newest one, else the last `days` days, to end; null if none."""
    start = F.coalesce(F.date_add(newest, 1), F.date_sub(end, days - 1))
    return F.when(start <= end, F.struct(start.alias("start"), end.alias("end")))


def leading_iso_date(c: Column) -> Column:
    """DAT-11: the date that a text starts with, if the calendar has it; eight digits are a date too."""
    text = F.trim(c)
    dashed = F.nullif(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    compact = F.regexp_replace(F.nullif(F.regexp_extract(text, r"^(\d{8})$", 1), F.lit("")), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return F.coalesce(dashed, compact).try_cast("date")


def birth_from_age(c: Column, as_of: Column) -> Column:
    """DAT-12: 1 January of the year that so many years (Y) and months (M) lie back; a letter O counts as zero."""
    text = F.regexp_replace(F.upper(F.trim(c)), "O", "0")
    years, months = (F.regexp_extract(text, p, 1).try_cast("int") for p in (r"(\d+)\s*Y", r"(\d+)\s*M"))
    total = F.coalesce(years * 12, F.lit(0)) + F.coalesce(months, F.lit(0))
    return F.when(years.isNotNull() | months.isNotNull(), F.to_date(F.trunc(F.add_months(as_of, -total), "year")))


def age_years(birth: Column, as_of: Column) -> Column:
    """DAT-13: years begun since birth; 0 on the day itself, null for a birth ahead."""
    days = F.datediff(as_of, birth)
    return F.when(days >= 0, F.ceil(days / 365.25)).cast("int")


def korean_date(c: Column) -> Column:
    """DAT-14: year, month and day in words."""
    return F.concat(F.year(c).cast("string"), F.lit("년 "), F.month(c).cast("string"), F.lit("월 "), F.dayofmonth(c).cast("string"), F.lit("일"))


def stale_days(day: Column, as_of: Column) -> Column:
    """DAT-16: days since the last data; never less than zero."""
    return F.greatest(F.datediff(as_of, day), F.lit(0))


def days_left(end: Column, now: Column) -> Column:
    """DAT-16: days until an instant, those begun counted whole."""
    return F.ceil((F.unix_timestamp(end) - F.unix_timestamp(now)) / 86400).cast("int")


def is_due(hour: Column, weekday: Column, last_run: Column, now: Column) -> Column:
    """DAT-17: whether a schedule's hour (and weekday, from Sunday as 0, if it has one) is now and has not been served."""
    slot = lambda t: F.floor(F.unix_timestamp(t) / 3600)
    on_day = weekday.isNull() | (weekday == F.dayofweek(now) - 1)
    return (hour == F.hour(now)) & on_day & (last_run.isNull() | (slot(last_run) < slot(now)))


def changed(rows: DataFrame, old: str, new: Column, name: str) -> DataFrame:
    """DAT-19: the rows whose value would change, null being a value, with the new one."""
    return rows.withColumn(name, new).where(~F.col(name).eqNullSafe(F.col(old)))
