"""Posted dates. Nothing here reads a clock: relative forms count back from an explicit ``as_of`` date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _day(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date")


def iso_date(c: Column) -> Column:
    """A plain YYYY-MM-DD date; null for anything else."""
    parts = r"\A(\d{4})-(\d{1,2})-(\d{1,2})\z"
    padded = F.concat_ws(
        "-", F.regexp_extract(c, parts, 1), *[F.lpad(F.regexp_extract(c, parts, i), 2, "0") for i in (2, 3)]
    )
    return F.when(c.rlike(parts), _day(padded))


def epoch_millis_date(c: Column) -> Column:
    """Day of a millisecond clock reading, in the session time zone; zero counts as missing."""
    return F.to_date(F.timestamp_millis(F.nullif(c.cast("bigint"), F.lit(0).cast("bigint"))))


def days_before(as_of: Column, days: Column) -> Column:
    return F.date_sub(as_of.cast("date"), days.try_cast("int"))


def first_number_age(c: Column, as_of: Column, hours_are_today: bool) -> Column:
    """'3 days ago'. The unit is ignored, except that hours can count as today."""
    days = F.nullif(F.regexp_extract(c, r"(\d+)", 1), F.lit(""))
    if hours_are_today:
        today = days.isNotNull() & F.contains(F.lower(c), F.lit("hour"))
        days = F.when(today, F.lit("0")).otherwise(days)
    return days_before(as_of, days)


def timestamp_or_age(stamp: Column, friendly: Column, as_of: Column) -> Column:
    """Day of an ISO timestamp as written; else, when the friendly text speaks of days, all its digits as an age."""
    iso = F.when(
        stamp.rlike(r"\A\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?)?\z"),
        _day(F.substring(stamp, 1, 10)),
    )
    digits = F.coalesce(F.nullif(F.regexp_replace(friendly, r"\D", ""), F.lit("")), F.lit("0"))
    return F.coalesce(iso, F.when(F.contains(friendly, F.lit("day")), days_before(as_of, digits)))


def age_label(date_posted: Column, as_of: Column) -> Column:
    """'5d', 'today' or '?'."""
    days = F.datediff(as_of, date_posted)
    return (
        F.when(date_posted.isNull(), "?").when(days > 0, F.concat(days.cast("string"), F.lit("d"))).otherwise("today")
    )
