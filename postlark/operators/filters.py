"""Filters and ordered lists over postings."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlark.functions.location import normalise_location, state_code
from postlark.functions.text import strip
from postlark.operators.scoring import as_date
from postlark.schemas import ACTIVE_STATUSES


def moment(value) -> Column:
    """A zone-less timestamp literal for a datetime, a date or an ISO text."""
    if isinstance(value, Column):
        return value
    return F.lit(parse_moment(value).isoformat(sep=" ")).cast("timestamp_ntz")


def parse_moment(value) -> datetime:
    if isinstance(value, datetime):
        return value
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    return datetime.fromisoformat(str(value))


# Ids a cell of the order statistics spans, the most postings a page reads before its own.
ID_BLOCK = 1 << 16


def main_order() -> list[Column]:
    return [F.desc("score"), F.col("date_posted").desc_nulls_last(), F.asc("id")]


def apply_filters(
    df: DataFrame,
    *,
    status: str | None = None,
    min_score: int | None = None,
    company: str | None = None,
    source: str | None = None,
    since=None,
) -> DataFrame:
    """Status 'all', an empty company and an empty source do not filter; a minimum score of 0 does."""
    if status and status != "all":
        df = df.where(F.col("status") == status)
    if min_score is not None:
        df = df.where(F.col("score") >= min_score)
    if company:
        pattern = "%" + company.replace("\\", "\\\\") + "%"
        df = df.where(F.col("company").ilike(pattern))
    if source:
        df = df.where(F.col("source") == source)
    if since is not None:
        df = df.where(F.col("date_scraped") >= moment(since))
    return df


def list_postings(df: DataFrame, *, limit: int | None = 50, offset: int = 0, **filters) -> DataFrame:
    out = apply_filters(df, **filters).orderBy(*main_order())
    if limit is None:
        return out
    return (out.offset(offset) if offset else out).limit(limit)


def order_counts(df: DataFrame) -> DataFrame:
    """Order statistics of a list: postings per score, day and block of ids.

    To be kept beside the postings: counts of parts of a table add up, and a posting that goes or changes takes -1.
    """
    return df.groupBy("score", "date_posted", F.expr(f"id div {ID_BLOCK}").alias("id_block")).agg(F.count("*").alias("n"))


def _holding(cells: DataFrame, key: str, order: Column, position: int) -> tuple[object, int] | None:
    """The value of the key whose postings hold a position, and the number of postings before them."""
    sums = cells.groupBy(key).agg(F.sum("n").alias("n")).where("n > 0")
    upto = sums.withColumn("upto", F.sum("n").over(Window.orderBy(order)))
    row = upto.where(F.col("upto") > position).orderBy("upto").first()
    return None if row is None else (row[key], row["upto"] - row["n"])


def _cell_at(counts: DataFrame, position: int) -> tuple[object, object, int, int] | None:
    """Score, day and id block of the posting at a position, and the number of postings before that cell.

    Goes down by one key at a time, so what a window orders are the scores, then the days of one score, then the id blocks
    of one day: a few rows each, whatever the number of postings.
    """
    found, before = [], 0
    for key, order in (("score", F.desc_nulls_last("score")), ("date_posted", F.desc_nulls_last("date_posted")), ("id_block", F.asc("id_block"))):
        held = _holding(counts, key, order, position - before)
        if held is None:
            return None
        found.append(held[0])
        before += held[1]
        counts = counts.where(F.col(key).eqNullSafe(F.lit(held[0])))
    return *found, before


def _past(column: str, value, strictly_before: bool) -> Column:
    """Whether a value stands before, or after, the given one in descending order with nulls last."""
    if value is None:
        return F.col(column).isNotNull() if strictly_before else F.lit(False)
    if strictly_before:
        return F.coalesce(F.col(column) > F.lit(value), F.lit(False))
    return F.coalesce(F.col(column) < F.lit(value), F.lit(True))


def deep_page(df: DataFrame, counts: DataFrame, *, limit: int = 50, offset: int = 0) -> DataFrame:
    """The page of ``list_postings`` at an offset of any depth, read from its own range of the main order.

    ``counts`` are the ``order_counts`` of the same rows; they tell in which cells the page begins and ends. Only rows from
    the first to the last cell are read and sorted, none of the pages before, and of a score that a third of all postings
    have only the blocks of ids that the page falls in. Ids must be unique. An offset past the end gives an empty page.
    """
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    if offset >= total or limit <= 0:
        return df.where(F.lit(False))
    first, last = _cell_at(counts, offset), _cell_at(counts, min(offset + limit, total) - 1)
    same = lambda column, value: F.col(column).eqNullSafe(F.lit(value))

    def beyond(cell, strictly_before: bool, in_block: Column) -> Column:
        score, day = cell[:2]
        by_day = _past("date_posted", day, strictly_before) | (same("date_posted", day) & in_block)
        return _past("score", score, strictly_before) | (same("score", score) & by_day)

    rows = df.where(beyond(first, False, F.col("id") >= first[2] * ID_BLOCK) & beyond(last, True, F.col("id") < (last[2] + 1) * ID_BLOCK))
    if first[0] is not None and last[0] is not None:
        rows = rows.where(F.col("score").between(last[0], first[0]))  # plain bounds, which reach the scan
    return rows.orderBy(*main_order()).offset(offset - first[3]).limit(limit)


def list_threshold(status: str, min_score: int | None, min_display_score: int) -> int:
    """Minimum score of a list: what was asked for, else the display threshold, else 0 for filtered postings."""
    if min_score is not None:
        return min_score
    return 0 if status == "filtered" else min_display_score


def posted_range(df: DataFrame, as_of, *, days: int | None = None, since=None, until=None) -> DataFrame:
    """Posted between two days, both included. Postings without a date always pass."""
    if days is not None and (since is not None or until is not None):
        raise ValueError("days excludes since and until")

    def day(value) -> date:
        if isinstance(value, date):
            return value
        try:
            return date.fromisoformat(value)
        except ValueError as e:
            raise ValueError(f"invalid date: {value!r}, use YYYY-MM-DD") from e

    posted = F.col("date_posted")
    if days is not None:
        since = F.date_sub(as_date(as_of), days)
    elif since is not None:
        since = F.lit(day(since))
    if since is not None:
        df = df.where(posted.isNull() | (posted >= since))
    if until is not None:
        df = df.where(posted.isNull() | (posted <= F.lit(day(until))))
    return df


def fresh(df: DataFrame, as_of, hours_old: int) -> DataFrame:
    """Drop postings older than the look-back, counted in whole days and at least one."""
    return df.where(posted_within(F.col("date_posted"), as_of, hours_old))


def posted_within(posted: Column, as_of, hours_old: int) -> Column:
    """Whether a date lies in the look-back; a posting without a date does."""
    first = F.lit((parse_moment(as_of) - timedelta(days=max(1, hours_old // 24))).date())
    return posted.isNull() | (posted >= first)


def alert_state_condition(states: Column) -> Column:
    """Remote, no restriction, unknown state, or an allowed state."""
    normal = F.transform(states, lambda s: F.coalesce(state_code(strip(s)), strip(s)))
    return (
        F.coalesce(F.col("is_remote"), F.lit(False))
        | F.coalesce(F.size(states) <= 0, F.lit(True))
        | F.col("state").isNull()
        | F.coalesce(F.array_contains(normal, F.col("state")), F.lit(False))
    )


def alert_states_filter(df: DataFrame, states: list[str]) -> DataFrame:
    if not states:
        return df
    return df.where(alert_state_condition(F.array(*[F.lit(s) for s in states])))


def recent_context(df: DataFrame, as_of, days: int = 14, limit: int | None = 50) -> DataFrame:
    """Recently scraped or in an active status, in main order."""
    cutoff = moment(parse_moment(as_of) - timedelta(days=days))
    out = df.where((F.col("date_scraped") >= cutoff) | F.col("status").isin(ACTIVE_STATUSES)).orderBy(*main_order())
    return out if limit is None else out.limit(limit)


def rehydrated(df: DataFrame) -> DataFrame:
    """Stored postings as readers see them: places normalised again, no upper pay without a lower one, no null notes."""
    out = normalise_location(df)
    no_pay = F.col("comp_min").isNull()
    fields = {"comp_max": "double", "comp_currency": "string", "comp_interval": "string"}
    cleared = {c: F.when(~no_pay, F.col(c)).cast(t) for c, t in fields.items() if c in df.columns}
    return out.withColumns({**cleared, "notes": F.coalesce("notes", F.lit(""))}).select(*df.columns)


def by_id(df: DataFrame, posting_id: int) -> DataFrame:
    return df.where(F.col("id") == posting_id)


def existing(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Stored postings whose source key is among ``keys.dedup_key``."""
    return df.join(keys.select("dedup_key").distinct(), "dedup_key", "left_semi")


def zero_result(runs: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Runs without error that found nothing, unfinished ones included."""
    cutoff = moment(parse_moment(as_of) - timedelta(days=days))
    return runs.where(
        (F.coalesce("jobs_found", F.lit(0)) == 0) & F.col("error").isNull() & (F.col("started_at") >= cutoff)
    )


def alert_condition(min_alert_score: Column, states: Column) -> Column:
    """Newly inserted, no dealbreaker, high enough, and in an allowed place."""
    broken = F.coalesce(F.col("score_breakdown.dealbreaker"), F.lit(False))
    return F.col("is_new") & ~broken & (F.col("score") >= min_alert_score) & alert_state_condition(states)
