"""Messages, digests, reports and exports as tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from postlark.functions.dates import age_label
from postlark.functions.location import location_display
from postlark.functions.pay import comp_display, comp_display_concise
from postlark.functions.text import cut_to, escape
from postlark.operators.filters import (
    alert_states_filter,
    apply_filters,
    list_postings,
    main_order,
    parse_moment,
    posted_range,
)
from postlark.operators.scoring import as_date
from postlark.operators.spread import numbered
from postlark.operators.stats import alert_stats, daily_trend, top_per

# Columns of an export, in order.
EXPORT_FIELDS = [
    "id", "score", "company", "title", "location", "salary", "date_posted", "source", "status", "url",
]
CHANNELS = ["email", "telegram", "slack", "discord", "macos"]
REPORT_FLOOR = 40
APP = "postlark"


def place() -> Column:
    return location_display(F.col("city"), F.col("state"), F.col("is_remote"))


def concise_pay() -> Column:
    return comp_display_concise(F.col("comp_min"), F.col("comp_max"))


# --- exports ---


def export_rows(df: DataFrame) -> DataFrame:
    """Postings flattened to the export columns; missing texts become ''."""
    shaped = {
        "location": place(),
        "salary": comp_display(F.col("comp_min"), F.col("comp_max"), F.col("comp_interval")),
        "date_posted": F.coalesce(F.date_format("date_posted", "yyyy-MM-dd"), F.lit("")),
    }
    kept = [c for c in ("score_breakdown",) if c in df.columns]
    return df.select(*[shaped.get(c, F.col(c)).alias(c) for c in EXPORT_FIELDS], *kept)


def export_format(path: str, fmt: str | None) -> str:
    if fmt:
        return fmt.lower()
    return "json" if path.lower().endswith(".json") else "csv"


def write_csv(rows: DataFrame, path: str) -> int:
    """Write export columns as CSV with a header, quotes doubled and '' unquoted; returns the row count."""
    counted = Observation()
    out = rows.select(*EXPORT_FIELDS).observe(counted, F.count(F.lit(1)).alias("n"))
    out.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return counted.get["n"]


def write_json(rows: DataFrame, path: str) -> int:
    """Write export columns and the score breakdown as JSON Lines; returns the row count."""
    counted = Observation()
    rows.observe(counted, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return counted.get["n"]


def export_postings(
    df: DataFrame, path: str, as_of, fmt: str | None = None, days=None, since=None, until=None, **filters
) -> int:
    """Write the matching postings in main order: a folder of part files that sort like the postings."""
    kind = export_format(path, fmt)
    chosen = posted_range(apply_filters(df, **filters), as_of, days=days, since=since, until=until)
    rows = export_rows(chosen.orderBy(*main_order()))
    if kind == "json":
        return write_json(rows, path)
    if kind == "csv":
        return write_csv(rows, path)
    raise ValueError(f"unknown export format: {kind}")


# Column widths of a terminal.
LIST_WIDTHS = {"company": 14, "title": 32, "location": 16, "src": 4}
CHANGE_WIDTHS = {"company": 16, "title": 36}


def list_view(df: DataFrame, as_of, widths: dict[str, int] | None = None, **filters) -> DataFrame:
    """The list as shown to a reader with an age label; texts are whole, or cut to the widths given by column."""
    rows = list_postings(df, **filters)
    shown = {"company": F.col("company"), "title": F.col("title"), "location": place(), "src": F.col("source")}
    cut = {name: cut_to(c, (widths or {}).get(name)).alias(name) for name, c in shown.items()}
    age = age_label(F.col("date_posted"), as_date(as_of)).alias("posted")
    return rows.select("id", "score", cut["company"], cut["title"], cut["location"], age, cut["src"])


def context_line() -> Column:
    """'#id | company | title | place | score:N | status:S'."""
    return F.concat_ws(
        " | ",
        F.concat(F.lit("#"), F.col("id").cast("string")),
        F.col("company"),
        F.col("title"),
        place(),
        F.concat(F.lit("score:"), F.col("score").cast("string")),
        F.concat(F.lit("status:"), F.col("status")),
    )


# --- messages ---


def message_line(channel: str) -> Column:
    """One posting as the given channel shows it."""
    company, title = escape(F.col("company"), channel), escape(F.col("title"), channel)
    spot, pay, url = escape(place(), channel), escape(concise_pay(), channel), F.col("url")
    points = F.col("score").cast("string")
    words = F.coalesce(F.col("score_breakdown.keyword").cast("string"), F.lit("?"))
    has_id = F.coalesce(F.col("id") != 0, F.lit(False))
    tag = F.when(has_id, F.concat(F.lit("#"), F.col("id").cast("string"), F.lit(" "))).otherwise("")
    bar = F.lit(" | ")
    if channel == "telegram":
        bar = F.lit(r" \| ")
        tag = F.when(tag != "", F.concat(F.lit("\\"), tag)).otherwise("")
    where = F.concat(F.lit("  "), spot, F.when(pay != "", F.concat(bar, pay)).otherwise(""))
    if channel == "email":
        return F.format_string("[%s] (kw:%s) %s%s: %s\n%s\n  %s\n", points, words, tag, company, title, where, url)
    if channel == "telegram":
        return F.format_string(
            "*%s* \\(kw:%s\\) \\| %s[%s: %s](%s)\n%s", points, words, tag, company, title, url, where
        )
    if channel in ("slack", "discord"):
        mark = "*" if channel == "slack" else "**"
        shape = f"{mark}%s: %s{mark}\nScore: %s | keywords: %s | %s%s\n%s"
        return F.format_string(shape, company, title, points, words, tag, where, url)
    if channel == "macos":
        return F.format_string("%s: %s (%s)", company, title, points)
    raise ValueError(f"unknown channel: {channel}")


def alert_batch(df: DataFrame, channel: str, profile: str = "default", batch_id: int = 0) -> DataFrame:
    """Alerts as rows, best first, none left out: (profile, channel, batch_id, rank, posting_id, message_line).

    The rank follows score and id and is numbered by range, so a batch of any size is never sorted in one task.
    """
    rows = df.select("id", "score", message_line(channel).alias("message_line"))
    ranked = numbered(rows, [F.desc("score"), F.asc("id")])
    return ranked.select(
        F.lit(profile).alias("profile"),
        F.lit(channel).alias("channel"),
        F.lit(batch_id).cast("bigint").alias("batch_id"),
        "rank",
        F.col("id").alias("posting_id"),
        "message_line",
    )


def message_prefix(channel: str, profile: str, digest: bool = False) -> str:
    """Who is speaking, in the channel's own mark-up."""
    named = "" if profile == "default" else profile
    word = " digest" if digest else ""
    if channel == "telegram":
        return f"*{APP} \\({named}\\){word}*" if named else f"*{APP}{word}*"
    plain = f"{APP} ({named})" if named else APP
    if channel == "slack":
        return f"*{plain}{word}*"
    if channel == "discord":
        return f"**{plain}{word}**"
    return plain + word


def macos_summary(alerts: DataFrame, profile: str = "default") -> DataFrame:
    """Title and body of a desktop note: one posting by name, several as a count with the best three."""
    top = top_per(alerts, None, [F.desc("score"), F.asc("id")], 3)
    line = message_line("macos")
    best = top.agg(
        F.array_sort(F.collect_list(F.struct("rank", line.alias("line"), "company", "title", "score"))).alias("best")
    )
    n = alerts.agg(F.count("*").alias("n"))
    prefix = message_prefix("macos", profile)
    one = F.get("best", F.lit(0))
    body = F.array_join(F.transform("best", lambda b: b["line"]), "\\n")
    rest = F.when(F.col("n") > 3, F.format_string("\\n... and %d more", F.col("n") - 3)).otherwise("")
    out = best.join(F.broadcast(n)).where("n > 0")
    return out.select(
        F.when(F.col("n") == 1, F.concat(F.lit(f"{prefix}: "), one["company"]))
        .otherwise(F.format_string(f"{prefix}: %d new matches", F.col("n")))
        .alias("title"),
        F.when(F.col("n") == 1, F.format_string("%s (Score: %d)", one["title"], one["score"]))
        .otherwise(F.concat(body, rest))
        .alias("body"),
    ).select(*[escape(F.col(c), "macos").alias(c) for c in ("title", "body")])


def new_matches(df: DataFrame, as_of, min_score: int, states: list[str], hours: int = 24) -> DataFrame:
    """Unreviewed postings of the window, high enough and in an allowed place."""
    since = parse_moment(as_of) - timedelta(hours=hours)
    return alert_states_filter(apply_filters(df, status="new", min_score=min_score, since=since), states)


def digest_rows(df: DataFrame, as_of, min_alert_score: int, states: list[str], k: int = 10) -> DataFrame:
    """The best ``k`` matches of the last day with the number of all matches on every row."""
    found = new_matches(df, as_of, min_alert_score, states)
    top = top_per(found, None, main_order(), k)
    return top.join(F.broadcast(found.agg(F.count("*").alias("matches"))))


def digest_text(df: DataFrame, as_of, channel: str, min_alert_score: int, states: list[str], profile="default") -> DataFrame:
    """The digest as one text; at most ten postings go into it. No row when there is no match."""
    rows = digest_rows(df, as_of, min_alert_score, states)
    lines = rows.groupBy("matches").agg(
        F.array_sort(F.collect_list(F.struct("rank", message_line(channel).alias("line")))).alias("lines")
    )
    counts = alert_stats(df, as_of, 24, min_alert_score)
    head = message_prefix(channel, profile, digest=True)
    many, bar, window = "match(es)", "|", " in the last 24h" if channel == "email" else ""
    if channel == "telegram":
        many, bar = "match\\(es\\)", "\\|"
    header = F.format_string(f"{head} — %d {many}{window}\n", F.col("matches"))
    footer = F.format_string(f"\n\U0001f4ca %d unreviewed {bar} %d scraped today", F.col("total_new"), F.col("scraped"))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return lines.join(F.broadcast(counts)).select(F.concat_ws("\n", header, body, footer).alias("text"))


# --- daily report ---


def report_tables(df: DataFrame, as_of, alert_score: int, states: list[str] | None = None, k: int = 20) -> dict[str, DataFrame]:
    """Summary counts, best matches, worth-a-look matches with their total, and the seven-day trend."""
    found = new_matches(df, as_of, REPORT_FLOOR, states or [])
    medium = found.where(F.col("score") < alert_score)
    shown = ["rank", "id", "score", "title", "company", "location", "comp", "url"]

    def table(rows: DataFrame) -> DataFrame:
        top = top_per(rows, None, main_order(), k)
        return top.withColumn("location", place()).withColumn("comp", concise_pay()).select(*shown)

    return {
        "summary": alert_stats(df, as_of, 24, alert_score),
        "high": table(found.where(F.col("score") >= alert_score)),
        "medium": table(medium),
        "medium_total": medium.agg(F.count("*").alias("cnt")),
        "trend": daily_trend(df, as_of, 7, alert_score),
    }


def report_text(tables: dict[str, DataFrame], alert_score: int, as_of, profile: str = "default") -> DataFrame:
    """The report tables as one Markdown text. Its parts are bounded: top lists and one line per day."""
    named = "" if profile == "default" else f" ({profile})"
    band = f"{REPORT_FLOOR}-{alert_score - 1}"

    def listing(name: str, title: str) -> DataFrame:
        line = F.format_string(
            "| %d | %s | %s | %s | %s | [apply](%s) |", *[F.col(c) for c in ("score", "title", "company", "location", "comp", "url")]
        )
        lines = tables[name].agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
        head = f"## {title}\n\n| Score | Title | Company | Location | Comp | Link |\n|---|---|---|---|---|---|\n"
        body = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
        return lines.select(F.when(F.size("l") > 0, F.concat(F.lit(head), body)).alias(name))

    summary = tables["summary"].select(
        F.format_string(
            f"## Summary\n\n| Metric | Count |\n|---|---|\n| Scraped (24h) | %d |\n| High match (>={alert_score}) | %d |\n"
            f"| Worth review ({band}) | %d |\n| Total unreviewed | %d |",
            F.col("scraped"), F.col("high_count"), F.col("medium_count"), F.col("total_new"),
        ).alias("summary")
    )
    more = tables["medium_total"].select(
        F.when(F.col("cnt") > 20, F.format_string("*(showing top 20 of %d)*", F.col("cnt"))).alias("more")
    )
    day_line = F.format_string("| %s | %d | %d | %d |", F.col("day").cast("string"), "total", "high", "medium")
    days = tables["trend"].agg(F.sort_array(F.collect_list(F.struct("day", day_line.alias("line"))), False).alias("d"))
    trend_head = f"## 7-Day Trend\n\n| Date | Total | High (>={alert_score}) | Medium ({band}) |\n|---|---|---|---|\n"
    trend = days.select(
        F.when(
            F.size("d") > 0, F.concat(F.lit(trend_head), F.array_join(F.transform("d", lambda x: x["line"]), "\n"))
        ).alias("trend")
    )
    title = f"# Daily report{named} — {parse_moment(as_of):%Y-%m-%d}"
    out = summary
    for part in (listing("high", f"High match (score >= {alert_score})"), listing("medium", f"Worth review ({band})"), more, trend):
        out = out.join(F.broadcast(part))
    return out.select(F.concat_ws("\n\n", F.lit(title), "summary", "high", "medium", "more", "trend").alias("text"))

