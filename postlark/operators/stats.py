"""Counts, averages and trends. Each is one aggregate with partial sums before any shuffle."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlark.operators.filters import moment, parse_moment, zero_result


def by_status(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(F.count("*").alias("cnt"))


def total_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def by_source(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count("*").alias("cnt"))


def tier(score: Column) -> Column:
    # Tier names and their lower bounds.
    named = F.when(score >= 80, "excellent (80+)").when(score >= 55, "good (55-79)").when(score >= 30, "review (30-54)")
    return named.otherwise("low (<30)")


def score_tiers(df: DataFrame) -> DataFrame:
    return df.where("score > 0").groupBy(tier(F.col("score")).alias("tier")).agg(F.count("*").alias("cnt"))


def by_search_term(df: DataFrame) -> DataFrame:
    kept = df.where(F.col("search_term").isNotNull() & (F.col("status") != "filtered"))
    out = kept.groupBy("search_term").agg(
        F.count("*").alias("cnt"), F.round(F.avg(F.col("score").cast("double")), 1).alias("avg_score")
    )
    return out.orderBy(F.desc("avg_score"), "search_term")


def alert_stats(df: DataFrame, as_of, hours: int = 24, threshold: int = 55) -> DataFrame:
    """One pass. Unreviewed postings are counted over all time, the rest within the window."""
    recent = F.col("date_scraped") >= moment(parse_moment(as_of) - timedelta(hours=hours))
    s = F.col("score")
    return df.agg(
        F.count_if(F.col("status") == "new").alias("total_new"),
        F.count_if(recent).alias("scraped"),
        F.count_if(recent & (s >= threshold)).alias("high_count"),
        F.count_if(recent & (s >= 40) & (s < threshold)).alias("medium_count"),
    )


def daily_trend(df: DataFrame, as_of, days: int, threshold: int) -> DataFrame:
    """Per scrape day, newest first; days without postings are not filled in."""
    cutoff = F.lit((parse_moment(as_of) - timedelta(days=days)).date())
    day, s = F.to_date("date_scraped"), F.col("score")
    first_moment = cutoff.cast("timestamp_ntz")
    return (
        df.where(F.col("date_scraped") >= first_moment)
        .groupBy(day.alias("day"))
        .agg(
            F.count("*").alias("total"),
            F.count_if(s >= threshold).alias("high"),
            F.count_if((s >= 40) & (s < threshold)).alias("medium"),
        )
        .orderBy(F.desc("day"))
    )


def recent_runs(runs: DataFrame, limit: int = 5) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("id")).limit(limit)


def zero_result_count(runs: DataFrame, as_of) -> DataFrame:
    return zero_result(runs, as_of).agg(F.count("*").alias("cnt"))


def zero_result_recent(runs: DataFrame, as_of, limit: int = 10) -> DataFrame:
    out = zero_result(runs, as_of).orderBy(F.desc("started_at"), F.desc("id")).limit(limit)
    return out.select("site", "search_term", "location", "started_at")


def stats(postings: DataFrame, runs: DataFrame, as_of) -> dict[str, DataFrame]:
    return {
        "by_status": by_status(postings),
        "total": total_count(postings),
        "by_source": by_source(postings),
        "score_distribution": score_tiers(postings),
        "recent_runs": recent_runs(runs),
        "zero_result_count": zero_result_count(runs, as_of),
        "zero_result_runs": zero_result_recent(runs, as_of),
        "by_search_term": by_search_term(postings),
    }


def top_per(df: DataFrame, by: str | None, order: list, k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group. The limit is applied inside every task before rows are shuffled."""
    keys = [by] if by else []
    if not keys:
        top = df.orderBy(*order).limit(k)
        return top.withColumn(rank, F.row_number().over(Window.orderBy(*order)))
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
