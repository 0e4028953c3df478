"""Statistics kept up to date: signed counts per cell, added up instead of read from all postings.

A cell is what the statistics tell apart of a posting: source, status, score, search term and day. Every committed batch
leaves the difference it makes, so the counts are sums over narrow rows, as many as there are cells and batches.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlark.operators.filters import parse_moment
from postlark.operators.stats import tier

CELL = ["source", "status", "score", "search_term", "day"]


def cells(rows: DataFrame, sign: int = 1) -> DataFrame:
    """Postings as cells with their number, or less than none of it."""
    keyed = rows.select("source", "status", "score", "search_term", F.to_date("date_scraped").alias("day"))
    return keyed.groupBy(*CELL).agg((F.count("*") * sign).alias("n"))


def folded(parts: DataFrame) -> DataFrame:
    """Cells of any number of batches as one; what cancels out is gone."""
    return parts.groupBy(*CELL).agg(F.sum("n").alias("n")).where("n <> 0")


def _counted(rows: DataFrame, name: str, by: Column | str, count: str = "cnt") -> DataFrame:
    column = F.col(by) if isinstance(by, str) else by
    return rows.groupBy(column.alias(name)).agg(F.sum("n").alias(count)).where(F.col(count) != 0)


def by_status(rows: DataFrame) -> DataFrame:
    return _counted(rows, "status", "status")


def by_source(rows: DataFrame) -> DataFrame:
    return _counted(rows, "source", "source")


def score_tiers(rows: DataFrame) -> DataFrame:
    return _counted(rows.where("score > 0"), "tier", tier(F.col("score")))


def by_search_term(rows: DataFrame) -> DataFrame:
    kept = rows.where(F.col("search_term").isNotNull() & (F.col("status") != "filtered"))
    known = F.when(F.col("score").isNotNull(), F.col("n"))
    mean = F.sum((F.col("score") * F.col("n")).cast("double")) / F.sum(known)
    out = kept.groupBy("search_term").agg(F.sum("n").alias("cnt"), F.round(mean, 1).alias("avg_score")).where("cnt <> 0")
    return out.orderBy(F.desc("avg_score"), "search_term")


def daily_trend(rows: DataFrame, as_of, days: int, threshold: int) -> DataFrame:
    first = F.lit((parse_moment(as_of) - timedelta(days=days)).date())
    part = lambda held: F.coalesce(F.sum(F.when(held, F.col("n"))), F.lit(0))
    s = F.col("score")
    out = rows.where(F.col("day") >= first).groupBy("day")
    out = out.agg(F.sum("n").alias("total"), part(s >= threshold).alias("high"), part((s >= 40) & (s < threshold)).alias("medium"))
    return out.where("total <> 0").orderBy(F.desc("day"))
