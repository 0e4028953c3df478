"""Content duplicates: groups, keepers and removal.

A single content key may own a large share of the table, so groups are never gathered: keepers come from an
aggregate that is combined inside every task, and rows are then matched by their unique id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlark.functions.lookups import lookup
from postlark.operators.spread import attach
from postlark.schemas import STATUS_PRIORITY


def status_priority(status: Column) -> Column:
    """Rank of a status when duplicates compete; unknown ones come last."""
    return F.coalesce(lookup({k: str(v) for k, v in STATUS_PRIORITY.items()}, status).cast("int"), F.lit(99))


def duplicate_groups(df: DataFrame) -> DataFrame:
    """Content keys held by more than one posting."""
    keyed = df.where(F.col("content_key").isNotNull())
    return keyed.groupBy("content_key").agg(F.count("*").alias("cnt")).where("cnt > 1")


def duplicate_members(df: DataFrame) -> DataFrame:
    """The postings of all duplicate groups with their group size."""
    narrow = df.where(F.col("content_key").isNotNull()).select(
        "content_key", "id", "status", "score", "date_scraped"
    )
    return attach(narrow, duplicate_groups(df), "content_key").where(F.col("cnt").isNotNull())


def keepers(df: DataFrame) -> DataFrame:
    """One row per content key: the id to keep and the group size. Best status, then score, then age, then id."""
    order = F.struct(
        status_priority(F.col("status")).alias("prio"),
        (-F.col("score")).alias("neg_score"),
        F.col("date_scraped").alias("date_scraped"),
        F.col("id").alias("id"),
    )
    grouped = df.where(F.col("content_key").isNotNull()).groupBy("content_key")
    best = grouped.agg(F.min(order).alias("best"), F.count("*").alias("cnt"))
    return best.select("content_key", F.col("best.id").alias("id"), "cnt")


def removed_ids(df: DataFrame) -> DataFrame:
    keyed = df.where(F.col("content_key").isNotNull()).select("id")
    return keyed.join(keepers(df).select("id"), "id", "left_anti")


def deduplicate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, removed). Rows without a content key are kept; only ids travel between the two steps."""
    gone = removed_ids(df)
    return df.join(gone, "id", "left_anti"), df.join(gone, "id", "left_semi")


def dedup_summary(df: DataFrame) -> DataFrame:
    """Groups, rows removed and rows kept among the duplicates."""
    groups = duplicate_groups(df).agg(
        F.count("*").alias("groups"), F.coalesce(F.sum(F.col("cnt") - 1), F.lit(0)).cast("bigint").alias("removed")
    )
    return groups.withColumn("kept", F.col("groups"))
