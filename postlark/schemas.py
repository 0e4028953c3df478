"""Column layouts of the tables the jobs read and write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Accepted sites, job types, pay intervals and statuses.
SITES = ["linkedin", "indeed", "google", "glassdoor", "ziprecruiter", "bayt"]
JOB_TYPES = ["full_time", "part_time", "contract", "internship", "temporary"]
INTERVALS = ["yearly", "monthly", "weekly", "daily", "hourly"]
ACTIVE_STATUSES = ["applied", "interview", "offer"]
UPDATE_STATUSES = ["applied", "interview", "offer", "rejected"]
# Which status survives deduplication first.
STATUS_PRIORITY = {"offer": 0, "interview": 1, "applied": 2, "new": 3, "filtered": 4, "rejected": 5}

BREAKDOWN = "struct<keyword:int,company:int,title:int,recency:int,dealbreaker:boolean>"

PAYLOADS = (
    "run_id bigint, site string, search_term string, location string, page_no int, fetched_at timestamp_ntz, "
    "status_code int, url string, body string"
)

# One extracted posting, before identity keys and score.
EXTRACTED = (
    "run_id bigint, source string, search_term string, location string, page_no int, pos int, "
    "source_id string, url string, title string, company string, city string, state string, country string, "
    "is_remote boolean, description string, job_type array<string>, comp_min double, comp_max double, "
    "comp_currency string, comp_interval string, date_posted date, date_scraped timestamp_ntz"
)

POSTINGS = (
    "id bigint, dedup_key string, source string, source_id string, url string, title string, company string, "
    "city string, state string, country string, is_remote boolean, description string, job_type array<string>, "
    "comp_min double, comp_max double, comp_currency string, comp_interval string, date_posted date, "
    f"date_scraped timestamp_ntz, score int, score_breakdown {BREAKDOWN}, status string, notes string, "
    "applied_date date, search_term string, content_key string, created_at timestamp_ntz, updated_at timestamp_ntz"
)

RUNS = (
    "id bigint, started_at timestamp_ntz, finished_at timestamp_ntz, site string, search_term string, "
    "location string, jobs_found int, jobs_new int, error string"
)


def column_names(layout: str) -> list[str]:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(layout).fieldNames()


def conform(df: DataFrame, layout: str) -> DataFrame:
    """Select the layout's columns in order; columns the input lacks become nulls of the right type.

    This is also the schema upgrade: tables written before a column existed gain it, and a second pass changes nothing.
    """
    from pyspark.sql.types import StructType

    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in StructType.fromDDL(layout).fields
        ]
    )
