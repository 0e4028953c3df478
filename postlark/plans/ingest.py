"""Payloads to stored postings, run log and alerts, as one batch job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlark.functions.keys import content_key, dedup_key, matches_by_content
from postlark.functions.location import normalise_location
from postlark.functions.text import cap_description
from postlark.operators.filters import alert_condition, moment, posted_within
from postlark.operators.scoring import as_date, score
from postlark.operators.spread import cut, sequenced
from postlark.operators.upsert import Upserted, resolve
from postlark.profiles import Profile
from postlark.schemas import POSTINGS, RUNS, conform
from postlark.sources.cards import enrich_descriptions
from postlark.sources.payloads import extract, run_rows


ROW = ["run_id", "page_no", "pos"]
# So many narrow rows, of some hundred bytes, may be broadcast to meet texts.
HASHED_ROWS = 50_000


@dataclass(frozen=True)
class Limits:
    """Limits of a collector that fetches page by page. All are off: landed postings count whole.

    max_pages, wanted: pages and postings of a run. description_chars: characters stored. content_prefix: characters of
    the text in a content key. content_min_chars: texts up to this length aren't matched by content.
    """

    max_pages: int | None = None
    wanted: int | None = None
    description_chars: int | None = None
    content_prefix: int | None = None
    content_min_chars: int | None = None


# The limits of a collector with default settings.
COLLECTOR = Limits(max_pages=3, wanted=25, description_chars=50_000, content_prefix=500, content_min_chars=100)


@dataclass(frozen=True)
class Ingested:
    """arrivals: every posting found, in order, without its text. inserted: new postings, whole. updated: new score and status of stored
    ones. outcome: what became of each arrival. runs: the run log. alerts: new postings worth a message."""

    arrivals: DataFrame
    inserted: DataFrame
    updated: DataFrame
    outcome: DataFrame
    runs: DataFrame
    alerts: DataFrame


def is_broken() -> Column:
    return F.coalesce(F.col("score_breakdown.dealbreaker"), F.lit(False))


def prepared(rows: DataFrame, profile: Profile, as_of, limits: Limits = Limits()) -> DataFrame:
    """Extracted rows with normalised places, score, status and both keys. Every text is searched once."""
    out = score(normalise_location(rows), profile, as_of)
    parts = [F.col(c) for c in ("title", "company", "city", "state", "date_posted", "description")]
    return out.withColumns(
        {
            "dedup_key": dedup_key(F.col("source"), F.col("source_id")),
            "content_key": content_key(*parts, prefix=limits.content_prefix),
            "long": matches_by_content(F.col("description"), limits.content_min_chars),
            "description": cap_description(F.col("description"), limits.description_chars),
            "status": F.when(is_broken(), "filtered").otherwise("new"),
        }
    )


def arrivals(written: DataFrame, limits: Limits = Limits(), seen: DataFrame | None = None) -> DataFrame:
    """Which prepared rows arrive, numbered in arrival order, without their texts.

    First sightings and limits are settled on narrow rows of the written table.
    """
    narrow = written.drop("description")
    return sequenced(run_rows(narrow, limits.max_pages, limits.wanted, seen, narrow.columns), ROW)


def with_outcome(found: DataFrame, outcome: DataFrame) -> DataFrame:
    """Arrivals with their posting id and whether they were inserted."""
    ids = outcome.select("seq", F.col("target_id").alias("id"), (F.col("kind") == "insert").alias("is_new"))
    return found.join(ids, "seq")


def new_postings(written: DataFrame, found: DataFrame, resolved: Upserted, now) -> DataFrame:
    """Whole rows to insert, as they stand after the batch. Here, and only here, texts move."""
    values = resolved.inserted.join(found.select("seq", *ROW), "seq").drop("seq")
    wide = written.drop("score", "score_breakdown", "status").join(_hashed(values), ROW)
    stamped = wide.withColumns({"notes": F.lit(""), "created_at": moment(now), "updated_at": moment(now)})
    return conform(stamped, POSTINGS)


def _hashed(narrow: DataFrame) -> DataFrame:
    """Narrow rows that wide ones meet: in hash tables once they are too many to broadcast, so that texts are never sorted."""
    return F.broadcast(narrow) if narrow.limit(HASHED_ROWS + 1).count() <= HASHED_ROWS else narrow.hint("shuffle_hash")


def run_log(payloads: DataFrame, found: DataFrame, outcome: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """One row per run: everything found counts, new means inserted without a dealbreaker. Failed runs show 0 and
    their message; other runs are not affected."""
    runs = payloads.groupBy(F.col("run_id").alias("id")).agg(
        F.min("fetched_at").alias("started_at"),
        F.max("fetched_at").alias("finished_at"),
        F.min("site").alias("site"),
        F.min("search_term").alias("search_term"),
        F.min("location").alias("location"),
    )
    counts = with_outcome(found, outcome).groupBy(F.col("run_id").alias("id")).agg(
        F.count("*").cast("int").alias("jobs_found"),
        F.count_if(F.col("is_new") & ~is_broken()).cast("int").alias("jobs_new"),
    )
    out = runs.join(counts, "id", "left").fillna(0, ["jobs_found", "jobs_new"])
    if errors is not None:
        messages = errors.groupBy(F.col("run_id").alias("id")).agg(F.min("error").alias("error"))
        out = out.join(messages, "id", "left")
        failed = F.col("error").isNotNull()
        out = out.withColumns({c: F.when(failed, 0).otherwise(F.col(c)) for c in ("jobs_found", "jobs_new")})
    return conform(out, RUNS)


def ingest_counters(found: DataFrame, outcome: DataFrame) -> DataFrame:
    """Totals of one ingest: found and new leave dealbreakers out, which are counted as filtered."""
    return with_outcome(found, outcome).agg(
        F.count_if(~is_broken()).alias("total_found"),
        F.count_if(F.col("is_new") & ~is_broken()).alias("total_new"),
        F.count_if(is_broken()).alias("total_filtered"),
    )


def alerts(found: DataFrame, outcome: DataFrame, profile: Profile) -> DataFrame:
    """Inserted postings that deserve a message, with the score they arrived with."""
    states = F.array(*[F.lit(s) for s in profile.alert_states]).cast("array<string>")
    rows = with_outcome(found, outcome)
    return rows.where(alert_condition(F.lit(profile.min_alert_score), states)).drop("is_new", "long", "seen_key")


def preview(found: DataFrame, profile: Profile) -> DataFrame:
    """What a dry run shows: postings above the display score, and those with a dealbreaker."""
    return found.where((F.col("score") >= profile.min_display_score) | is_broken()).select(
        *ROW, "seq", "score", "company", "title", "city", "state", "is_remote", is_broken().alias("dealbreaker")
    )


def ingest(
    payloads: DataFrame,
    state: DataFrame | Callable[[DataFrame], DataFrame],
    profile: Profile,
    as_of,
    dry_run: bool = False,
    errors: DataFrame | None = None,
    sites: list[str] | None = None,
    limits: Limits = Limits(),
    details: DataFrame | None = None,
    hours_old: int | None = None,
    last_id: int = 0,
    seen: DataFrame | None = None,
) -> Ingested | DataFrame:
    """Extract, enrich, score, resolve against the stored postings, and describe every write. A dry run only previews.

    ``state`` are the stored postings, or a function that gives those which the arrivals can meet.
    Without ``sites`` every registered extractor gets its share of the payloads. ``details`` are landed detail pages of
    card postings, whose texts then count in scores and keys. ``hours_old`` drops postings with an older date.
    ``last_id`` is the highest id ever issued, ``seen`` are first sightings (run_id, seen_key) of earlier batches.
    Every landed posting counts unless ``limits`` says otherwise.
    """
    rows = extract(payloads, as_of, sites)
    if details is not None:
        rows = enrich_descriptions(rows, details)
    if hours_old is not None:
        # A page row stays, as it may count for the limits of its run.
        old = ~posted_within(F.col("date_posted"), as_of, hours_old)
        rows = rows.withColumn("seen_key", F.when(~old, F.col("seen_key")))
    written = cut(prepared(rows, profile, as_date(as_of), limits))
    found = arrivals(written, limits, seen)
    if dry_run:
        return preview(found, profile)
    resolved = resolve(state(found) if callable(state) else state, found, last_id)
    chosen = cut(alerts(found, resolved.outcome, profile))
    texts = written.select(*ROW, "description").join(_hashed(chosen.select(*ROW)), ROW, "left_semi")
    return Ingested(
        found,
        new_postings(written, found, resolved, as_of),
        resolved.updated,
        resolved.outcome,
        run_log(payloads, found, resolved.outcome, errors),
        chosen.join(texts, ROW),
    )
