"""Streaming jobs: the same batch functions, one micro-batch at a time.

A batch takes its clock from its own data unless one is given, and reads the store as it was before, so a replay writes
the same rows to the same partitions. Sightings of earlier batches count, so a run may land in any number of batches.
A batch opens the buckets of the store that its keys fall in, so its cost follows the batch, not the store.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from postlark.operators.filters import moment
from postlark.operators.maintenance import apply_status_events, route_messages
from postlark.operators.spread import cut, scratch
from postlark.operators.upsert import STORED
from postlark.plans.ingest import ingest
from postlark.profiles import Profile
from postlark.sources.payloads import stream_payloads
from postlark.streaming.store import Store

# The pages of a run land within so many days of each other; older sightings are not looked at and may be deleted.
RUN_DAYS = 30
STATUS_EVENTS = "seq bigint, posting_id bigint, status string, notes string, event_date date"


def ingest_batch(store: Store, profile: Profile, as_of=None, run_days: int = RUN_DAYS, **options):
    def run(payloads: DataFrame, batch_id: int) -> None:
        now = as_of or payloads.agg(F.max("fetched_at")).first()[0]
        if now is None:
            return
        with scratch(store.spark):
            apply(payloads, ("ingest", batch_id), now)

    def apply(payloads: DataFrame, own: tuple[str, int], now) -> None:
        times = payloads.groupBy("run_id").agg(F.min("fetched_at").alias("first"))
        first = payloads.agg(F.min("fetched_at")).first()[0]
        since = F.date_sub(F.lit(first).cast("date"), run_days)
        seen = store.seen(times, since, own)
        stored = lambda found: cut(store.matching(found, own).select(*STORED))
        done = ingest(payloads, stored, profile, now, last_id=store.last_id(own), seen=seen, **options)
        changed = done.updated.withColumn("updated_at", moment(now))
        sighted = done.arrivals.select("run_id", "seen_key").join(times.select("run_id", F.to_date(F.coalesce("first", F.lit(first))).alias("day")), "run_id")
        store.commit(*own, inserted=done.inserted, changed=changed, runs=done.runs, alerts=done.alerts, seen=sighted)

    return run


def status_batch(store: Store):
    def run(events: DataFrame, batch_id: int) -> None:
        own = ("status", batch_id)
        now = events.agg(F.max("event_date")).first()[0]
        if now is None:
            return
        touched = events.select(F.col("posting_id").alias("id")).distinct()
        rows = store.by_ids(touched, own)
        state, missed = apply_status_events(rows, events, moment(now))
        changed = state.select("id", "status", "notes", "applied_date", "updated_at")
        store.commit(*own, changed=changed, misses=missed)

    return run


def start_ingest(
    spark: SparkSession, path: str, store: Store, profile: Profile, checkpoint: str, max_files: int | None = None, **options
) -> StreamingQuery:
    """Ingest all payload files that landed since the last run, then stop."""
    source = stream_payloads(spark, path, max_files=max_files)
    writer = source.writeStream.foreachBatch(ingest_batch(store, profile, **options))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_status(
    spark: SparkSession, path: str, store: Store, checkpoint: str, max_files: int | None = None
) -> StreamingQuery:
    """Apply status events that arrived since the last run, then stop. The checkpoint is the saved offset."""
    reader = spark.readStream.schema(STATUS_EVENTS)
    source = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).json(path)
    writer = source.writeStream.foreachBatch(status_batch(store))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_messages(streams: list[DataFrame], routes: DataFrame) -> DataFrame:
    """Messages of several sources as one stream, each with the profile of its chat."""
    return route_messages(reduce(DataFrame.unionByName, streams), routes)


def continuous_trend(scored: DataFrame, threshold: int, lateness: str = "1 day") -> DataFrame:
    """Postings, high and medium scores per day over a stream of scored postings."""
    timed = scored.withColumn("_at", F.col("date_scraped").cast("timestamp")).withWatermark("_at", lateness)
    s = F.col("score")
    counted = timed.groupBy(F.window("_at", "1 day")).agg(
        F.count("*").alias("total"),
        F.count_if(s >= threshold).alias("high"),
        F.count_if((s >= 40) & (s < threshold)).alias("medium"),
    )
    return counted.select(F.to_date("window.start").alias("day"), "total", "high", "medium")
