"""Upkeep of a store: each job works out its changes and commits them as one batch. What a job returns is what it did."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlark.operators.dedup import removed_ids
from postlark.operators.filters import apply_filters, moment
from postlark.operators.maintenance import backfill_content_keys, change_log, location_fixes, rescored
from postlark.operators.spread import cut
from postlark.profiles import Profile
from postlark.streaming.store import Store


def rescore_store(
    store: Store, batch_id: int, profile: Profile, as_of, status: str | None = None, source: str | None = None
) -> DataFrame:
    """Score the chosen postings again, store what moved, and give the change log."""
    chosen = apply_filters(store.state(("rescore", batch_id)), status=status, source=source)
    looked = cut(rescored(chosen, profile, as_of))
    keep = lambda new, old: F.when(F.col("score_changed"), F.col(new)).otherwise(F.col(old)).alias(new)
    moved = looked.where(F.col("score_changed") | (F.col("status") != F.col("new_status"))).select(
        "id", keep("score", "old_score"), keep("score_breakdown", "old_breakdown"), F.col("new_status").alias("status"),
        moment(as_of).alias("updated_at"),
    )
    store.commit("rescore", batch_id, changed=moved)
    return change_log(looked)


def deduplicate_store(store: Store, batch_id: int) -> DataFrame:
    """Remove all but the best posting of each content key; gives the removed ids."""
    narrow = store.state(("dedup", batch_id)).select("id", "content_key", "status", "score", "date_scraped")
    gone = cut(removed_ids(narrow))
    store.commit("dedup", batch_id, removed=gone)
    return gone


def backfill_store(store: Store, batch_id: int) -> DataFrame:
    """Fill missing content keys; gives the filled ids."""
    # Which ones they are is told by narrow rows; only their texts are read.
    own = ("backfill", batch_id)
    ids = cut(store.state(own).where("content_key is null").select("id"))
    missing = store.by_ids(ids, own).where("content_key is null")
    filled = cut(backfill_content_keys(missing).select("id", "content_key"))
    store.commit("backfill", batch_id, changed=filled)
    return filled.select("id")


def fix_store_locations(store: Store, batch_id: int, as_of) -> DataFrame:
    """Store normalised places; gives the counts per reason."""
    fixes = cut(location_fixes(store.state(("locations", batch_id))).where("changed"))
    fixed = [F.col(f"fixed_{c}").alias(c) for c in ("city", "state", "country")]
    store.commit("locations", batch_id, changed=fixes.select("id", *fixed, moment(as_of).alias("updated_at")))
    return fixes.groupBy("reason").agg(F.count("*").alias("cnt"))
