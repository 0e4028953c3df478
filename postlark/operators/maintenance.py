"""Changes to stored postings: status workflow, rescoring, key backfill and location repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlark.functions.keys import content_key
from postlark.functions.location import normalise_location
from postlark.functions.text import cut_to
from postlark.operators.filters import apply_filters
from postlark.operators.scoring import score
from postlark.operators.spread import cut, settled
from postlark.profiles import Profile
from postlark.schemas import ACTIVE_STATUSES, UPDATE_STATUSES


def folded_events(events: DataFrame) -> DataFrame:
    """One row per posting: last status, last non-empty notes, first day of an active status.

    Plain aggregates, so a posting with very many events is reduced inside every task first.
    """
    filled = F.when(F.coalesce(F.col("notes"), F.lit("")) != "", F.struct("seq", "notes"))
    active = F.when(F.col("status").isin(ACTIVE_STATUSES), F.struct("seq", "event_date"))
    return (
        events.groupBy("posting_id")
        .agg(
            F.max(F.struct("seq", "status")).alias("_status"),
            F.max(filled).alias("_notes"),
            F.min(active).alias("_applied"),
        )
        .select(
            F.col("posting_id"),
            F.col("_status.status").alias("new_status"),
            F.col("_notes.notes").alias("new_notes"),
            F.col("_applied.event_date").alias("first_applied"),
        )
    )


def apply_status_events(df: DataFrame, events: DataFrame, as_of: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(state, not_found). Events (seq, posting_id, status, notes, event_date) apply in seq order.

    Empty notes do not overwrite, the applied date is set once, and unknown ids are reported while the rest applies.
    """
    folded = folded_events(events)
    joined = df.join(folded, df["id"] == folded["posting_id"], "left")
    changed = {
        "status": F.coalesce("new_status", "status"),
        "notes": F.coalesce("new_notes", "notes"),
        "applied_date": F.coalesce("applied_date", "first_applied"),
    }
    if as_of is not None and "updated_at" in df.columns:
        changed["updated_at"] = F.when(F.col("posting_id").isNotNull(), as_of).otherwise(F.col("updated_at"))
    state = joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in df.columns])
    missing = folded.join(df.select(F.col("id").alias("posting_id")), "posting_id", "left_anti").select("posting_id")
    return state, missing


def valid_updates(reply: Column) -> Column:
    """Usable updates in a JSON reply; entries without a whole-number id or a known status are dropped."""
    parsed = F.from_json(reply, "updates array<struct<job_id:string,status:string,notes:string>>")
    updates = F.coalesce(parsed["updates"], F.array().cast("array<struct<job_id:string,status:string,notes:string>>"))
    typed = F.transform(
        updates,
        lambda u: F.struct(
            F.when(u["job_id"].rlike(r"\A-?\d+\z"), u["job_id"]).try_cast("bigint").alias("job_id"),
            u["status"].alias("status"),
            F.coalesce(u["notes"], F.lit("")).alias("notes"),
        ),
    )
    return F.filter(
        typed,
        lambda u: u["job_id"].isNotNull() & F.coalesce(u["status"].isin(UPDATE_STATUSES), F.lit(False)),
    )


def route_messages(messages: DataFrame, routes: DataFrame, chars: int | None = None) -> DataFrame:
    """Messages with the profile their chat belongs to; unknown chats are dropped. Texts stay whole, or with ``chars``
    keep their first characters."""
    routed = messages.join(routes.select("chat_id", "profile"), "chat_id")
    return routed if chars is None else routed.withColumn("text", F.substring("text", 1, chars))


def rescored(df: DataFrame, profile: Profile, as_of) -> DataFrame:
    """Every posting with its old score and status, the new score, and what has to change."""
    old = df.withColumnRenamed("score", "old_score").withColumnRenamed("score_breakdown", "old_breakdown")
    new = score(old, profile, as_of)
    broken = F.coalesce(F.col("score_breakdown.dealbreaker"), F.lit(False))
    moved = (
        F.when(broken & (F.col("status") == "new"), "filtered")
        .when(~broken & (F.col("status") == "filtered"), "new")
        .otherwise(F.col("status"))
    )
    return new.withColumn("new_status", moved).withColumn("score_changed", F.col("score") != F.col("old_score"))


def rescore(
    df: DataFrame, profile: Profile, as_of, status: str | None = None, source: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(state, changes). Score and breakdown change only where the total does; dealbreakers move new <-> filtered.

    The filters choose which postings are looked at; all others pass through. A dry run ignores the state.
    """
    chosen = F.lit(True)
    if status and status != "all":
        chosen = chosen & F.coalesce(F.col("status") == status, F.lit(False))
    if source:
        chosen = chosen & F.coalesce(F.col("source") == source, F.lit(False))
    # Chosen postings are scored once, for the state and the change log; the others are never scored.
    looked = cut(rescored(df.where(chosen), profile, as_of))
    replaced = {
        "score": F.when(F.col("score_changed"), F.col("score")).otherwise(F.col("old_score")),
        "score_breakdown": F.when(F.col("score_changed"), F.col("score_breakdown")).otherwise(F.col("old_breakdown")),
        "status": F.col("new_status"),
    }
    state = looked.select(*[replaced[c].alias(c) if c in replaced else F.col(c) for c in df.columns])
    return state.unionByName(df.where(~chosen)), change_log(looked)


def rescore_changes(df: DataFrame, profile: Profile, as_of) -> DataFrame:
    """Change log: postings whose total moved."""
    return change_log(rescored(df, profile, as_of))


def change_log(looked: DataFrame) -> DataFrame:
    """What ``rescored`` moved."""
    return looked.where("score_changed").select(
        "id",
        F.col("old_score").alias("old"),
        F.col("score").alias("new"),
        (F.col("score") - F.col("old_score")).alias("delta"),
        "company",
        "title",
        F.to_json("score_breakdown").alias("breakdown"),
    )


def rescore_top(changes: DataFrame, k: int = 25, widths: dict[str, int] | None = None) -> DataFrame:
    """Largest moves first; texts are whole, or cut to the display widths given by column."""
    top = changes.orderBy(F.desc(F.abs("delta")), "id").limit(k)
    shown = [cut_to(F.col(c), (widths or {}).get(c)).alias(c) for c in ("company", "title")]
    return top.select("id", "old", "new", *shown)


def rescore_summary(df: DataFrame, profile: Profile, as_of) -> DataFrame:
    """How many were looked at, moved, newly filtered and un-filtered, and by how much scores moved."""
    changed = F.col("score_changed")
    delta = F.when(changed, F.col("score") - F.col("old_score"))
    was, now = F.col("status"), F.col("new_status")
    return rescored(df, profile, as_of).agg(
        F.count("*").alias("total"),
        F.count_if(changed).alias("changed"),
        F.avg(delta).alias("avg_delta"),
        F.min(delta).alias("min_delta"),
        F.max(delta).alias("max_delta"),
        F.count_if((now == "filtered") & (was == "new")).alias("newly_filtered"),
        F.count_if((now == "new") & (was == "filtered")).alias("unfiltered"),
    )


def with_fresh_content_key(df: DataFrame, name: str) -> DataFrame:
    """Add the content key computed from normalised locations, leaving the location columns alone."""
    places = {"_kc": F.col("city"), "_ks": F.col("state"), "_kn": F.col("country")}
    out = normalise_location(df.withColumns(places), "_kc", "_ks", "_kn")
    key = content_key(
        F.col("title"), F.col("company"), F.col("_kc"), F.col("_ks"), F.col("date_posted"), F.col("description")
    )
    return out.withColumn(name, key).drop("_kc", "_ks", "_kn")


def backfill_content_keys(df: DataFrame) -> DataFrame:
    """Fill missing content keys; existing keys are never recomputed."""
    out = with_fresh_content_key(df, "_fresh")
    return out.withColumn("content_key", F.coalesce("content_key", "_fresh")).drop("_fresh").select(*df.columns)


def location_fixes(df: DataFrame) -> DataFrame:
    """Add normalised locations (fixed_*), whether a row changes, and the main reason."""
    places = {"fixed_city": F.col("city"), "fixed_state": F.col("state"), "fixed_country": F.col("country")}
    out = normalise_location(df.withColumns(places), "fixed_city", "fixed_state", "fixed_country")
    city, state, country = F.col("city"), F.col("state"), F.col("country")
    new_city, new_state, new_country = F.col("fixed_city"), F.col("fixed_state"), F.col("fixed_country")
    had_city, had_state = F.coalesce(city != "", F.lit(False)), F.coalesce(state != "", F.lit(False))
    had_country = F.coalesce(country != "", F.lit(False))
    gone = had_city & new_city.isNull()
    changed = ~(new_city.eqNullSafe(city) & new_state.eqNullSafe(state) & new_country.eqNullSafe(country))
    reason = (
        F.when(gone & (F.lower(city) == "remote"), "remote_cleared")
        .when(gone & ~new_state.eqNullSafe(state), "fields_shifted")
        .when(gone, "country_from_city")
        .when(had_state & new_state.isNull(), "country_from_state")
        .when(had_state & ~new_state.eqNullSafe(state), "state_abbreviated")
        .when(had_country & ~new_country.eqNullSafe(country), "country_normalized")
        .otherwise("other")
    )
    return settled(out.withColumn("reason", reason), {"changed": changed, "reason": F.when(changed, F.col("reason"))})


def fix_locations(df: DataFrame, as_of: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(state, counts per reason). Content keys stay as they are."""
    fixes = location_fixes(df)
    out = {"city": F.col("fixed_city"), "state": F.col("fixed_state"), "country": F.col("fixed_country")}
    if as_of is not None and "updated_at" in df.columns:
        out["updated_at"] = F.when(F.col("changed"), as_of).otherwise(F.col("updated_at"))
    state = fixes.select(*[out[c].alias(c) if c in out else F.col(c) for c in df.columns])
    return state, fixes.where("changed").groupBy("reason").agg(F.count("*").alias("cnt"))
