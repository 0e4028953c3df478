"""Two-level upsert of a batch into the stored postings, as set operations.

The rule reads row by row. In arrival order, a posting whose source key is known updates that posting. Otherwise, if
its description is long enough and its content key is known, it counts as a copy of the oldest posting with that
content. Otherwise it is inserted. Whether a row is inserted depends on which earlier rows were, so membership is
settled in rounds: a row that is the first undecided one for its source key and (unless short) for its content key
must be inserted; rows blocked by it drop out; repeat. The first undecided row is always settled, so rounds end, and
one is the normal number. From the second round on, chains in which each row waits for one other are settled whole by
pointer jumping, so rounds grow with the logarithm of a chain.

No step gathers a key's rows: firsts are aggregates combined inside tasks, and matches by a possibly hot key go
through ``attach``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlark.operators.spread import attach, cut, dense_rank_of

# A batch of at most this many rows may broadcast its content keys (16 characters each).
BROADCAST_ROWS = 500_000
STORED = ["id", "dedup_key", "content_key", "score", "score_breakdown", "status"]
EVENT = ["seq", "dedup_key", "content_key", "long", "score", "score_breakdown", "status"]


@dataclass(frozen=True)
class Upserted:
    """What a batch does to the stored postings.

    outcome: one row per batch row (seq, target_id, kind: insert, key or content).
    inserted: (seq, id, score, score_breakdown, status) of new postings after the whole batch.
    updated: (id, score, score_breakdown, status) of stored postings the batch touched.
    rounds: membership rounds needed.
    """

    outcome: DataFrame
    inserted: DataFrame
    updated: DataFrame
    rounds: int


def _least(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(value))


def membership(fresh: DataFrame) -> tuple[DataFrame, int]:
    """Rows to insert among rows (seq, dedup_key, content_key, long) that match nothing stored, and the rounds taken.

    Jumps along chains count as rounds too.
    """
    # Later copies of the same key, content and length class share the fate of the first one.
    undecided = cut(fresh.groupBy("dedup_key", "content_key", "long").agg(F.min("seq").alias("seq")))
    inserted, rounds = None, 0
    while not undecided.isEmpty():
        rounds += 1
        if rounds == 1:
            marked = _first_ones(undecided)
        else:
            marked, jumps = _chained(undecided)
            rounds += jumps
        sure = marked.where("sure").drop("sure")
        inserted = sure if inserted is None else inserted.unionByName(sure)
        by_key = _least(sure, "dedup_key", "seq").withColumnRenamed("seq", "_key_at")
        by_content = _least(sure, "content_key", "seq").withColumnRenamed("seq", "_content_at")
        rest = attach(marked.where("sure is null"), by_key, "dedup_key")
        rest = attach(rest, by_content, "content_key")
        blocked = F.coalesce(F.col("_key_at") < F.col("seq"), F.lit(False)) | (
            F.col("long") & F.coalesce(F.col("_content_at") < F.col("seq"), F.lit(False))
        )
        undecided = cut(rest.where(~blocked).select(*undecided.columns))
    return (fresh.limit(0) if inserted is None else inserted).select("seq", "dedup_key", "content_key"), rounds


def _first_ones(undecided: DataFrame) -> DataFrame:
    """Add ``sure``: true for rows that nothing undecided can stop, else null."""
    first_key = _least(undecided, "dedup_key", "seq").select("seq", F.lit(True).alias("_first_key"))
    first_content = _least(undecided, "content_key", "seq").select("seq", F.lit(True).alias("_first_content"))
    marked = undecided.join(first_key, "seq", "left").join(first_content, "seq", "left")
    unopposed = ~F.col("long") | F.col("content_key").isNull() | F.col("_first_content").isNotNull()
    sure = F.when(F.col("_first_key").isNotNull() & unopposed, True)
    return cut(marked.select(*undecided.columns, sure.alias("sure")))


def _two_least(rows: DataFrame, key: str) -> DataFrame:
    """The first and second row of each key, as aggregates: a hot key's rows are never brought together."""
    keyed = rows.where(F.col(key).isNotNull())
    first = _least(keyed, key, "seq").withColumnRenamed("seq", f"_{key}_1")
    later = attach(keyed.select(key, "seq"), first, key).where(F.col("seq") > F.col(f"_{key}_1"))
    return first.join(_least(cut(later), key, "seq").withColumnRenamed("seq", f"_{key}_2"), key, "left")


def _chained(undecided: DataFrame) -> tuple[DataFrame, int]:
    """Add ``sure``: true or false where the row's fate follows from others, else null; and the jumps it took.

    A row with one undecided row before it, by key or by content, is inserted if and only if that one isn't. Such rows form
    chains that end at a row nothing stops, or at one with several rows before it. Pointers along the chains jump to the
    pointer's pointer, twice a step, so a chain of n rows takes the logarithm of n to base four; the number of links passed tells the row's fate.
    """
    rows = attach(cut(attach(undecided, _two_least(undecided, "dedup_key"), "dedup_key")), _two_least(undecided, "content_key"), "content_key")
    seq, opposed = F.col("seq"), F.col("long") & F.col("content_key").isNotNull()

    def before(key: str, counts: Column) -> tuple[Column, Column]:
        """Whether several rows stand before this one, and the only one that does."""
        first, second = F.col(f"_{key}_1"), F.col(f"_{key}_2")
        return counts & (seq != first) & (seq != second), F.when(counts & (seq == second), first)

    many_k, one_k = before("dedup_key", F.lit(True))
    many_c, one_c = before("content_key", opposed)
    several = F.coalesce(many_k, F.lit(False)) | F.coalesce(many_c, F.lit(False)) | F.coalesce(one_k != one_c, F.lit(False))
    rows = rows.select("seq", several.alias("several"), F.when(~several, F.coalesce(one_k, one_c)).alias("to"))
    # Only pointers jump; keys wait in the undecided rows.
    rows = cut(rows.withColumn("odd", F.when(F.col("to").isNotNull(), 1).otherwise(0)))
    pointers, ends = rows.where("to is not null").drop("several"), rows.where("to is null")
    jumps = 0
    while True:
        step = pointers.select(F.col("seq").alias("to"), F.col("to").alias("_next"), F.col("odd").alias("_odd"))
        pointers = cut(_jumped(_jumped(pointers, step, "_once"), step, "_twice"))
        once, twice = pointers.agg(F.max("_once"), F.max("_twice")).first()
        pointers = pointers.drop("_once", "_twice")
        jumps += bool(once)
        if not twice:
            break
    open_ends = ends.where("several").select(F.col("seq").alias("to"), F.lit(True).alias("_open"))
    fates = attach(pointers, open_ends, "to").select("seq", F.when(F.col("_open").isNull(), F.col("odd") % 2 == 0).alias("sure"))
    fates = fates.unionByName(ends.select("seq", F.when(~F.col("several"), True).alias("sure")))
    return cut(attach(undecided, fates, "seq")), jumps


def _jumped(pointers: DataFrame, step: DataFrame, moved: str) -> DataFrame:
    """Every pointer moved on by one step, if there is one."""
    hit = F.col("_next").isNotNull()
    values = {"odd": F.col("odd") + F.when(hit, F.col("_odd")).otherwise(0), "to": F.coalesce("_next", "to"), moved: hit}
    return attach(pointers, step, "to").withColumns(values).drop("_next", "_odd")


def _oldest_with_content(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Smallest stored id per content key of the batch. Stored rows of one key may be very many, so they are never
    brought together: a batch of checked size filters them in place, a larger one meets their per-key minimum."""
    wanted = rows.where("long").select("content_key").distinct()
    if rows.count() <= BROADCAST_ROWS:
        return _least(stored.join(F.broadcast(wanted), "content_key", "left_semi"), "content_key", "id")
    return _least(stored, "content_key", "id").join(wanted, "content_key", "left_semi")


def _fold(events: DataFrame) -> DataFrame:
    """Final score, breakdown and status per target from its events (seq, kind, score, score_breakdown, status).

    The last event by source key (or the insert) sets the score outright; later copies only raise it. The status
    follows events by source key until it leaves new and filtered. ``began`` is the first event: -1 for stored targets.
    """
    sticky = ~F.col("status").isin("new", "filtered")
    base = events.where("kind <> 'content'").groupBy("target_id").agg(
        F.min("seq").alias("began"),
        F.max("seq").alias("_from"),
        F.min(F.when(sticky, F.struct("seq", "status"))).alias("_sticky"),
        F.max(F.struct("seq", "status")).alias("_last"),
    )
    settled = F.coalesce(F.col("_sticky.status"), F.col("_last.status"))
    base = base.select("target_id", "began", "_from", settled.alias("_settled"))
    seen = cut(attach(events, base, "target_id"))
    later_copy = (F.col("kind") == "content") & (F.col("seq") > F.col("_from"))
    best = F.max(F.struct("score", (-F.col("seq")).alias("early"), "score_breakdown"))
    scores = seen.where((F.col("seq") == F.col("_from")) | later_copy).groupBy("target_id")
    return scores.agg(
        best.alias("_best"), F.min("began").alias("began"), F.max("_settled").alias("status")
    ).select("target_id", "began", "_best.score", "_best.score_breakdown", "status")


def resolve(stored: DataFrame, batch: DataFrame, last_id: int = 0) -> Upserted:
    """Work out inserts and updates. New ids are above all stored ones and above ``last_id``, the highest ever issued.

    ``stored`` needs id, dedup_key, content_key, score, score_breakdown and status. ``batch`` is a written table, as
    ``sequenced`` leaves it, with a unique ``seq`` (arrival order, 0 or more), ``long``, and the same columns without
    id. Wide columns take no part.
    """
    stored = stored.select(*STORED)
    rows = batch.select(*EVENT)
    by_key = stored.join(rows.select("dedup_key").distinct(), "dedup_key", "left_semi")
    by_key = by_key.select("dedup_key", F.col("id").alias("key_id"))
    by_content = _oldest_with_content(stored, rows).withColumnRenamed("id", "content_id")
    rows = attach(rows, by_key, "dedup_key")
    rows = cut(attach(rows, by_content, "content_key"))

    fresh = rows.where(F.col("key_id").isNull() & ~(F.col("long") & F.col("content_id").isNotNull()))
    chosen, rounds = membership(fresh.select("seq", "dedup_key", "content_key", "long"))
    top = max(stored.agg(F.max("id")).first()[0] or 0, last_id)
    new = dense_rank_of(chosen, "seq", "_rank")
    new = cut(new.select("seq", "dedup_key", "content_key", (F.col("_rank") + top).alias("new_id")))

    new_key = new.select("dedup_key", F.col("seq").alias("new_key_seq"), F.col("new_id").alias("new_key_id"))
    new_content = _least(new, "content_key", "new_id").withColumnRenamed("new_id", "new_content_id")
    rows = attach(rows, new_key, "dedup_key")
    rows = attach(rows, new_content, "content_key")
    known, here, earlier = F.col("key_id").isNotNull(), F.col("new_key_seq") == F.col("seq"), F.col("new_key_seq") < F.col("seq")
    kind = F.when(known | earlier, "key").when(here, "insert").otherwise("content")
    target = (
        F.when(known, F.col("key_id"))
        .when(here | earlier, F.col("new_key_id"))
        .otherwise(F.coalesce("content_id", "new_content_id"))
    )
    events = cut(
        rows.select("seq", target.alias("target_id"), kind.alias("kind"), "score", "score_breakdown", "status")
    )
    touched = events.where("kind <> 'insert'").select(F.col("target_id").alias("id")).distinct()
    before = stored.join(touched, "id", "left_semi").select(
        F.lit(-1).cast("bigint").alias("seq"),
        F.col("id").alias("target_id"),
        F.lit("stored").alias("kind"),
        "score",
        "score_breakdown",
        "status",
    )
    final = cut(_fold(events.unionByName(before)))
    values = [F.col("target_id").alias("id"), "score", "score_breakdown", "status"]
    return Upserted(
        events.select("seq", "target_id", "kind"),
        final.where("began >= 0").select(F.col("began").alias("seq"), *values),
        final.where("began < 0").select(*values),
        rounds,
    )


def apply_changes(state: DataFrame, changes: DataFrame, as_of=None) -> DataFrame:
    """Replace columns of ``state`` by id from ``changes``; other rows stay. Changed rows get a new updated_at."""
    values = [c for c in changes.columns if c != "id"]
    renamed = changes.select("id", F.lit(True).alias("_hit"), *[F.col(v).alias(f"_{v}") for v in values])
    joined = state.join(renamed, "id", "left")
    out = []
    for c in state.columns:
        if c in values:
            out.append(F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c))
        elif c == "updated_at" and as_of is not None:
            out.append(F.when(F.col("_hit"), as_of).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)
