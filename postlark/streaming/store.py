"""Postings kept as plain Parquet folders, one partition per job and batch.

A batch adds whole rows of new postings, new values of touched ones, ids of removed ones, its runs, alerts, sightings
and misses. Writing a batch again overwrites its own partitions, and its input is read without them, so a replay after
a failure changes nothing else. Nothing already written is rewritten. One job writes to a store at a time.

Inside its batch a row lies in a bucket by the hash of its key, and a batch has as many buckets, a power of two, as hold
about ``bucket_rows`` rows each. Two narrow tables, bucketed by source key and by content key, lead to ids. So a lookup, and a batch of a
stream, opens the buckets that its keys fall in: what it reads follows the batch, not the store. Many small batches are merged
by ``compacted``.

Batches are numbered as they come. A batch that is written again keeps its number and sees the store as it was then, so it
writes what it wrote, whatever has come since. Each leaves the difference it makes to the counts of postings
(``operators.rollups``), so statistics are sums over narrow rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postlark.operators import rollups
from postlark.operators.spread import cut, exists, folders
from postlark.operators.upsert import apply_changes
from postlark.schemas import POSTINGS, RUNS, column_names, conform

BUCKET_ROWS = 50_000
MAX_DEPTH = 14
# A set of keys that falls in more buckets than this reads them all; the result is the same.
MAX_TOUCHED = 2_000
# So many buckets are opened by name, more by a filter on all.
MAX_LISTED = 100
MUTABLE = [
    "city", "state", "country", "score", "score_breakdown", "status", "notes", "applied_date", "content_key",
    "updated_at",
]
_PLAIN = {
    "inserted": POSTINGS,
    "removed": "id bigint",
    "runs": RUNS,
    "alerts": POSTINGS,
    "seen": "run_id bigint, seen_key string",
    "misses": "posting_id bigint",
    "issued": "last_id bigint, version bigint",
    "keys": "dedup_key string, id bigint",
    "contents": "content_key string, id bigint",
    "cells": "source string, status string, score int, search_term string, day date, n bigint",
}
# The key that deals a kind's rows to buckets.
_DEALT = {"inserted": "id", "changed": "id", "removed": "id", "keys": "dedup_key", "contents": "content_key", "seen": "run_id"}


def layout_of(kind: str) -> str:
    if kind != "changed":
        return _PLAIN[kind]
    kinds = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(POSTINGS).fields}
    return ", ".join(["id bigint", "version bigint", *[f"{c} {kinds[c]}" for c in MUTABLE]])


def _bucket(key: str, depth: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << depth)).cast("int")


@dataclass
class Store:
    spark: SparkSession
    root: str
    bucket_rows: int = BUCKET_ROWS

    _later: dict = field(default_factory=dict, repr=False)

    def read(self, kind: str, without: tuple[str, int] | None = None, own_too: bool = False, at: str | list[str] = "") -> DataFrame:
        """All rows of a kind with their job and batch; ``without`` leaves one batch out, and those numbered after it. With ``at`` only
        these folders are listed."""
        layout = f"{layout_of(kind)}, job string, batch_id bigint"
        if kind in _DEALT:
            layout += (", day date" if kind == "seen" else "") + ", depth int, bucket int"
        path = f"{self.root}/{kind}"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], layout)
        parts = [at] if isinstance(at, str) else at
        found = [f"{path}/{p}".rstrip("/") for p in parts if not p or exists(self.spark, f"{path}/{p}")]
        if not found:
            return self.spark.createDataFrame([], layout)
        rows = self.spark.read.schema(layout).option("basePath", path).parquet(*found)
        for job, batch in self._hidden(without) if without is not None else []:
            if not own_too or (job, batch) != without:
                rows = rows.where((F.col("job") != job) | (F.col("batch_id") != batch))
        return rows

    def _number(self, own: tuple[str, int]) -> int | None:
        """The number a batch got when it was first written."""
        noted = self.read("issued").where((F.col("job") == own[0]) & (F.col("batch_id") == own[1]))
        return noted.agg(F.max("version")).first()[0]

    def _hidden(self, own: tuple[str, int]) -> list[tuple[str, int]]:
        """This batch and all numbered after it; looked up once until the batch is committed."""
        if own not in self._later:
            number = self._number(own)
            later = self.read("issued").where(F.col("version") >= number).select("job", "batch_id").collect() if number is not None else []
            self._later[own] = sorted({own, *((r["job"], r["batch_id"]) for r in later)})
        return self._later[own]

    def touching(self, kind: str, keys: DataFrame, without: tuple[str, int] | None = None, own_too: bool = False) -> DataFrame:
        """Rows of a kind whose key is among ``keys``, a frame with that one column; only their buckets are read."""
        key = _DEALT[kind]
        keys = keys.select(key).where(F.col(key).isNotNull()).distinct()
        levels = 3 + (kind == "seen")
        parts = folders(self.spark, f"{self.root}/{kind}/{'*/' * (levels - 1)}depth=*", levels)
        depths = {p: int(p.rsplit("=", 1)[1]) for p in parts}
        if not depths:
            return self.read(kind, without, own_too).join(keys, key, "left_semi")
        found = [r["b"] for r in keys.select(_bucket(key, max(depths.values())).alias("b")).distinct().limit(MAX_TOUCHED + 1).collect()]
        if len(found) > MAX_TOUCHED:
            return self.read(kind, without, own_too).join(keys, key, "left_semi")
        wanted = {d: sorted({b % (1 << d) for b in found}) for d in set(depths.values())}
        if sum(len(wanted[d]) for d in depths.values()) <= MAX_LISTED:
            # Few buckets are opened by name: listing all would cost more than reading these.
            rows = self.read(kind, without, own_too, [f"{p}/bucket={b}" for p, d in depths.items() for b in wanted[d]])
        else:
            held = [(F.col("depth") == d) & F.col("bucket").isin(buckets) for d, buckets in sorted(wanted.items())]
            rows = self.read(kind, without, own_too).where(reduce(lambda a, b: a | b, held))
        return rows.join(keys, key, "left_semi")

    def state(self, without: tuple[str, int] | None = None) -> DataFrame:
        """All postings as they stand now."""
        return self._standing(*(self.read(kind, without) for kind in ("inserted", "changed", "removed")))

    def by_ids(self, ids: DataFrame, without: tuple[str, int] | None = None, own_too: bool = False) -> DataFrame:
        """The postings with these ids as they stand now; other buckets are not read."""
        return self._standing(*(self.touching(kind, ids, without, own_too) for kind in ("inserted", "changed", "removed")))

    def posting(self, posting_id: int) -> DataFrame:
        """One posting, from the buckets of its id."""
        return self.by_ids(self.spark.range(1).select(F.lit(posting_id).cast("bigint").alias("id")))

    def by_keys(self, keys: DataFrame, without: tuple[str, int] | None = None) -> DataFrame:
        """The postings whose source key is among ``keys.dedup_key``."""
        ids = cut(self.touching("keys", keys, without).select("id").distinct())
        return self.by_ids(ids, without)

    def matching(self, found: DataFrame, without: tuple[str, int] | None = None) -> DataFrame:
        """All stored postings an upsert of these arrivals can meet: by source key, and the oldest with a long one's content."""
        by_key = self.touching("keys", found, without).select("id")
        copies = cut(self.touching("contents", found.where("long"), without).select("content_key", "id"))
        living = copies.join(self.touching("removed", copies, without).select("id"), "id", "left_anti")
        oldest = living.groupBy("content_key").agg(F.min("id").alias("id")).select("id")
        return self.by_ids(cut(by_key.union(oldest).distinct()), without)

    def _standing(self, rows: DataFrame, changes: DataFrame, removed: DataFrame) -> DataFrame:
        # Latest image per posting, combined inside tasks; only narrow columns take part.
        last = changes.groupBy("id").agg(F.max_by(F.struct(*MUTABLE), "version").alias("_n")).select("id", "_n.*")
        rows = rows.select(*column_names(POSTINGS))
        return apply_changes(rows, last).join(removed.select("id"), "id", "left_anti").select(*column_names(POSTINGS))

    def last_id(self, without: tuple[str, int] | None = None) -> int:
        """The highest id ever issued; ids of removed postings stay taken. Every batch notes its own."""
        return self.read("issued", without).agg(F.max("last_id")).first()[0] or 0

    def runs(self) -> DataFrame:
        """The run log; a run that landed in several batches is one row."""
        parts = self.read("runs")
        return conform(
            parts.groupBy("id").agg(
                F.min("started_at").alias("started_at"),
                F.max("finished_at").alias("finished_at"),
                *[F.min(c).alias(c) for c in ("site", "search_term", "location")],
                F.sum("jobs_found").alias("jobs_found"),
                F.sum("jobs_new").alias("jobs_new"),
                F.min("error").alias("error"),
            ),
            RUNS,
        )

    def alerts(self) -> DataFrame:
        return self.read("alerts")

    def seen(self, runs: DataFrame, since, without: tuple[str, int] | None = None) -> DataFrame:
        """Sightings of these runs (``run_id``) made on the day of ``since`` or later; older folders are not read."""
        return self.touching("seen", runs, without).where(F.col("day") >= since).select("run_id", "seen_key")

    def commit(self, job: str, batch_id: int, **kinds: DataFrame | None) -> None:
        """Write one batch: frames by kind. ``changed`` holds ids and any of the mutable columns; others keep their
        values. ``seen`` has the day of each sighting."""
        own = (job, batch_id)
        inserted, changed = kinds.get("inserted"), kinds.get("changed")
        version = self._number(own)
        if version is None:
            version = (self.read("issued").agg(F.max("version")).first()[0] or 0) + 1
        if changed is not None:
            kept = [c for c in MUTABLE if c not in changed.columns]
            if kept:
                changed = changed.join(self.by_ids(changed.select("id"), own).select("id", *kept), "id")
            kinds["changed"] = changed.withColumn("version", F.lit(version).cast("long"))
        for kind, rows in kinds.items():
            if rows is not None and kind != "issued":
                self._write(own, kind, rows)
        mine = cache(lambda kind: self.read(kind, at=f"job={job}/batch_id={batch_id}"))
        filled = [mine(kind).select("content_key", "id") for kind in ("inserted", "changed") if kinds.get(kind) is not None]
        if filled:
            self._write(own, "contents", reduce(DataFrame.union, filled).where("content_key is not null").distinct())
        if inserted is not None:
            self._write(own, "keys", mine("inserted").select("dedup_key", "id"))
        self._write(own, "cells", self._difference(own, kinds, mine))
        noted = kinds.get("issued")
        if noted is None:
            top = mine("inserted").agg(F.max("id").alias("last_id")) if inserted is not None else self.spark.range(1).select(F.lit(None).alias("last_id"))
            noted = top.withColumn("version", F.lit(version))
        self._write(own, "issued", noted)
        self._later.pop(own, None)

    def _difference(self, own: tuple[str, int], kinds: dict, mine) -> DataFrame:
        """What a batch, already written, adds to and takes from the cells."""
        ids = [mine(kind).select("id") for kind in ("changed", "removed") if kinds.get(kind) is not None]
        parts = [self.spark.createDataFrame([], layout_of("cells"))]
        new = mine("inserted") if kinds.get("inserted") is not None else None
        if ids:
            touched = cut(reduce(DataFrame.union, ids).distinct())
            parts += [rollups.cells(self.by_ids(touched, own, True)), rollups.cells(self.by_ids(touched, own), -1)]
            new = new.join(touched, "id", "left_anti") if new is not None else None
        if new is not None:
            parts.append(rollups.cells(new))
        return rollups.folded(reduce(DataFrame.unionByName, parts))

    def cells(self) -> DataFrame:
        """The counts of postings by cell: the sum of all differences."""
        return rollups.folded(self.read("cells"))

    def _write(self, own: tuple[str, int], kind: str, rows: DataFrame) -> None:
        path = f"{self.root}/{kind}/job={own[0]}/batch_id={own[1]}"
        out = conform(rows, layout_of(kind))
        if kind not in _DEALT:
            out.write.mode("overwrite").parquet(path)
            return
        parts = ["depth", "bucket"]
        if kind == "seen":
            out, parts = conform(rows, layout_of(kind) + ", day date"), ["day", *parts]
        buckets = -(-out.count() // self.bucket_rows)
        depth = min(max(buckets - 1, 0).bit_length(), MAX_DEPTH)
        dealt = out.withColumns({"depth": F.lit(depth), "bucket": _bucket(_DEALT[kind], depth)})
        # Spark joins small buckets in a task and splits one that a frequent key fills.
        (dealt.hint("rebalance", "bucket") if depth else dealt).write.mode("overwrite").partitionBy(*parts).parquet(path)

    def compacted(self, root: str) -> Store:
        """A new store with the present postings, log, alerts, sightings and the highest id, each as one batch."""
        new = Store(self.spark, root, self.bucket_rows)
        highest = self.spark.range(1).select(F.lit(self.last_id()).alias("last_id"), F.lit(0).alias("version"))
        copied = {k: self.read(k) for k in ("alerts", "seen", "misses")}
        new.commit("compact", 0, inserted=self.state(), runs=self.runs(), issued=highest, **copied)
        return new
