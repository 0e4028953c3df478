"""Payload scans, the extractor registry, and the rules on which rows of a run count."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlark.operators.scoring import as_date
from postlark.operators.spread import cut
from postlark.shipping import ship
from postlark.schemas import EXTRACTED, PAYLOADS, column_names, conform
from postlark.sources import cards, json_sites, positional

Extractor = Callable[[DataFrame, Column], DataFrame]

OFFSET_STEP = 25
# Sites that page by a cursor, by a card offset, and sites that accept any 2xx answer.
CURSOR_SITES = ["indeed", "google", "ziprecruiter"]
OFFSET_SITES = ["linkedin"]
LENIENT_SITES = ["indeed", "glassdoor"]

_EXTRACTORS: dict[str, Extractor] = {
    "linkedin": cards.linkedin,
    "indeed": json_sites.indeed,
    "google": positional.google,
    "glassdoor": json_sites.glassdoor,
    "ziprecruiter": json_sites.ziprecruiter,
    "bayt": cards.bayt,
}
PAGE_COLUMNS = ["raw_count", "has_cursor", "seen_key"]
PAGE_ORDER = ["page_no", "pos"]


def register_extractor(site: str, fn: Extractor) -> None:
    """Add or replace the extractor of a site: (payloads, as_of date) -> one row per posting, one per empty page."""
    _EXTRACTORS[site] = fn


def extractor(site: str) -> Extractor:
    if site not in _EXTRACTORS:
        raise ValueError(f"unknown site: {site}")
    return _EXTRACTORS[site]


def read_payloads(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(PAYLOADS).format(fmt).load(path)


def stream_payloads(spark: SparkSession, path: str, fmt: str = "json", max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(PAYLOADS).format(fmt)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def ingest_tasks(sites: DataFrame, terms: DataFrame, locations: DataFrame) -> DataFrame:
    """Every (site, term, location) with its position, sites first. Each list has its places as ``pos``, from 0 without gaps.

    A position is a number in mixed radix whose digits are the places in the three lists: positions are spread as a range,
    and each list is joined by its digit. No list is gathered, and no task holds more than its range.
    """
    spark = sites.sparkSession
    n_sites, n_terms, n_places = (df.count() for df in (sites, terms, locations))
    numbers = spark.range(n_sites * n_terms * n_places).withColumnRenamed("id", "position")
    digits = numbers.select(
        "position",
        F.expr(f"position div {max(n_terms * n_places, 1)}").alias("i"),
        F.expr(f"position div {max(n_places, 1)} % {max(n_terms, 1)}").alias("j"),
        F.expr(f"position % {max(n_places, 1)}").alias("k"),
    )
    out = digits
    for digit, df, name in (("i", sites, "site"), ("j", terms, "term"), ("k", locations, "location")):
        out = out.join(df.select(F.col("pos").cast("bigint").alias(digit), name), digit)
    return out.select("position", "site", "term", "location")


def accepted() -> Column:
    """Answers that can hold postings."""
    code = F.col("status_code")
    fine = F.when(F.col("site").isin(LENIENT_SITES), code.between(200, 299)).otherwise(code == 200)
    return F.coalesce(fine, F.lit(False)) & F.col("body").isNotNull()


def extract(payloads: DataFrame, as_of, sites: Iterable[str] | None = None) -> DataFrame:
    """Postings of all payloads, plus one row without a ``seen_key`` for each page or item that yields none.

    A failed answer keeps its page row, because it ends the run's pages.
    """
    ship(payloads.sparkSession)
    names = list(_EXTRACTORS) if sites is None else list(sites)
    day, out = as_date(as_of), None
    columns = column_names(EXTRACTED)
    body = F.when(accepted(), F.col("body"))
    for name in names:
        mine = payloads.where(F.col("site") == name).select(
            "run_id", F.col("site").alias("source"), "search_term", F.col("location"), "page_no",
            F.col("fetched_at").alias("date_scraped"), body.alias("body"),
        )
        rows = extractor(name)(mine.withColumnRenamed("location", "task_location"), day)
        rows = rows.withColumnRenamed("task_location", "location").withColumn("pos", F.coalesce("pos", F.lit(0)))
        rows = conform(rows, f"{EXTRACTED}, raw_count int, has_cursor boolean, seen_key string")
        out = rows if out is None else out.unionByName(rows)
    filled = out.withColumn("job_type", F.coalesce("job_type", F.array().cast("array<string>")))
    return filled.select(*columns, *PAGE_COLUMNS)


def seen_first(df: DataFrame, key: str = "seen_key") -> DataFrame:
    """First row per run and key, in page order. Every task keeps one row per key before the shuffle."""
    w = Window.partitionBy("run_id", key).orderBy("page_no", "pos")
    return df.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def page_prefix(pages: DataFrame, max_pages: int) -> DataFrame:
    """Pages that count, from (run_id, source, page_no, raw_count, kept_rows, has_cursor).

    Pages count from 1 up to the first one that is missing or gives nothing new, within the page cap, and no further
    than the first one without a cursor where the site needs one. Offset sites stop at a page without cards and at
    the card offset instead. A run has at most ``max_pages * 25`` rows here, so its window is small by construction.
    """
    by_offset, by_cursor = F.col("source").isin(OFFSET_SITES), F.col("source").isin(CURSOR_SITES)
    bounded = pages.where((F.col("page_no") >= 1) & (F.col("page_no") <= max_pages * OFFSET_STEP))
    order = Window.partitionBy("run_id").orderBy("page_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    full = F.when(by_offset, F.col("raw_count") > 0).otherwise(F.col("kept_rows") > 0)
    marked = bounded.withColumn("_full", full & (F.row_number().over(order) == F.col("page_no")))
    cards_before = F.coalesce(F.sum("raw_count").over(before), F.lit(0))
    cursor_before = F.coalesce(F.min(F.col("has_cursor") | ~by_cursor).over(before), F.lit(True))
    within = F.when(by_offset, cards_before < max_pages * OFFSET_STEP).otherwise(F.col("page_no") <= max_pages)
    counted = marked.withColumn("_ok", F.min("_full").over(so_far) & cursor_before & within)
    return counted.where("_ok").drop("_full", "_ok")


def cap_per_task(df: DataFrame, n: int) -> DataFrame:
    """First ``n`` rows per run in page order; rows flagged ``uncapped`` always stay. Every task keeps ``n`` rows of a
    run before the shuffle."""
    w = Window.partitionBy("run_id").orderBy("page_no", "pos")
    free = F.coalesce(F.col("uncapped"), F.lit(False)) if "uncapped" in df.columns else F.lit(False)
    capped = df.where(~free).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
    return capped.unionByName(df.where(free)) if "uncapped" in df.columns else capped


def run_rows(
    extracted: DataFrame, max_pages: int | None = None, wanted: int | None = None, seen: DataFrame | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """The postings of each run: every landed one at its first sighting.

    ``seen`` (run_id, seen_key) are sightings of earlier batches. With ``max_pages`` only pages count that a collector
    with that limit would have fetched; with ``wanted`` only so many postings of a run. Give rows without their texts,
    as an ingest does, where texts shouldn't move.
    """
    out = columns or column_names(EXTRACTED)
    if max_pages is None and wanted is None:
        return _fresh(seen_first(extracted), seen).select(*out)
    return _limited(cut(extracted), max_pages, wanted, seen).select(*out)


def _fresh(rows: DataFrame, seen: DataFrame | None) -> DataFrame:
    return rows if seen is None else rows.join(seen.select("run_id", "seen_key").distinct(), ["run_id", "seen_key"], "left_anti")


def _limited(rows: DataFrame, max_pages: int | None, wanted: int | None, seen: DataFrame | None) -> DataFrame:
    """Rows within a collector's limits."""
    kept = _fresh(seen_first(rows), seen)
    if max_pages is not None:
        kept = _on_counted_pages(rows, kept, max_pages)
    if wanted is None:
        return kept
    # A first page without a cursor is returned whole by the one site that reads it before the cap applies.
    lone = (F.col("source") == "google") & (F.col("page_no") == 1) & ~F.col("has_cursor")
    return cap_per_task(kept.withColumn("uncapped", lone), wanted)


def _on_counted_pages(rows: DataFrame, kept: DataFrame, max_pages: int) -> DataFrame:
    kept_counts = kept.groupBy("run_id", "page_no").agg(F.count("*").alias("kept_rows"))
    pages = rows.groupBy("run_id", "source", "page_no").agg(
        F.max("raw_count").alias("raw_count"), F.max("has_cursor").alias("has_cursor")
    )
    pages = pages.join(kept_counts, ["run_id", "page_no"], "left").fillna(0, ["kept_rows"])
    counted = page_prefix(pages, max_pages).select("run_id", "page_no")
    return kept.join(counted, ["run_id", "page_no"], "left_semi")
