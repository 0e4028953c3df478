"""Postings, run log and status events derived from the generated test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postlark.functions.keys import content_key, dedup_key
from postlark.functions.location import normalise_location
from postlark.operators.scoring import score
from postlark.operators.spread import exists, shared_folder
from postlark.profiles import Profile
from postlark.schemas import BREAKDOWN
from postlark.sources.payloads import read_payloads

AS_OF = "2024-01-31 00:00:00"
AS_OF_DAY = "2024-01-31"
# Clock of the scrape-time windows: documents take their scrape time from the first events.
SCRAPE_NOW = "2024-01-03 00:00:00"

# Raw place by n_chars % 12: (city, state, country); a None country is the posting's nation name.
PLACES = [
    ("United States", None, "US"),
    ("California", "United States", "US"),
    ("Detroit", "United States", "US"),
    ("Los Angeles", "California", "US"),
    ("Remote", None, "US"),
    ("Georgia", "United States", "US"),
    ("Georgia", None, "US"),
    ("  ", " tx ", "united states"),
    ("Houston", "Texas Metropolitan Area", "usa"),
    ("London", None, "United Kingdom"),
    ("Toronto", "Ontario", "canada"),
    (None, "new york metro area", None),
]

P0 = Profile(
    name="p0",
    keywords={
        "critical": ["ention", "heation", "schen", "ouqu"],
        "strong": ["der ", "on the"],
        "moderate": ["tion", "ción", "ver"],
        "weak": ["and"],
    },
    companies={"tier1": ["#000000001"], "tier2": ["#000000002"], "tier3": ["#000000003"]},
    dealbreakers={"description": ["(?i)license"], "company": ["(?i)#000000009$"]},
    title_signals=[("the", 12), ("tion", 8), ("der ", 25)],
    min_alert_score=40,
)
P1 = Profile(
    name="p1",
    keywords={"strong": ["on the"], "moderate": ["tion"], "weak": ["and", "the"]},
    min_alert_score=30,
    min_display_score=10,
    alert_states=["California", "tx"],
)
# A later edition of p0, so that rescoring moves scores both ways.
P0_EDITED = Profile(
    name="p0",
    keywords={**P0.keywords, "critical": ["ention", "heation", "ouqu", "the "]},
    companies={"tier1": ["#000000004"], "tier2": ["#000000002"], "tier3": ["#000000003"]},
    dealbreakers={"company": ["(?i)#000000009$"], "title": ["(?i)eaux"]},
    title_signals=[("the", 5), ("tion", 8), ("der ", 25)],
    min_alert_score=40,
)


STORED = (
    "id bigint, source string, source_id string, url string, title string, company string, city string, state string, "
    "country string, is_remote boolean, description string, comp_min double, comp_max double, comp_interval string, "
    "date_posted date, date_scraped timestamp_ntz, search_term string, status string, dedup_key string, "
    f"content_key string, score_breakdown {BREAKDOWN}, score int"
)


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A generated table; its schema is read from the file once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _pick(values: list, index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), index)


def raw_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as postings, places still as the site wrote them."""
    d = table(spark, sf_dir, "documents")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "ts", "event_type", "value")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # Texts move once, to hash tables of narrow events, and are not sorted; documents without an event, a length or a supplier stay.
    joined = (
        d.join(e.hint("shuffle_hash"), "doc_id", "left")
        .join(s, F.col("n_chars") % s.count() == F.col("s_suppkey"), "left")
        .join(n, F.col("n_chars") % 25 == F.col("n_nationkey"), "left")
    )
    spot = (F.col("n_chars") % 12 + 1).cast("int")
    doc = F.col("doc_id")
    status = (
        F.when(doc % 13 == 0, "applied")
        .when(doc % 17 == 0, "rejected")
        .when(doc % 29 == 0, "interview")
        .when(doc % 31 == 0, "offer")
        .otherwise("new")
    )
    low = F.floor(F.col("value") * 1000).cast("double")
    return joined.select(
        doc.alias("id"),
        "source",
        doc.cast("string").alias("source_id"),
        F.concat(F.lit("https://jobs.example.com/"), doc.cast("string")).alias("url"),
        F.substring_index("text", ".", 1).alias("title"),
        F.col("s_name").alias("company"),
        _pick([p[0] for p in PLACES], spot).alias("city"),
        _pick([p[1] for p in PLACES], spot).alias("state"),
        F.coalesce(_pick([p[2] for p in PLACES], spot), "n_name").alias("country"),
        (F.col("n_chars") % 12 == 4).alias("is_remote"),
        F.col("text").alias("description"),
        low.alias("comp_min"),
        F.when(F.col("n_chars") % 3 != 0, low + (F.col("n_chars") % 7) * 1000).cast("double").alias("comp_max"),
        _pick(["yearly", "monthly", "hourly", None], (F.col("n_chars") % 4 + 1).cast("int")).alias("comp_interval"),
        F.when(
            F.col("n_chars") % 11 != 0, F.date_sub(F.lit(AS_OF_DAY).cast("date"), (F.col("n_chars") % 40).cast("int"))
        ).alias("date_posted"),
        F.col("ts").alias("date_scraped"),
        F.col("event_type").alias("search_term"),
        status.alias("status"),
    )


def postings(spark: SparkSession, sf_dir: str, prefix: int | None = None) -> DataFrame:
    """Normalised places and both identity keys."""
    df = normalise_location(raw_postings(spark, sf_dir))
    key = content_key(*[F.col(c) for c in ("title", "company", "city", "state", "date_posted", "description")], prefix=prefix)
    return df.withColumns({"dedup_key": dedup_key(F.col("source"), F.col("source_id")), "content_key": key})


def scored(spark: SparkSession, sf_dir: str, profile: Profile = P0) -> DataFrame:
    """Scored postings; untouched postings with a dealbreaker are filtered, as an ingest stores them."""
    df = score(postings(spark, sf_dir), profile, AS_OF)
    broken = F.coalesce(F.col("score_breakdown.dealbreaker"), F.lit(False))
    status = F.when(broken & (F.col("status") == "new"), "filtered").otherwise(F.col("status"))
    return df.withColumn("status", status)


_STORED: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored postings as a stored table, written to the shared folder once per application.

    Queries on stored postings read it like any table: filters reach the scan and unused columns are not read.
    """
    return written(spark, sf_dir, lambda path: scored(spark, sf_dir).write.parquet(path), lambda path: spark.read.schema(STORED).parquet(path))


def store(spark: SparkSession, sf_dir: str):
    """The scored postings in a store of small buckets, committed once per application."""
    from postlark.streaming.store import Store

    return written(
        spark, f"{sf_dir}#store", lambda path: Store(spark, path, 100).commit("load", 0, inserted=stored(spark, sf_dir)), lambda path: Store(spark, path, 100)
    )


def written(spark: SparkSession, name: str, write, read) -> DataFrame:
    """A fixture table that this application wrote earlier, or write it first."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _STORED or not exists(spark, _STORED[key]):
        _STORED[key] = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
        write(_STORED[key])
    return read(_STORED[key])


def ingest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("started_at"),
        F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("site"),
        F.col("event_type").alias("search_term"),
        F.concat(F.lit("loc"), (F.col("user_id") % 3).cast("string")).alias("location"),
        F.floor(F.col("value") / 25).cast("int").alias("jobs_found"),
        F.floor(F.col("value") / 50).cast("int").alias("jobs_new"),
        F.when(F.col("event_type") == "error", "timeout").alias("error"),
    )


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event but views, as status changes of the posting its user id names; some ids do not exist."""
    status = (
        F.when(F.col("event_type") == "signup", "applied")
        .when(F.col("event_type") == "purchase", "offer")
        .when(F.col("event_type") == "click", "interview")
        .when(F.col("event_type") == "error", "rejected")
    )
    even = F.col("event_id") % 2 == 0
    return (
        table(spark, sf_dir, "events")
        .where("event_type <> 'view'")
        .select(
            F.col("event_id").alias("seq"),
            F.when(F.col("event_id") % 97 == 0, -F.col("user_id") - 1).otherwise(F.col("user_id")).alias("posting_id"),
            status.alias("status"),
            F.when(even, "").otherwise(F.concat(F.lit("n"), F.col("event_id").cast("string"))).alias("notes"),
            F.to_date("ts").alias("event_date"),
        )
    )


# --- landed payloads derived from documents ---

PAGE_ROWS, RUN_ROWS = 10, 40


def _markup(c) -> F.Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def _item_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw postings with their page. Every tenth posting repeats the previous one's site id."""
    doc = F.col("id")
    listed = F.when(doc % PAGE_ROWS == PAGE_ROWS - 1, doc - 1).otherwise(doc).cast("string")
    return raw_postings(spark, sf_dir).withColumns(
        {
            "run_id": F.floor(doc / RUN_ROWS).cast("bigint"),
            "page_no": (F.floor(doc / PAGE_ROWS) % (RUN_ROWS // PAGE_ROWS) + 1).cast("int"),
            "listed": listed,
            "clean_title": F.regexp_replace(F.trim(F.col("title")), r"\s+", " "),
        }
    )


def _indeed_item() -> F.Column:
    return F.to_json(
        F.struct(
            F.struct(
                F.col("listed").alias("key"),
                F.col("clean_title").alias("title"),
                F.struct(F.concat(F.lit("<p>"), _markup(F.col("description")), F.lit("</p>")).alias("html")).alias("description"),
                F.struct(F.col("city").alias("city"), F.col("state").alias("admin1Code"), F.col("country").alias("countryCode")).alias("location"),
                F.struct(
                    F.struct(
                        F.when(F.col("id") % 3 == 0, "HOUR").when(F.col("id") % 3 == 1, "year").otherwise("SHIFT").alias("unitOfWork"),
                        F.struct((F.col("comp_min") + 0.5).alias("min"), F.col("comp_max").alias("max")).alias("range"),
                    ).alias("baseSalary")
                ).alias("compensation"),
                F.array(F.struct(F.lit("Full-time").alias("label")), F.struct(F.col("search_term").alias("label"))).alias("attributes"),
                F.struct(F.when(F.col("id") % 4 != 0, F.col("company")).alias("name")).alias("employer"),
                (F.unix_date("date_posted").cast("bigint") * 86400000 + 3600000).alias("datePublished"),
            ).alias("job")
        )
    )


def _glassdoor_item() -> F.Column:
    return F.to_json(
        F.struct(
            F.struct(
                F.struct(
                    F.when(F.col("id") % 2 == 0, F.concat(F.lit("/job/"), F.col("listed"))).alias("jobLink"),
                    F.col("clean_title").alias("jobTitleText"),
                    F.when(F.col("id") % 4 != 0, F.col("company")).alias("employerNameFromSearch"),
                    F.datediff(F.lit(AS_OF_DAY).cast("date"), "date_posted").alias("ageInDays"),
                    F.col("comp_min").alias("payPercentile10"),
                    F.col("comp_max").alias("payPercentile90"),
                    F.when(F.col("id") % 3 == 0, "HOURLY").when(F.col("id") % 3 == 1, "ANNUAL").alias("payPeriod"),
                ).alias("header"),
                F.struct(F.col("listed").alias("listingId"), _markup(F.col("description")).alias("description")).alias("job"),
                F.struct(F.concat(F.lit("Alt "), F.col("company")).alias("name")).alias("overview"),
                F.concat_ws(", ", "city", "state").alias("locationName"),
                F.when(F.col("id") % 5 == 0, F.array(F.lit("WORK_FROM_HOME"))).alias("remoteWorkTypes"),
            ).alias("jobview")
        )
    )


def _zip_item() -> F.Column:
    days = F.datediff(F.lit(AS_OF_DAY).cast("date"), "date_posted").cast("string")
    return F.to_json(
        F.struct(
            F.col("listed").alias("id"),
            F.col("clean_title").alias("name"),
            F.col("url").alias("url"),
            F.struct(F.when(F.col("id") % 4 != 0, F.col("company")).alias("name")).alias("hiring_company"),
            F.col("city").alias("job_city"),
            F.col("state").alias("job_state"),
            F.col("country").alias("job_country"),
            F.concat(F.lit("<b>"), _markup(F.col("description")), F.lit("</b>")).alias("snippet"),
            F.when(F.col("id") % 2 == 0, F.concat(F.date_format("date_posted", "yyyy-MM-dd"), F.lit("T10:00:00Z"))).alias("posted_time"),
            F.concat(days, F.lit(" days ago")).alias("posted_time_friendly"),
            F.when(F.col("id") % 3 == 0, F.col("comp_min")).alias("salary_min_annual"),
            F.col("comp_min").alias("salary_min"),
            F.col("comp_max").alias("salary_max"),
            F.when(F.col("id") % 5 == 0, "Per Hour").alias("salary_source"),
        )
    )


def _linkedin_item() -> F.Column:
    parts = [
        F.lit('<div class="base-search-card"><a class="base-card__full-link" href="https://x.example/jobs/view/a-b-'),
        F.col("listed"),
        F.lit('?ref=1">go</a><span class="sr-only"> '),
        _markup(F.col("clean_title")),
        F.lit(' </span><h4 class="base-search-card__subtitle"><a>'),
        _markup(F.col("company")),
        F.lit('</a></h4><div class="base-search-card__metadata"><span class="job-search-card__location">'),
        F.concat_ws(", ", "city", "state"),
        F.lit('</span><time class="job-search-card__listdate" datetime="'),
        F.coalesce(F.date_format("date_posted", "yyyy-MM-dd"), F.lit("soon")),
        F.lit('"></time></div><span class="job-search-card__salary-info">$'),
        F.col("comp_min").cast("bigint").cast("string"),
        F.lit(".00 - $"),
        F.coalesce(F.col("comp_max").cast("bigint").cast("string"), F.lit("more")),
        F.lit("</span></div>"),
    ]
    return F.concat(*parts)


def _bayt_item() -> F.Column:
    days = F.datediff(F.lit(AS_OF_DAY).cast("date"), "date_posted").cast("string")
    parts = [
        F.lit('<li data-js-job="" data-job-id="'),
        F.col("listed"),
        F.lit('"><h2><a href="/en/job-'),
        F.col("listed"),
        F.lit('">'),
        _markup(F.col("clean_title")),
        F.lit('</a></h2><b class="company-name">'),
        _markup(F.col("company")),
        F.lit('</b><span class="location-text">'),
        F.concat_ws(", ", "city", "country"),
        F.lit('</span><span class="date-posted">'),
        F.coalesce(F.concat(days, F.when(F.col("id") % 2 == 0, " days ago").otherwise(" hours ago")), F.lit("today")),
        F.lit("</span></li>"),
    ]
    return F.concat(*parts)


def _google_item() -> F.Column:
    """A positional array ending in a nested array, as JSON text."""

    def text(c) -> F.Column:
        # A one-field object's value is the JSON form of a string.
        return F.regexp_extract(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("x"))), r'(?s)\A\{"x":(.*)\}\z', 1)

    days = F.datediff(F.lit(AS_OF_DAY).cast("date"), "date_posted").cast("string")
    slots = {
        0: text(F.col("clean_title")),
        1: text(F.col("company")),
        2: text(F.concat_ws(", ", "city", "state")),
        3: F.concat(F.lit('[["https://x.example/'), F.col("listed"), F.lit('"]]')),
        12: text(F.concat(days, F.lit(" days ago"))),
        19: text(F.col("description")),
        28: F.when(F.col("id") % 2 == 0, F.col("listed")).otherwise(F.lit("null")),
        29: F.lit('[["end"]]'),
    }
    return F.concat(F.lit("["), F.concat_ws(",", *[slots.get(i, F.lit("null")) for i in range(30)]), F.lit("]"))


_ITEMS = {
    "indeed": _indeed_item,
    "glassdoor": _glassdoor_item,
    "ziprecruiter": _zip_item,
    "linkedin": _linkedin_item,
    "bayt": _bayt_item,
    "google": _google_item,
}


def _body(site: str) -> F.Column:
    items = F.transform(F.array_sort(F.collect_list(F.struct("id", "item"))), lambda x: x["item"])
    joined = F.array_join(items, ",")
    more = F.when(F.col("run_id") % 6 != 5, F.lit('"next"')).otherwise(F.lit("null"))
    if site == "indeed":
        head = F.concat(F.lit('{"data":{"jobSearch":{"pageInfo":{"nextCursor":'), more, F.lit('},"results":['))
        return F.concat(head, joined, F.lit("]}}}"))
    if site == "glassdoor":
        return F.concat(F.lit('[{"data":{"jobListings":{"jobListings":['), joined, F.lit("]}}}]"))
    if site == "ziprecruiter":
        return F.concat(F.lit('{"jobs":['), joined, F.lit('],"continue_from":'), more, F.lit("}"))
    if site == "google":
        cursor = F.when(F.col("run_id") % 6 != 5, '<div data-async-fc="next"></div>').otherwise("")
        first = F.array_join(F.transform(items, lambda x: F.concat(F.lit('"520084652":'), x, F.lit("}]]]]]"))), " ")
        inner = F.transform(items, lambda x: F.concat(F.lit('[[[{"520084652":'), x, F.lit("}]]]")))
        quoted = F.transform(inner, lambda x: F.concat(F.lit('["k",'), _quoted(x), F.lit("]")))
        later = F.concat(F.lit(")]}'[["), F.array_join(quoted, ","), F.lit("]]"))
        return F.concat(cursor, F.when(F.col("page_no") == 1, first).otherwise(later))
    return F.concat(F.lit("<html><body><ul>"), F.array_join(items, ""), F.lit("</ul></body></html>"))


def _quoted(c) -> F.Column:
    escaped = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def site_payloads(spark: SparkSession, sf_dir: str, site: str) -> DataFrame:
    """Every document as a posting in a landed page of the site: ten a page, four pages a run. The second page of
    every seventh run failed, and cursors are missing in every sixth."""
    items = _item_columns(spark, sf_dir).withColumn("item", _ITEMS[site]())
    pages = items.groupBy("run_id", "page_no").agg(
        F.min("search_term").alias("search_term"), F.max("date_scraped").alias("fetched_at"), _body(site).alias("body")
    )
    failed = (F.col("run_id") % 7 == 6) & (F.col("page_no") == 2)
    return pages.select(
        "run_id",
        F.lit(site).alias("site"),
        "search_term",
        F.lit("anywhere").alias("location"),
        "page_no",
        "fetched_at",
        F.when(failed, 500).otherwise(200).alias("status_code"),
        F.lit("https://x.example/search").alias("url"),
        "body",
    )


def landed(spark: SparkSession, sf_dir: str, site: str) -> DataFrame:
    """The site's payloads as a landing folder partitioned by site, written once per application."""
    return written(
        spark,
        f"{sf_dir}#{site}",
        lambda path: site_payloads(spark, sf_dir, site).write.partitionBy("site").parquet(path),
        lambda path: read_payloads(spark, path, "parquet"),
    )
