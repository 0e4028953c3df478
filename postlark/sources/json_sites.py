"""Postings in JSON search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlark.functions.dates import days_before, epoch_millis_date, timestamp_or_age
from postlark.functions.location import split_location
from postlark.functions.pay import annual_or_plain_pay, percentile_pay, unit_pay
from postlark.functions.text import html_to_text, is_remote, label_job_types
from postlark.operators.spread import settled

INDEED_PAGE = "data struct<jobSearch:struct<pageInfo:struct<nextCursor:string>,results:array<string>>>"
INDEED_JOB = (
    "key string, title string, datePublished bigint, description struct<html:string>, location string, "
    "compensation struct<baseSalary:struct<unitOfWork:string,range:struct<min:double,max:double>>,"
    "estimated:struct<baseSalary:struct<unitOfWork:string,range:struct<min:double,max:double>>,currencyCode:string>,"
    "currencyCode:string>, attributes array<struct<key:string,label:string>>, employer struct<name:string>"
)
INDEED_PLACE = "city string, admin1Code string, countryCode string, formatted struct<short:string,long:string>"

GLASSDOOR_PAGE = "array<struct<data:struct<jobListings:struct<jobListings:array<string>>>>>"
GLASSDOOR_VIEW = (
    "header struct<jobLink:string,jobTitleText:string,employerNameFromSearch:string,ageInDays:string,"
    "payPercentile10:double,payPercentile90:double,payCurrency:string,payPeriod:string>, "
    "job struct<listingId:string,description:string>, overview struct<name:string>, locationName string, "
    "remoteWorkTypes array<string>"
)

ZIP_PAGE = "jobs array<string>, continue_from string"
ZIP_JOB = (
    "id string, name string, url string, hiring_company struct<name:string>, job_city string, job_state string, "
    "job_country string, snippet string, posted_time string, posted_time_friendly string, salary_min_annual double, "
    "salary_max_annual double, salary_min double, salary_max double, salary_source string"
)


def _items(payloads: DataFrame, items: Column, cursor: Column) -> DataFrame:
    """One row per raw item text, and one without an item for an empty page."""
    pages = payloads.withColumns({"_items": items, "has_cursor": F.coalesce(cursor != "", F.lit(False))}).drop("body")
    pages = pages.withColumn("raw_count", F.coalesce(F.size("_items"), F.lit(0)))
    return pages.select("*", F.posexplode_outer("_items").alias("pos", "item")).drop("_items")


def _parsed(item: Column, wrapper: str, layout: str) -> Column:
    """The fields of an item text, from under its wrapper if that is there. Each item is parsed on its own, so an odd one
    spoils no other."""
    names = [f.split(" ", 1)[0] for f in layout.split(", ")]
    nested = ",".join(f.replace(" ", ":", 1) for f in layout.split(", "))
    both = F.from_json(item, f"{wrapper} struct<{nested}>, {layout}")
    return F.coalesce(both[wrapper], F.struct(*[both[n].alias(n) for n in names]))


def _with_pay(rows: DataFrame, pay: Column) -> DataFrame:
    return rows.withColumn("_pay", pay).withColumns(
        {
            "comp_min": F.col("_pay.min"),
            "comp_max": F.col("_pay.max"),
            "comp_currency": F.coalesce("_pay.currency", F.lit("USD")),
            "comp_interval": F.col("_pay.interval"),
        }
    )


def _text(c, default: str = "") -> Column:
    return F.coalesce(c, F.lit(default))


def _default_when_absent(raw: Column, key: str, value: Column, default: str) -> Column:
    """The value, or the default when the JSON object has no such key; an explicit null stays null."""
    has = F.coalesce(F.array_contains(F.json_object_keys(raw), key), F.lit(False))
    return F.when(has, value).otherwise(F.lit(default))


def indeed(payloads: DataFrame, as_of: Column) -> DataFrame:
    pages = payloads.withColumn("_p", F.from_json("body", INDEED_PAGE))
    search = F.col("_p.data.jobSearch")
    results = F.when(search["pageInfo"].isNotNull(), search["results"])
    rows = _items(pages, results, search["pageInfo"]["nextCursor"]).drop("_p")
    rows = settled(rows, {"j": _parsed(F.col("item"), "job", INDEED_JOB)})
    rows = rows.withColumn("_loc", F.from_json("j.location", INDEED_PLACE))
    rows = rows.withColumn("description", html_to_text(F.col("j.description.html")))
    base = F.coalesce("j.compensation.baseSalary", "j.compensation.estimated.baseSalary")
    rows = _with_pay(
        rows, unit_pay(base["range"]["min"], base["range"]["max"], base["unitOfWork"], F.col("j.compensation.currencyCode"))
    )
    url = F.when(F.col("item").isNotNull(), F.concat(F.lit("https://www.indeed.com/viewjob?jk="), _text("j.key")))
    title = _text("j.title")
    return rows.withColumns(
        {
            "source_id": _text("j.key"),
            "seen_key": url,
            "url": url,
            "title": title,
            "company": _text(F.nullif(F.col("j.employer.name"), F.lit("")), "Unknown"),
            "city": F.col("_loc.city"),
            "state": F.col("_loc.admin1Code"),
            "country": _default_when_absent(F.col("j.location"), "countryCode", F.col("_loc.countryCode"), "US"),
            "is_remote": is_remote(title, F.col("description"), F.col("_loc.formatted.long")),
            "job_type": label_job_types(F.transform("j.attributes", lambda a: a["label"])),
            "date_posted": epoch_millis_date(F.col("j.datePublished")),
        }
    )


def glassdoor(payloads: DataFrame, as_of: Column) -> DataFrame:
    first = F.get(F.from_json("body", GLASSDOOR_PAGE), F.lit(0))
    # No cursor here: pages are numbered, so every page allows a next one.
    rows = _items(payloads, first["data"]["jobListings"]["jobListings"], F.lit("page"))
    rows = settled(rows, {"v": _parsed(F.col("item"), "jobview", GLASSDOOR_VIEW)})
    rows = rows.withColumns(
        {
            "description": html_to_text(F.col("v.job.description")),
            "_place": split_location(F.col("v.locationName"), "glassdoor"),
        }
    ).select("*", "_place.*")
    head = F.col("v.header")
    rows = _with_pay(
        rows, percentile_pay(head["payPercentile10"], head["payPercentile90"], head["payPeriod"], head["payCurrency"])
    )
    listing = F.nullif(F.col("v.job.listingId"), F.lit(""))
    site = F.lit("https://www.glassdoor.com")
    link = F.nullif(head["jobLink"], F.lit(""))
    url = F.coalesce(
        F.when(link.startswith("http"), link).otherwise(F.concat(site, link)),
        F.concat(site, F.lit("/job-listing/"), listing),
    )
    title = _text(head["jobTitleText"])
    flagged = F.coalesce(F.size("v.remoteWorkTypes") > 0, F.lit(False))
    return rows.withColumns(
        {
            "source_id": listing,
            "seen_key": listing,
            "url": url,
            "title": title,
            "company": F.coalesce(
                F.nullif(head["employerNameFromSearch"], F.lit("")), F.col("v.overview.name"), F.lit("Unknown")
            ),
            "is_remote": flagged | is_remote(title, F.lit(""), F.col("v.locationName")),
            "date_posted": days_before(as_of, head["ageInDays"]),
        }
    )


def ziprecruiter(payloads: DataFrame, as_of: Column) -> DataFrame:
    pages = payloads.withColumn("_p", F.from_json("body", ZIP_PAGE))
    rows = _items(pages, F.col("_p.jobs"), F.col("_p.continue_from")).drop("_p")
    rows = rows.withColumn("j", F.from_json("item", ZIP_JOB))
    rows = rows.withColumn("description", html_to_text(F.col("j.snippet")))
    rows = _with_pay(
        rows,
        annual_or_plain_pay(
            *[F.col(f"j.{c}") for c in ("salary_min_annual", "salary_max_annual", "salary_min", "salary_max", "salary_source")]
        ),
    )
    job_id = F.nullif(F.col("j.id"), F.lit(""))
    city, state = F.nullif(F.col("j.job_city"), F.lit("")), F.nullif(F.col("j.job_state"), F.lit(""))
    title = _text("j.name")
    return rows.withColumns(
        {
            "source_id": job_id,
            "seen_key": job_id,
            "url": _text("j.url"),
            "title": title,
            "company": _text("j.hiring_company.name", "Unknown"),
            "city": F.col("j.job_city"),
            "state": F.col("j.job_state"),
            "country": _default_when_absent(F.col("item"), "job_country", F.col("j.job_country"), "US"),
            "is_remote": is_remote(title, F.col("description"), F.concat_ws(", ", city, state)),
            "date_posted": timestamp_or_age(F.col("j.posted_time"), F.col("j.posted_time_friendly"), as_of),
        }
    )
