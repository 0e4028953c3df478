"""The registered queries: every operator over the generated tables, whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlark import views
from postlark.functions.dates import age_label, days_before, first_number_age, timestamp_or_age
from postlark.functions.location import split_location
from postlark.functions.pay import comp_display, comp_display_concise, currency_parser, salary_range
from postlark.functions.text import cap_description, escape, extract_emails, extract_job_types, html_to_text, is_remote, profile_name
from postlark.operators import dedup, filters, maintenance, rollups, scoring, stats, textjoin
from postlark.operators.scoring import as_date
from postlark.operators.spread import cut, numbered, sequenced, shared_folder
from postlark.operators.upsert import Upserted, apply_changes, membership, resolve
from postlark.functions.keys import dedup_key, matches_by_content
from postlark.plans import ingest as ingesting
from postlark.plans import reports, upkeep
from postlark.profiles import dimension_tables, profile_diagnostics
from postlark.schemas import BREAKDOWN, POSTINGS, conform
from postlark.sources import cards
from postlark.sources.payloads import (
    cap_per_task, extract, extractor, ingest_tasks, page_prefix, register_extractor, run_rows, seen_first,
)
from postlark.streaming.jobs import continuous_trend, merged_messages, start_ingest, start_status
from postlark.streaming.store import Store
from postlark.views import AS_OF, P0, P0_EDITED, P1, SCRAPE_NOW

Query = Callable[[SparkSession, str], DataFrame]
CHANNELS = ["telegram", "slack", "discord", "macos"]
BROKEN = "coalesce(score_breakdown.dealbreaker, false)"


def flagship_top_matches(spark, sf):
    """Best matches of the profile above the display threshold."""
    top = filters.list_postings(views.scored(spark, sf), min_score=P0.min_display_score, limit=30)
    return top.select("id", "score", "title", "company", reports.place().alias("location"), "date_posted", "status")


# --- scoring ---


def score_breakdown(spark, sf):
    b = F.col("score_breakdown")
    return views.scored(spark, sf).select(
        "id", "score", b["keyword"].alias("keyword"), b["company"].alias("company_points"),
        b["title"].alias("title_points"), b["recency"].alias("recency"), F.expr(BROKEN).alias("dealbreaker"),
    )


def dealbreaker_rows(spark, sf):
    rows = views.postings(spark, sf).where(scoring.dealbreaker(P0))
    status = F.when(F.col("status") == "new", "filtered").otherwise(F.col("status"))
    return rows.select("id", "company", status.alias("status"))


def keyword_hits_by_tier(spark, sf):
    rows = scoring.prepared(views.raw_postings(spark, sf))
    hits = scoring.keyword_hits(P0, F.col("_text"))
    counted = rows.select("id", *[c.alias(f"{t}_hits") for t, c in hits.items()])
    points = scoring.keyword_points(*[F.col(f"{t}_hits") for t in hits])
    return counted.withColumn("keyword", points)


def company_tier(spark, sf):
    rows = scoring.prepared(views.raw_postings(spark, sf))
    return rows.groupBy(scoring.company_points(P0, F.col("_company")).alias("company_points")).agg(F.count("*").alias("cnt"))


def title_signal(spark, sf):
    rows = scoring.prepared(views.raw_postings(spark, sf))
    return rows.groupBy(scoring.title_points(P0, F.col("_title")).alias("title_points")).agg(F.count("*").alias("cnt"))


def recency_bucket(spark, sf):
    points = scoring.recency_points(F.col("date_posted"), as_date(AS_OF))
    return views.raw_postings(spark, sf).groupBy(points.alias("recency")).agg(F.count("*").alias("cnt"))


def multi_profile_scores(spark, sf):
    rows = scoring.score_profiles(views.postings(spark, sf), [P0, P1], AS_OF)
    b = F.col("score_breakdown")
    return rows.select("profile", "id", "score", b["keyword"].alias("keyword"), b["title"].alias("title_points"))


def profile_table_scores(spark, sf):
    """The same scores from profiles held as tables."""
    rows = scoring.score_profile_tables(views.postings(spark, sf), dimension_tables(spark, [P0, P1]), AS_OF)
    b = F.col("score_breakdown")
    return rows.select("profile", "id", "score", b["keyword"].alias("keyword"), b["company"].alias("company_points"), b["title"].alias("title_points"))


def multi_profile_top(spark, sf):
    rows = scoring.score_profiles(views.postings(spark, sf), [P0, P1], AS_OF)
    return stats.top_per(rows, "profile", filters.main_order(), 20).select("profile", "rank", "id", "score")


def word_profiles(spark, sf):
    """Profiles whose keywords and patterns are the words of the benchmark items, as tables."""
    items = views.table(spark, sf, "benchmark")
    words = items.select(
        F.concat(F.lit("p"), F.col("item_id") % 10).alias("profile"), F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("word")
    ).where("word rlike '^[a-z]{4,}$'")
    words = cut(words.distinct())
    tiers = F.array(*[F.lit(t) for t in ("critical", "strong", "moderate", "weak")])
    empty = lambda columns: spark.createDataFrame([], columns)
    return {
        "keywords": words.select("profile", F.element_at(tiers, F.length("word") % 4 + 1).alias("tier"), F.lit(0).alias("pos"), F.col("word").alias("keyword")),
        "companies": empty("profile string, tier string, name string"),
        "title_signals": empty("profile string, pattern string, points int"),
        "dealbreakers": words.where("length(word) >= 7").select("profile", F.lit("title").alias("field"), F.concat(F.lit("(?i)"), "word", F.lit("(s|ed)?[.,]")).alias("pattern")),
    }


def profile_words(spark, sf):
    """What speaks for or against each posting in profiles of many words."""
    rows = cut(scoring.prepared(views.postings(spark, sf)).withColumn("row", F.monotonically_increasing_id()))
    found = scoring.profile_evidence(rows, word_profiles(spark, sf)).join(rows.select("row", "id"), "row")
    tiers = [F.col(t).alias(f"{t}_hits") for t in ("critical", "strong", "moderate", "weak")]
    return found.select("profile", "id", *tiers, F.coalesce("broken", F.lit(False)).alias("broken"))


def user_pattern_hits(spark, sf):
    """Documents in which each of many patterns, held as rows, is found."""
    patterns = word_profiles(spark, sf)["keywords"].where("length(keyword) >= 6").select(F.concat(F.lit("(?i)"), "keyword", F.lit("(s|ed)?[.,]")).alias("pattern"))
    texts = cut(views.table(spark, sf, "documents").select(F.col("doc_id").alias("row"), "text"))
    return textjoin.matching(texts, patterns).groupBy("pattern").agg(F.count("*").alias("documents"))


def max_achievable(spark, sf):
    """Profiles taken from customers: their nation picks the keyword tier, suppliers and orders add the rest."""
    customer = views.table(spark, sf, "customer")
    name = F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("profile")
    tier = F.element_at(
        F.array(*[F.lit(t) for t in ("critical", "strong", "moderate", "weak", "none")]), F.col("c_nationkey") % 5 + 1
    )
    dims = {
        "keywords": customer.select(name, tier.alias("tier"), F.col("c_mktsegment").alias("keyword")),
        "companies": views.table(spark, sf, "supplier").select(
            F.concat(F.lit("p"), (F.col("s_suppkey") * 3).cast("string")).alias("profile"), F.col("s_name").alias("name")
        ),
        "title_signals": views.table(spark, sf, "orders").select(
            F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("profile"), "o_orderpriority"
        ),
        "thresholds": customer.select(
            name, (F.col("c_nationkey") * 4).alias("min_alert_score"), F.lit(20).alias("min_display_score")
        ),
    }
    return profile_diagnostics(dims)


# --- scalar functions ---


def location_normalised(spark, sf):
    return views.postings(spark, sf).select("id", "city", "state", "country", reports.place().alias("display"))


def location_fix_counts(spark, sf):
    return maintenance.fix_locations(views.raw_postings(spark, sf))[1]


def comp_displays(spark, sf):
    low, high = F.col("comp_min"), F.col("comp_max")
    return views.raw_postings(spark, sf).select(
        "id", comp_display(low, high, F.col("comp_interval")).alias("pay"), comp_display_concise(low, high).alias("concise")
    )


def emails(spark, sf):
    found = F.array_join(extract_emails(F.col("text")), ",")
    return views.table(spark, sf, "documents").select("doc_id", found.alias("emails"))


def job_types(spark, sf):
    found = F.array_join(extract_job_types(F.col("html")), ",")
    return views.table(spark, sf, "pages").select("page_id", found.alias("job_types"))


def remote_flag(spark, sf):
    flag = is_remote(F.col("title"), F.col("description"), F.col("city"))
    return views.raw_postings(spark, sf).select("id", flag.alias("remote"))


def html_text(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", html_to_text(F.col("html")).alias("text"))


def currency_parse(spark, sf):
    n, doc = F.col("n_chars").cast("string"), F.col("doc_id")
    dollars = F.concat(F.lit("$"), n, F.lit(",000 - $"), (F.col("n_chars") + 5).cast("string"), F.lit(",000"))
    text = (
        F.when(doc % 6 == 0, F.concat(F.lit("$"), n, F.lit(".50")))
        .when(doc % 6 == 1, F.concat(n, F.lit(",25 EUR")))
        .when(doc % 6 == 2, F.concat(F.lit("1."), n, F.lit(",5")))
        .when(doc % 6 == 3, F.concat(F.lit("USD -"), n))
        .when(doc % 6 == 4, F.col("lang"))
        .otherwise(dollars)
    )
    pay = salary_range(F.when(doc % 6 == 5, F.col("t")))
    return views.table(spark, sf, "documents").select("doc_id", text.alias("t")).select(
        "doc_id", currency_parser(F.col("t")).alias("amount"), pay["min"].alias("low"), pay["max"].alias("high")
    )


def posted_date_parse(spark, sf):
    n, doc = F.col("n_chars"), F.col("doc_id")
    text = (
        F.when(doc % 5 == 0, F.concat((n % 40).cast("string"), F.lit(" days ago")))
        .when(doc % 5 == 1, F.concat((n % 20).cast("string"), F.lit(" Hours ago")))
        .when(doc % 5 == 2, "today")
        .when(doc % 5 == 3, F.concat(F.lit("posted "), (n % 9).cast("string"), F.lit(" weeks ago")))
        .otherwise("30+ days ago")
    )
    rows = views.table(spark, sf, "documents").select("doc_id", text.alias("t"))
    day = as_date(AS_OF)
    return rows.select(
        "doc_id",
        first_number_age(F.col("t"), day, False).alias("ignoring_unit"),
        first_number_age(F.col("t"), day, True).alias("hours_today"),
        timestamp_or_age(F.lit(None).cast("string"), F.col("t"), day).alias("days_only"),
    )


def place_split(spark, sf):
    doc, comma = F.col("doc_id"), F.lit(", ")
    text = (
        F.when(doc % 4 == 0, F.col("source"))
        .when(doc % 4 == 1, F.concat("source", comma, "lang"))
        .when(doc % 4 == 2, F.concat("source", F.lit(","), "lang", F.lit(" , x")))
        .otherwise("")
    )
    rows = views.table(spark, sf, "documents").select("doc_id", text.alias("p"))
    part = {s: split_location(F.col("p"), s) for s in ("linkedin", "glassdoor", "google", "bayt")}
    return rows.select(
        "doc_id",
        part["linkedin"]["city"].alias("linkedin_city"),
        part["linkedin"]["country"].alias("linkedin_country"),
        part["glassdoor"]["state"].alias("glassdoor_state"),
        part["google"]["city"].alias("google_city"),
        part["bayt"]["country"].alias("bayt_country"),
    )


def profile_names(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", profile_name(F.col("url")).alias("name"))


def escaped_texts(spark, sf):
    return views.table(spark, sf, "conversations").select(
        "conv_id", "turn", *[escape(F.col("text"), c).alias(c) for c in CHANNELS]
    )


def age_labels(spark, sf):
    return views.raw_postings(spark, sf).select("id", age_label(F.col("date_posted"), as_date(AS_OF)).alias("posted"))


# --- filters and lists ---

LISTED = ["id", "score", "status", "company", "date_posted"]


def list_filtered(spark, sf):
    rows = filters.list_postings(
        views.stored(spark, sf), status="new", min_score=20, company="R#00000000", source="src1", since="2024-01-01 12:00:00"
    )
    return rows.select(LISTED)


def list_page(spark, sf):
    return filters.list_postings(views.stored(spark, sf), status="all", limit=50, offset=100).select(LISTED)


def deep_page(spark, sf):
    """A page far down the list, found by the order statistics."""
    stored = views.stored(spark, sf)
    return filters.deep_page(stored, filters.order_counts(stored), limit=50, offset=600).select(LISTED)


def list_view(spark, sf):
    floor = filters.list_threshold("filtered", None, P0.min_display_score)
    return reports.list_view(views.stored(spark, sf), AS_OF, status="filtered", min_score=floor, limit=30)


def list_view_cut(spark, sf):
    floor = filters.list_threshold("filtered", None, P0.min_display_score)
    widths = reports.LIST_WIDTHS
    return reports.list_view(views.stored(spark, sf), AS_OF, widths, status="filtered", min_score=floor, limit=30)


def posted_range(spark, sf):
    return filters.posted_range(views.stored(spark, sf), AS_OF, since="2024-01-10", until="2024-01-20").select(LISTED)


def fresh_postings(spark, sf):
    return filters.fresh(views.stored(spark, sf), AS_OF, 72).select(LISTED)


def alert_state_filter(spark, sf):
    return filters.alert_states_filter(views.stored(spark, sf), P1.alert_states).select("id", "state", "is_remote")


def recent_context(spark, sf):
    return filters.recent_context(views.stored(spark, sf), SCRAPE_NOW, days=1).select(LISTED)


def context_lines(spark, sf):
    rows = filters.recent_context(views.stored(spark, sf), SCRAPE_NOW, days=1)
    return rows.select("id", reports.context_line().alias("line"))


def existing_keys(spark, sf):
    events = views.table(spark, sf, "events").where("event_type = 'error'").select(F.col("event_id").alias("doc_id"))
    docs = views.table(spark, sf, "documents").select("doc_id", "source")
    keys = events.join(docs, "doc_id").select(dedup_key(F.col("source"), F.col("doc_id").cast("string")).alias("dedup_key"))
    return views.store(spark, sf).by_keys(keys).select("id", "dedup_key")


def export_rows(spark, sf):
    return reports.export_rows(views.stored(spark, sf).drop("score_breakdown"))


def export_files(spark, sf):
    """The CSV export, read back."""
    path = f"{shared_folder(spark).rstrip('/')}/export-{uuid.uuid4().hex}.csv"
    reports.export_postings(views.stored(spark, sf), path, AS_OF)
    layout = ", ".join(f"{c} string" for c in reports.EXPORT_FIELDS).replace("id string", "id bigint", 1)
    layout = layout.replace("score string", "score int")
    read = spark.read.schema(layout).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    texts = [c for c in reports.EXPORT_FIELDS if c not in ("id", "score")]
    return read.withColumns({c: F.coalesce(c, F.lit("")) for c in texts})


def rehydrated(spark, sf):
    doc = F.col("id")
    rows = views.raw_postings(spark, sf).withColumns(
        {"comp_min": F.when(doc % 4 != 0, F.col("comp_min")), "notes": F.when(doc % 3 == 0, "n")}
    )
    return filters.rehydrated(rows).select("id", "city", "state", "country", "comp_min", "comp_max", "notes")


# --- statistics ---


def on_scored(fn) -> Query:
    return lambda spark, sf: fn(views.stored(spark, sf))


def on_runs(fn) -> Query:
    return lambda spark, sf: fn(views.ingest_runs(spark, sf))


# --- duplicates ---


def narrow(spark, sf) -> DataFrame:
    return views.stored(spark, sf).select("id", "content_key", "status", "score", "date_scraped")


def dup_members(spark, sf):
    return dedup.duplicate_members(narrow(spark, sf)).select("id", "content_key", "status", "score", "cnt")


def backfill_keys(spark, sf):
    old = views.raw_postings(spark, sf).withColumn("content_key", F.when(F.col("id") % 3 == 0, "old"))
    return maintenance.backfill_content_keys(old).select("id", "content_key")


# --- maintenance ---


def rescore_summary(spark, sf):
    out = maintenance.rescore_summary(views.stored(spark, sf), P0_EDITED, AS_OF)
    return out


def rescore_state(spark, sf):
    state, _ = maintenance.rescore(views.stored(spark, sf), P0_EDITED, AS_OF, source="src3")
    return state.select("id", "score", "status", F.col("score_breakdown.keyword").alias("keyword"))


def with_workflow(spark, sf) -> DataFrame:
    return views.stored(spark, sf).withColumns({"notes": F.lit(""), "applied_date": F.lit(None).cast("date")})


def status_fold(spark, sf):
    state, _ = maintenance.apply_status_events(with_workflow(spark, sf), views.status_events(spark, sf))
    return state.select("id", "status", "notes", "applied_date")


def status_not_found(spark, sf):
    ids = views.table(spark, sf, "documents").select(F.col("doc_id").alias("id")).withColumns(
        {"status": F.lit("new"), "notes": F.lit(""), "applied_date": F.lit(None).cast("date")}
    )
    return maintenance.apply_status_events(ids, views.status_events(spark, sf))[1]


def valid_updates(spark, sf):
    """Replies built from events: some ids are texts or missing, some statuses are unknown."""
    e = views.table(spark, sf, "events")
    status = F.when(F.col("event_type") == "signup", "applied").when(F.col("event_type") == "purchase", "offer").otherwise("asleep")
    job_id = F.when(F.col("event_id") % 5 == 0, F.lit("x")).otherwise(F.col("user_id").cast("string"))
    note = F.when(F.col("event_id") % 3 == 0, F.col("event_type"))
    reply = F.to_json(F.struct(F.array(F.struct(job_id.alias("job_id"), status.alias("status"), note.alias("notes"))).alias("updates")))
    rows = e.select("event_id", F.explode(maintenance.valid_updates(reply)).alias("u"))
    return rows.select("event_id", "u.job_id", "u.status", "u.notes")


def route_messages(spark, sf, chars=None):
    said = views.table(spark, sf, "conversations").where("role = 'user'").select(F.col("conv_id").alias("chat_id"), "turn", "text")
    routes = views.table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'").select(
        F.col("c_custkey").alias("chat_id"), F.concat(F.lit("p"), (F.col("c_custkey") % 2).cast("string")).alias("profile")
    )
    return maintenance.route_messages(said, routes, chars).select("chat_id", "turn", "profile", "text")


# --- upsert and ingest ---

EMPTY_STATE = f"id bigint, dedup_key string, content_key string, score int, score_breakdown {BREAKDOWN}, status string"


def _batch(rows: DataFrame, order: list[str]) -> DataFrame:
    keyed = rows.withColumns(
        {"dedup_key": dedup_key(F.col("source"), F.col("source_id")), "long": matches_by_content(F.col("description"))}
    )
    return sequenced(keyed.drop("description"), order)


def first_batch(spark, sf) -> DataFrame:
    keep = ["id", "source", "source_id", "content_key", "description", "score", "score_breakdown", "status"]
    return _batch(views.stored(spark, sf).select(keep).withColumnRenamed("id", "doc"), ["doc"])


def second_batch(spark, sf) -> DataFrame:
    """Every seventh posting again under its own key, and every fifth under a new one, with other scores."""
    keep = ["id", "source", "source_id", "content_key", "description", "score", "score_breakdown", "status"]
    rows = views.stored(spark, sf).select(keep).withColumnRenamed("id", "doc")
    copies = F.array_compact(F.array(F.when(F.col("doc") % 7 == 0, F.lit(0)), F.when(F.col("doc") % 5 == 0, F.lit(1))))
    rows = rows.withColumn("k", F.explode(copies)).withColumns(
        {
            "source_id": F.concat("source_id", F.when(F.col("k") == 1, "b").otherwise("")),
            "score": (F.col("score") + F.col("doc") % 3 - 1).cast("int"),
        }
    )
    return _batch(rows, ["doc", "k"])


def _state_after(state: DataFrame, batch: DataFrame, done: Upserted) -> DataFrame:
    new = batch.drop("score", "score_breakdown", "status").join(done.inserted, "seq")
    kept = apply_changes(state, done.updated)
    return kept.unionByName(new.select(kept.columns))


def _both_batches(spark, sf):
    empty = spark.createDataFrame([], f"{EMPTY_STATE}, source_id string")
    batches, state, done = [first_batch(spark, sf), second_batch(spark, sf)], empty, []
    for batch in batches:
        result = resolve(state, batch)
        state = cut(_state_after(state, batch, result))
        done.append(result)
    return state, done


def upsert_snapshot(spark, sf):
    state, _ = _both_batches(spark, sf)
    return state.select("id", "source_id", "dedup_key", "score", "status")


def upsert_outcomes(spark, sf):
    _, done = _both_batches(spark, sf)
    counts = [d.outcome.groupBy("kind").agg(F.count("*").alias("cnt")).select(F.lit(i + 1).alias("batch"), "kind", "cnt") for i, d in enumerate(done)]
    return counts[0].unionByName(counts[1])


def alerts(spark, sf):
    """New postings of one batch that deserve a message, as Telegram lines."""
    keyed = views.stored(spark, sf).withColumn("long", matches_by_content(F.col("description"))).withColumnRenamed("id", "doc")
    batch = sequenced(keyed.drop("description"), ["doc"])
    done = resolve(spark.createDataFrame([], EMPTY_STATE), batch)
    profile = scoring.Profile("p0", min_alert_score=30, alert_states=P1.alert_states)
    return reports.alert_batch(ingesting.alerts(batch, done.outcome, profile), "telegram", "p0")


def _empty_postings(spark) -> DataFrame:
    return spark.createDataFrame([], POSTINGS)


def _ingest(spark, sf, site="indeed") -> ingesting.Ingested:
    return ingesting.ingest(views.landed(spark, sf, site), _empty_postings(spark), P0, AS_OF, sites=[site])


def ingest_postings(spark, sf):
    done = _ingest(spark, sf)
    return done.inserted.select("id", "source_id", "dedup_key", "content_key", "score", "status", "title", "city", "state")


def ingest_limited(spark, sf):
    """An ingest within the limits of a collector."""
    done = ingesting.ingest(views.landed(spark, sf, "indeed"), _empty_postings(spark), P0, AS_OF, sites=["indeed"], limits=ingesting.COLLECTOR)
    return done.inserted.select("id", "source_id", "content_key", "score", "status", F.md5("description").alias("description_md5"))


def ingest_run_log(spark, sf):
    return _ingest(spark, sf).runs.select("id", "site", "search_term", "jobs_found", "jobs_new", "error")


def ingest_counters(spark, sf):
    done = _ingest(spark, sf)
    return ingesting.ingest_counters(done.arrivals, done.outcome)


def ingest_preview(spark, sf):
    landed = views.landed(spark, sf, "indeed")
    shown = ingesting.ingest(landed, _empty_postings(spark), P0, AS_OF, dry_run=True, sites=["indeed"])
    return shown.select("run_id", "page_no", "pos", "score", "title", "dealbreaker")


def event_pages(spark, sf) -> DataFrame:
    e = views.table(spark, sf, "events")
    return e.select(
        "event_id",
        (F.col("user_id") % 20).alias("run_id"),
        F.col("user_id").alias("user_run"),
        F.floor("value").cast("bigint").alias("seen_key"),
        F.floor(F.col("event_id") / 100).alias("page_no"),
        (F.col("event_id") % 100).alias("pos"),
    )


def seen_firsts(spark, sf):
    return seen_first(event_pages(spark, sf)).select("event_id", "run_id", "seen_key")


def task_cap(spark, sf):
    rows = event_pages(spark, sf).drop("run_id").withColumnRenamed("user_run", "run_id")
    return cap_per_task(rows, 25).select("event_id", "run_id")


def page_prefixes(spark, sf):
    """Orders as pages of their customer's run: low priority ones are empty, finished ones have no cursor."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    pages = views.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"),
        F.lit("indeed").alias("source"),
        F.row_number().over(w).alias("page_no"),
        F.lit(1).alias("raw_count"),
        F.when(F.col("o_orderpriority") == "5-LOW", 0).otherwise(1).cast("bigint").alias("kept_rows"),
        (F.col("o_orderstatus") != "F").alias("has_cursor"),
    )
    return page_prefix(pages, 3).select("run_id", "page_no")


def task_fanout(spark, sf):
    def listed(df: DataFrame, column: str, name: str, order: str) -> DataFrame:
        names = df.groupBy(column).agg(F.min(order).alias("_order"))
        return numbered(names, ["_order", column], "place").select((F.col("place") - 1).alias("pos"), F.col(column).alias(name))

    sites = listed(views.table(spark, sf, "documents"), "source", "site", "source")
    terms = listed(views.table(spark, sf, "events"), "event_type", "term", "event_type")
    places = listed(views.table(spark, sf, "region"), "r_name", "location", "r_regionkey")
    return ingest_tasks(sites, terms, places).select("position", "site", "term", "location")


def extracted(site: str, **limits: int) -> Query:
    def run(spark, sf):
        from postlark.functions.location import normalise_location

        rows = run_rows(extract(views.landed(spark, sf, site), AS_OF, [site]), **limits)
        return normalise_location(rows).select(
            "run_id", "page_no", "pos", "source", "source_id", "url", "title", "company", "city", "state", "country",
            "is_remote", F.char_length("description").alias("description_chars"), F.md5("description").alias("description_md5"),
            F.array_join("job_type", ",").alias("job_types"), "comp_min", "comp_max", "comp_interval", "date_posted",
        )

    return run


def _card_details(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Card postings and detail pages; every third page redirects to a sign-up."""
    rows = run_rows(extract(views.landed(spark, sf, "linkedin"), AS_OF, ["linkedin"]))
    doc = views.table(spark, sf, "documents")
    details = doc.select(
        F.col("doc_id").cast("string").alias("source_id"),
        F.lit(200).alias("status_code"),
        F.when(F.col("doc_id") % 3 == 0, "https://linkedin.com/signup").otherwise("https://x.example/").alias("url"),
        F.concat(F.lit('<div class="show-more-less-html__markup">'), views._markup(F.col("text")), F.lit("</div>")).alias("body"),
    )
    return rows, details


def enrich_descriptions(spark, sf):
    """Card postings with their texts from detail pages."""
    out = cards.enrich_descriptions(*_card_details(spark, sf))
    return out.select("source_id", F.md5("description").alias("description_md5"), "is_remote")


def stream_details(spark, sf):
    """The same from two streams: half the pages land before the cards, half after; one later card ends the waiting."""
    folder = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    rows, details = _card_details(spark, sf)
    rows = cut(rows.withColumn("date_scraped", F.lit(AS_OF).cast("timestamp_ntz")))
    details = cut(details.withColumn("fetched_at", F.lit(AS_OF).cast("timestamp_ntz")))
    half = F.col("source_id").cast("bigint") % 2 == 0
    last = F.lit(AS_OF).cast("timestamp_ntz") + F.expr("INTERVAL 30 DAYS")
    later = {"source_id": F.lit("end"), "fetched_at": last, "url": F.lit("https://x.example/")}
    ends = rows.limit(1).withColumns({"source_id": F.lit("end"), "date_scraped": last}), details.limit(1).withColumns(later)
    steps = [(None, details.where(half)), (rows, None), (None, details.where(~half)), ends]
    for parts in steps:
        for name, like, part in zip(("cards", "pages"), (rows, details), parts):
            (like.limit(0) if part is None else part).write.mode("append").parquet(f"{folder}/{name}")
        streams = [spark.readStream.schema(df.schema).parquet(f"{folder}/{name}") for name, df in (("cards", rows), ("pages", details))]
        out = _drained(spark, cards.late_descriptions(*streams), "append", folder)
    return out.where("source_id <> 'end'").select("source_id", F.md5("description").alias("description_md5"), "is_remote")


def upsert_chain(spark, sf):
    """Events as postings whose keys and contents alternate: each waits for the one before, but for some short texts."""
    rows = numbered(views.table(spark, sf, "events").select("event_id"), ["event_id"], "place").withColumn("seq", F.col("place") - 1)
    short = (F.col("seq") % 2 == 1) & (F.col("event_id") % 997 == 5)
    chain = rows.select(
        "seq",
        F.concat(F.lit("k"), F.shiftright(F.col("seq") + 1, 1)).alias("dedup_key"),
        F.concat(F.lit("c"), F.shiftright("seq", 1)).alias("content_key"),
        (~short).alias("long"),
    )
    return membership(cut(chain))[0]


# --- digests and reports ---


def digest_top10(spark, sf):
    rows = reports.digest_rows(views.stored(spark, sf), SCRAPE_NOW, P0.min_alert_score, [])
    return rows.select("rank", "id", "score", "matches")


def digest_text(spark, sf):
    return reports.digest_text(views.stored(spark, sf), SCRAPE_NOW, "slack", 10, [], "p0")


def alert_messages(spark, sf):
    lines = F.array(*[F.struct(F.lit(c).alias("channel"), reports.message_line(c).alias("message_line")) for c in reports.CHANNELS])
    return views.stored(spark, sf).select("id", F.explode(lines).alias("m")).select("id", "m.channel", "m.message_line")


def report(part: str, alert_score: int) -> Query:
    return lambda spark, sf: reports.report_tables(views.stored(spark, sf), SCRAPE_NOW, alert_score)[part]


def report_text(spark, sf):
    tables = reports.report_tables(views.stored(spark, sf), SCRAPE_NOW, 50)
    return reports.report_text(tables, 50, SCRAPE_NOW, "p0")


# --- streaming ---


def _streamed(spark, sf) -> Store:
    """The payload pages as files of a landing folder, ingested by the stream in two batches of many files.

    Batches are cut between pages, not runs, so that the run at the border lands in both. Made once per application.
    """

    def make(folder: str) -> None:
        pages = views.landed(spark, sf, "indeed")
        runs = pages.agg(F.max("run_id")).first()[0] or 0
        first = (F.col("run_id") < runs // 2) | ((F.col("run_id") == runs // 2) & (F.col("page_no") <= 2))
        store = Store(spark, f"{folder}/store")
        for part in (first, ~first):
            pages.where(part).write.mode("append").json(f"{folder}/landing")
            query = start_ingest(spark, f"{folder}/landing", store, P0, f"{folder}/checkpoint", as_of=AS_OF, sites=["indeed"])
            query.awaitTermination()

    return views.written(spark, f"{sf}#streamed", make, lambda folder: Store(spark, f"{folder}/store"))


def stream_ingest(spark, sf):
    state = _streamed(spark, sf).state()
    return state.select("id", "source_id", "dedup_key", "content_key", "score", "status", "title", "city", "state")


def stream_alerts(spark, sf):
    """Alerts kept by the stream: one for each new posting that deserves it."""
    return _streamed(spark, sf).alerts().select("id", "score", "title")


def stream_runs(spark, sf):
    """The run log of the stream; a run that landed in two batches is one row."""
    return _streamed(spark, sf).runs().select("id", "site", "search_term", "jobs_found", "jobs_new", "error")


def stream_misses(spark, sf):
    """Ids that status events name and no posting has."""
    return _status_streamed(spark, sf).read("misses").select("posting_id").distinct()


def reissued_ids(spark, sf):
    """A store that loses its newest postings and then takes new ones: old ids stay taken, also in a compacted copy."""
    folder = f"{shared_folder(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    store = Store(spark, f"{folder}/first")
    rows = conform(with_workflow(spark, sf), POSTINGS)
    store.commit("load", 0, inserted=rows)
    top = store.last_id()
    store.commit("remove", 0, removed=rows.where(F.col("id") > top - 10).select("id"))
    store = store.compacted(f"{folder}/second")
    again = rows.where(F.col("id") > top - 5).withColumn("dedup_key", F.concat(F.lit("again"), "dedup_key"))
    batch = sequenced(again.drop("id", "description").withColumn("long", F.lit(False)), ["source_id"])
    done = resolve(store.state(), batch, store.last_id())
    new = batch.drop("score", "score_breakdown", "status").join(done.inserted, "seq")
    store.commit("again", 0, inserted=new)
    return store.state().select("id", "dedup_key", "source_id")


def _status_streamed(spark, sf) -> Store:
    """Status events through the stream, onto postings committed before; made once per application."""

    def make(folder: str) -> None:
        store = Store(spark, f"{folder}/store")
        store.commit("load", 0, inserted=conform(with_workflow(spark, sf), POSTINGS))
        views.status_events(spark, sf).write.json(f"{folder}/events")
        start_status(spark, f"{folder}/events", store, f"{folder}/checkpoint").awaitTermination()

    return views.written(spark, f"{sf}#status", make, lambda folder: Store(spark, f"{folder}/store"))


def stream_status(spark, sf):
    return _status_streamed(spark, sf).state().select("id", "status", "notes", "applied_date")


# --- shapes, sinks and jobs that need a table of their own ---


def schema_upgrade(spark, sf):
    """A table written before some columns existed, in today's layout."""
    return conform(views.stored(spark, sf), POSTINGS).select("id", "score", "notes", "created_at")


def export_json(spark, sf):
    """The JSON export, read back; the format is told by the name."""
    path = f"{shared_folder(spark).rstrip('/')}/export-{uuid.uuid4().hex}.json"
    reports.export_postings(views.stored(spark, sf), path, AS_OF)
    return spark.read.schema("id bigint, score int, company string, title string, url string, status string").json(path)


def export_chosen(spark, sf):
    """Exports whose format is asked for, told by the name, or neither, read back as lines."""
    folder = f"{shared_folder(spark).rstrip('/')}/export-{uuid.uuid4().hex}"
    out = None
    for name, fmt in (("a.csv", "JSON"), ("b.json", "csv"), ("c.JSON", None), ("d.txt", None)):
        reports.export_postings(views.stored(spark, sf), f"{folder}/{name}", AS_OF, fmt)
        lines = spark.read.text(f"{folder}/{name}").agg(F.max(F.col("value").startswith("{")).alias("json"))
        part = lines.select(F.lit(name).alias("name"), F.when(F.col("json"), "json").otherwise("csv").alias("format"))
        out = part if out is None else out.unionByName(part)
    return out


def capped_descriptions(spark, sf):
    """Texts written several times over, cut to the collector's limit."""
    long = F.expr("repeat(text, cast(60000 div greatest(length(text), 1) + 1 as int))")
    capped = cap_description(long, ingesting.COLLECTOR.description_chars)
    return views.table(spark, sf, "documents").select("doc_id", F.length(capped).alias("chars"), F.md5(capped.cast("binary")).alias("md5"))


def digest_texts(spark, sf):
    """The digest on every channel."""
    parts = [
        reports.digest_text(views.stored(spark, sf), SCRAPE_NOW, c, 10, [], "p0").withColumn("channel", F.lit(c)) for c in reports.CHANNELS
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def desktop_note(spark, sf):
    return reports.macos_summary(reports.new_matches(views.stored(spark, sf), SCRAPE_NOW, 10, []), "p0")


def fixed_locations(spark, sf):
    state, _ = maintenance.fix_locations(views.raw_postings(spark, sf).drop("description"))
    return state.select("id", "city", "state", "country")


def plugged_extractor(spark, sf):
    """Payloads of a site whose extractor was added by the user."""
    register_extractor("plug", extractor("indeed"))
    rows = run_rows(extract(views.landed(spark, sf, "indeed").withColumn("site", F.lit("plug")), AS_OF, ["plug"]))
    return rows.select("run_id", "page_no", "pos", "source", "source_id", F.md5("description").alias("description_md5"))


def _upkept(spark, sf) -> Store:
    """A store after rescoring one source and removing duplicates, both as committed jobs; made once per application."""

    def make(root: str) -> None:
        store = Store(spark, root)
        store.commit("load", 0, inserted=conform(with_workflow(spark, sf), POSTINGS))
        upkeep.rescore_store(store, 0, P0_EDITED, AS_OF, source="src3")
        upkeep.backfill_store(store, 0)
        upkeep.fix_store_locations(store, 0, AS_OF)
        upkeep.deduplicate_store(store, 0)

    return views.written(spark, f"{sf}#upkept", make, lambda root: Store(spark, root))


def upkept_store(spark, sf):
    return _upkept(spark, sf).state().select("id", "score", "status")


def rollup(part: str) -> Query:
    """A statistic of the kept-up store, from the differences its batches left."""

    def run(spark, sf):
        return getattr(rollups, part)(_upkept(spark, sf).cells())

    return run


def _drained(spark, stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Run a stream over all that landed; each batch is written to its own partition, a complete result to one."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out" if mode == "complete" else f"{folder}/out/batch_id={batch_id}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def stream_trend(spark, sf):
    """Scores per day over a stream of scored postings."""
    folder = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    views.stored(spark, sf).select("date_scraped", "score").write.parquet(f"{folder}/landing")
    rows = spark.readStream.schema("date_scraped timestamp_ntz, score int").option("maxFilesPerTrigger", 1).parquet(f"{folder}/landing")
    return _drained(spark, continuous_trend(rows, 55), "complete", folder)


def stream_messages(spark, sf):
    """Messages of two sources as one stream, each with the profile of its chat."""
    folder = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    said = views.table(spark, sf, "conversations").where("role = 'user'").select(F.col("conv_id").alias("chat_id"), "turn", "text")
    layout = said.schema
    for k in (0, 1):
        said.where(F.col("turn") % 4 == 2 * k).write.parquet(f"{folder}/source{k}")
    said.where("turn % 4 not in (0, 2)").write.mode("append").parquet(f"{folder}/source1")
    routes = views.table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'").select(
        F.col("c_custkey").alias("chat_id"), F.concat(F.lit("p"), (F.col("c_custkey") % 2).cast("string")).alias("profile")
    )
    streams = [spark.readStream.schema(layout).parquet(f"{folder}/source{k}") for k in (0, 1)]
    return _drained(spark, merged_messages(streams, routes), "append", folder).select("chat_id", "turn", "profile", "text")


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        "flagship_top_matches": flagship_top_matches,
        "stored_postings": lambda s, d: views.stored(s, d).select("id", "score", "status", "dedup_key", "content_key"),
        "score_breakdown": score_breakdown,
        "dealbreaker_rows": dealbreaker_rows,
        "keyword_hits_by_tier": keyword_hits_by_tier,
        "company_tier": company_tier,
        "title_signal": title_signal,
        "recency_bucket": recency_bucket,
        "multi_profile_scores": multi_profile_scores,
        "multi_profile_top": multi_profile_top,
        "profile_table_scores": profile_table_scores,
        "profile_words": profile_words,
        "user_pattern_hits": user_pattern_hits,
        "max_achievable": max_achievable,
        "dedup_key": lambda s, d: views.postings(s, d).select("id", "dedup_key"),
        "content_key_prefix": lambda s, d: views.postings(s, d, 500).select("id", "content_key"),
        "content_key": lambda s, d: views.postings(s, d).select("id", "content_key"),
        "location_normalised": location_normalised,
        "location_fix_counts": location_fix_counts,
        "comp_display": comp_displays,
        "emails": emails,
        "job_types": job_types,
        "remote_flag": remote_flag,
        "html_text": html_text,
        "currency_parse": currency_parse,
        "posted_date_parse": posted_date_parse,
        "place_split": place_split,
        "profile_names": profile_names,
        "escaped_texts": escaped_texts,
        "age_labels": age_labels,
        "list_filtered": list_filtered,
        "list_page": list_page,
        "deep_page": deep_page,
        "list_view": list_view,
        "list_view_cut": list_view_cut,
        "posted_range": posted_range,
        "fresh_postings": fresh_postings,
        "alert_state_filter": alert_state_filter,
        "recent_context": recent_context,
        "context_lines": context_lines,
        "existing_keys": existing_keys,
        "rehydrated": rehydrated,
        "export_rows": export_rows,
        "export_files": export_files,
        "by_status": on_scored(stats.by_status),
        "total_count": on_scored(stats.total_count),
        "by_source": on_scored(stats.by_source),
        "score_tiers": on_scored(stats.score_tiers),
        "by_search_term": on_scored(stats.by_search_term),
        "alert_stats": on_scored(lambda df: stats.alert_stats(df, SCRAPE_NOW)),
        "daily_trend": on_scored(lambda df: stats.daily_trend(df, SCRAPE_NOW, 1, 55)),
        "recent_runs": on_runs(lambda df: stats.recent_runs(df).drop("started_at")),
        "zero_result_count": on_runs(lambda df: stats.zero_result_count(df, AS_OF)),
        "zero_result_runs": on_runs(lambda df: stats.zero_result_recent(df, AS_OF)),
        "dup_groups": on_scored(dedup.duplicate_groups),
        "dup_members": dup_members,
        "dedup_keepers": on_scored(dedup.keepers),
        "dedup_kept": lambda s, d: dedup.deduplicate(narrow(s, d))[0].select("id", "score", "status"),
        "dedup_removed": lambda s, d: dedup.deduplicate(narrow(s, d))[1].select("id", "score", "status"),
        "dedup_summary": on_scored(dedup.dedup_summary),
        "backfill_keys": backfill_keys,
        "rescore_changes": on_scored(lambda df: maintenance.rescore_changes(df, P0_EDITED, AS_OF)),
        "rescore_top": on_scored(lambda df: maintenance.rescore_top(maintenance.rescore_changes(df, P0_EDITED, AS_OF))),
        "rescore_top_cut": on_scored(
            lambda df: maintenance.rescore_top(maintenance.rescore_changes(df, P0_EDITED, AS_OF), widths=reports.CHANGE_WIDTHS)
        ),
        "rescore_summary": rescore_summary,
        "rescore_state": rescore_state,
        "status_fold": status_fold,
        "status_not_found": status_not_found,
        "valid_updates": valid_updates,
        "route_messages": route_messages,
        "route_messages_cut": lambda s, d: route_messages(s, d, 500),
        "upsert_snapshot": upsert_snapshot,
        "upsert_outcomes": upsert_outcomes,
        "upsert_chain": upsert_chain,
        "alerts": alerts,
        "ingest_postings": ingest_postings,
        "ingest_limited": ingest_limited,
        "ingest_run_log": ingest_run_log,
        "ingest_counters": ingest_counters,
        "ingest_preview": ingest_preview,
        "seen_first": seen_firsts,
        "task_cap": task_cap,
        "page_prefix": page_prefixes,
        "task_fanout": task_fanout,
        "enrich_descriptions": enrich_descriptions,
        "stream_details": stream_details,
        "digest_top10": digest_top10,
        "digest_text": digest_text,
        "alert_messages": alert_messages,
        "report_high": report("high", 40),
        "report_medium": report("medium", 55),
        "report_text": report_text,
        "stream_ingest": stream_ingest,
        "stream_status": stream_status,
        "stream_trend": stream_trend,
        "stream_messages": stream_messages,
        "schema_upgrade": schema_upgrade,
        "export_json": export_json,
        "export_chosen": export_chosen,
        "capped_descriptions": capped_descriptions,
        "point_lookup": lambda s, d: views.store(s, d).posting(7).select(LISTED),
        "digest_texts": digest_texts,
        "desktop_note": desktop_note,
        "fixed_locations": fixed_locations,
        "plugged_extractor": plugged_extractor,
        "upkept_store": upkept_store,
        "rollup_by_status": rollup("by_status"),
        "rollup_score_tiers": rollup("score_tiers"),
        "stream_alerts": stream_alerts,
        "stream_runs": stream_runs,
        "stream_misses": stream_misses,
        "reissued_ids": reissued_ids,
    }
    for site in ("indeed", "glassdoor", "ziprecruiter", "linkedin", "bayt", "google"):
        out[f"extract_{site}"] = extracted(site)
    out["extract_indeed_limited"] = extracted("indeed", max_pages=3, wanted=25)
    return out
