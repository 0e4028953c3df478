import json
import os
from datetime import datetime, timedelta
from functools import partial

from pyspark.sql import functions as F

from postlark.operators import rollups, stats
from postlark.operators.spread import cut
from postlark.operators.upsert import apply_changes
from postlark.plans import ingest as ingesting
from postlark.plans.ingest import ingest_counters
from postlark.profiles import Profile
from postlark.schemas import PAYLOADS, POSTINGS
from postlark.sources.cards import late_descriptions
from postlark.streaming import jobs
from postlark.streaming.jobs import continuous_trend, merged_messages, start_status, status_batch
from postlark.streaming.store import Store

# All pages here are of one site, so the other extractors are left out.
SHORT = ingesting.Limits(content_min_chars=100)
ingest = partial(ingesting.ingest, sites=["indeed"], limits=SHORT)
start_ingest = partial(jobs.start_ingest, sites=["indeed"], limits=SHORT)
ingest_batch = partial(jobs.ingest_batch, sites=["indeed"], limits=SHORT)

NOW = datetime(2026, 1, 31, 12)
PROFILE = Profile("me", {"critical": ["python"]}, {}, {"title": ["(?i)intern"]}, min_alert_score=8, min_display_score=8)
LONG = "python " + "words " * 40


def page(run_id, *jobs, page_no=1, site="indeed", status=200, at=NOW):
    results = [
        {"job": {"key": k, "title": t, "description": {"html": d}, "location": {"city": c, "countryCode": "US"}, "employer": {"name": "E"}}}
        for k, t, d, c in jobs
    ]
    body = json.dumps({"data": {"jobSearch": {"pageInfo": {"nextCursor": "n"}, "results": results}}})
    return (run_id, site, f"term{run_id}", "loc", page_no, at, status, "u", body)


def landed(spark, *pages):
    return spark.createDataFrame(list(pages), PAYLOADS)


PAGES = [
    page(1, ("a", "Dev", LONG, "X"), ("b", "Dev", LONG, "X"), ("c", "Intern", LONG, "Y"), ("d", "Dev", "short", "Z")),
    page(2, ("a", "Dev two", "python now", "X"), ("e", "Dev", "short", "Z"), ("f", "Ops", LONG + "more", "Q")),
    page(3),
]


def test_ingest(spark):
    done = ingest(landed(spark, *PAGES), spark.createDataFrame([], POSTINGS), PROFILE, NOW)
    outcome = [(r.kind, r.target_id) for r in done.outcome.orderBy("seq").collect()]
    # b repeats a's content; a comes again by key; short texts never match by content
    assert outcome == [("insert", 1), ("content", 1), ("insert", 2), ("insert", 3), ("key", 1), ("insert", 4), ("insert", 5)]
    rows = {r.id: r for r in done.inserted.collect()}
    assert (rows[1].title, rows[1].score, rows[1].status, rows[1].search_term) == ("Dev", 8, "new", "term1")
    assert (rows[2].status, rows[2].score, rows[2].score_breakdown.dealbreaker) == ("filtered", 0, True)
    assert rows[3].content_key is not None and rows[1].created_at == NOW
    runs = {r.id: (r.jobs_found, r.jobs_new, r.error) for r in done.runs.collect()}
    assert runs == {1: (4, 2, None), 2: (3, 2, None), 3: (0, 0, None)}
    assert sorted(r.id for r in done.alerts.collect()) == [1, 5]
    c = ingest_counters(done.arrivals, done.outcome).first()
    assert (c.total_found, c.total_new, c.total_filtered) == (6, 4, 1)


def test_second_ingest_updates(spark):
    empty = spark.createDataFrame([], POSTINGS)
    state = ingest(landed(spark, *PAGES), empty, PROFILE, NOW).inserted
    state = state.withColumn("status", F.when(F.col("id") == 3, "applied").otherwise(F.col("status")))
    richer = Profile("me", {"critical": ["python", "words"]}, {}, {"title": ["Ops"]})
    errors = spark.createDataFrame([(5, "boom")], "run_id bigint, error string")
    done = ingest(landed(spark, page(4, ("z", "Dev", LONG, "X"), ("d", "Ops", "short", "Z"), ("f", "Ops", LONG, "Q")), page(5)), state, richer, NOW, errors=errors)
    assert done.inserted.count() == 0 and done.alerts.count() == 0
    after = {r.id: (r.score, r.status) for r in apply_changes(state, done.updated).collect()}
    # a copy raises the score; a dealbreaker by key resets it but leaves an applied posting applied
    assert after == {1: (13, "new"), 2: (0, "filtered"), 3: (0, "applied"), 4: (3, "new"), 5: (0, "filtered")}
    assert {r.id: (r.jobs_found, r.error) for r in done.runs.collect()} == {4: (3, None), 5: (0, "boom")}


def test_dry_run(spark):
    shown = ingest(landed(spark, *PAGES), spark.createDataFrame([], POSTINGS), PROFILE, NOW, dry_run=True)
    assert sorted((r.title, r.dealbreaker) for r in shown.collect()) == [("Dev", False), ("Dev", False), ("Dev two", False), ("Intern", True), ("Ops", False)]


def snapshot(store):
    return {r.id: (r.source_id, r.title, r.score, r.status, r.notes, r.applied_date) for r in store.state().collect()}


def test_stream_equals_batch(spark, tmp_path):
    files = tmp_path / "landing"
    # The first run lands in two batches, its second page repeating a posting of the first.
    pages = [PAGES[0], page(1, ("a", "Dev", LONG, "X"), ("g", "New", LONG + "g", "G"), page_no=2), *PAGES[1:]]
    for i, p in enumerate(pages):
        landed(spark, p).coalesce(1).write.json(str(files / f"f{i}"))
        if i == 0:
            store = Store(spark, str(tmp_path / "store"))
        start_ingest(spark, str(files / "*"), store, PROFILE, str(tmp_path / "cp"), max_files=1).awaitTermination()
    got = snapshot(store)
    batch = ingest(landed(spark, *pages), spark.createDataFrame([], POSTINGS), PROFILE, NOW)
    assert sorted(v[0] for v in got.values()) == sorted(r.source_id for r in batch.inserted.collect())
    runs = lambda df: {r.id: (r.jobs_found, r.jobs_new) for r in df.collect()}
    assert runs(store.runs()) == runs(batch.runs) and store.alerts().count() == batch.alerts.count()
    # Nothing new: a second run changes nothing, and a replayed batch writes what it wrote.
    start_ingest(spark, str(files / "*"), store, PROFILE, str(tmp_path / "cp"), max_files=1).awaitTermination()
    ingest_batch(store, PROFILE)(landed(spark, pages[-1]), len(pages) - 1)
    assert snapshot(store) == got and runs(store.runs()) == runs(batch.runs)


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.state().count() == 0 and store.last_id() == 0
    first = ingest(landed(spark, PAGES[0]), store.state(), PROFILE, NOW)
    for _ in range(2):  # a replay overwrites its own partitions
        store.commit("ingest", 0, inserted=first.inserted, runs=first.runs)
    assert store.state().count() == 3
    events = spark.createDataFrame(
        [(1, 1, "applied", "sent", NOW.date()), (2, 77, "offer", "", NOW.date())],
        "seq bigint, posting_id bigint, status string, notes string, event_date date",
    )
    status_batch(store)(events, 0)
    status_batch(store)(events, 0)
    assert [r.posting_id for r in store.read("misses").collect()] == [77]
    later = NOW + timedelta(days=1)
    second = ingest(landed(spark, page(9, ("a", "Dev", LONG, "X"), ("n", "New", LONG + "n", "N"), at=later)), store.state(), PROFILE, later)
    store.commit("ingest", 1, inserted=second.inserted, changed=second.updated)
    before = snapshot(store)
    assert before[1][3:] == ("applied", "sent", NOW.date()) and before[4][1] == "New" and len(before) == 4
    store.commit("dedup", 0, removed=spark.createDataFrame([(2,)], "id bigint"))
    assert snapshot(store) == {k: v for k, v in before.items() if k != 2}
    store.commit("fix", 1, changed=spark.createDataFrame([(1, "there")], "id bigint, city string"))
    assert store.state().where("id = 1").first().city == "there" and snapshot(store)[1] == before[1]


def test_a_small_batch_reads_its_buckets_only(spark, tmp_path):
    """As the store doubles, what a batch of ten postings opens stays as it is."""
    row = ingest(landed(spark, PAGES[0]), spark.createDataFrame([], POSTINGS), PROFILE, NOW).inserted.limit(1)
    opened, touched = [], []
    for n in (2_000, 4_000):
        store = Store(spark, str(tmp_path / str(n)), bucket_rows=50)
        many = spark.range(1, n + 1).select("id", F.format_string("k%d", "id").alias("dedup_key"), F.format_string("c%d", F.col("id") % 997).alias("content_key"))
        rows = cut(row.drop("id", "dedup_key", "content_key").crossJoin(many))
        store.commit("load", 0, inserted=rows)
        found = cut(many.where(F.col("id") % (n // 10) == 7).withColumn("long", F.lit(True)).drop("id"))
        got = store.matching(found)
        want = rows.join(found.select("dedup_key"), "dedup_key", "left_semi").select("id")
        oldest = rows.join(found, "content_key", "left_semi").groupBy("content_key").agg(F.min("id").alias("id")).select("id")
        assert {r.id for r in got.select("id").collect()} == {r.id for r in want.union(oldest).collect()}
        keys = store.touching("keys", found)
        plan = keys._jdf.queryExecution().toString()
        assert "PartitionFilters" in plan and "bucket" in plan
        held = {r.bucket for r in keys.select("bucket").distinct().collect()}
        assert 0 < len(held) <= 10
        opened.append(sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(f"{store.root}/keys") for f in files if f.endswith(".parquet") and int(d.rsplit("=", 1)[1]) in held))
        touched.append(sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(f"{store.root}/keys") for f in files if f.endswith(".parquet")))
        one = store.posting(7)
        assert [r.dedup_key for r in one.collect()] == ["k7"] and store.by_keys(spark.createDataFrame([("k9",), ("none",)], "dedup_key string")).first().id == 9
    assert touched[1] > 1.6 * touched[0] and opened[1] < 1.3 * opened[0]


def test_lookups_see_changes_and_removals(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), bucket_rows=1)
    store.commit("ingest", 0, inserted=ingest(landed(spark, *PAGES), store.state(), PROFILE, NOW).inserted)
    before = snapshot(store)
    store.commit("fix", 0, changed=spark.createDataFrame([(1, "there")], "id bigint, city string"))
    store.commit("fix", 1, changed=spark.createDataFrame([(1, "offer")], "id bigint, status string"))
    store.commit("dedup", 0, removed=spark.createDataFrame([(2,)], "id bigint"))
    one = store.posting(1).first()
    assert (one.city, one.status) == ("there", "offer") and store.posting(2).count() == 0
    assert {r.id for r in store.by_ids(store.state().select("id")).collect()} == set(before) - {2}
    assert Store(spark, str(tmp_path / "none")).posting(1).count() == 0


def test_rollups_equal_full_statistics_after_any_order(spark, tmp_path):
    """Inserts, status changes, removals and late replays, interleaved."""
    store = Store(spark, str(tmp_path / "store"), bucket_rows=2)
    ids = lambda *rows: spark.createDataFrame(rows, "id bigint, status string, score int")
    first = ingest(landed(spark, *PAGES), store.state(), PROFILE, NOW).inserted
    later = cut(first.withColumns({"id": F.col("id") + 100, "dedup_key": F.concat("dedup_key", F.lit("x")), "score": F.lit(60), "search_term": F.lit("other")}))
    first = cut(first)
    steps = {
        ("ingest", 0): {"inserted": first},
        ("status", 0): {"changed": ids((1, "applied", 1), (3, "filtered", 85))},
        ("ingest", 1): {"inserted": later, "changed": ids((1, "new", 44))},
        ("status", 1): {"changed": ids((1, "offer", 50), (101, "filtered", 60), (102, "new", 30))},
        ("dedup", 0): {"removed": spark.createDataFrame([(2,), (102,), (999,)], "id bigint")},
    }

    def check():
        state, cells = store.state(), store.cells()
        for full, kept in (
            (stats.by_status(state), rollups.by_status(cells)), (stats.by_source(state), rollups.by_source(cells)),
            (stats.score_tiers(state), rollups.score_tiers(cells)), (stats.by_search_term(state), rollups.by_search_term(cells)),
            (stats.daily_trend(state, NOW, 60, 55), rollups.daily_trend(cells, NOW, 60, 55)),
        ):
            assert sorted(map(tuple, kept.collect()), key=repr) == sorted(map(tuple, full.collect()), key=repr)

    for own, kinds in steps.items():
        store.commit(*own, **kinds)
    check()
    before = snapshot(store)
    assert before[1][3] == "offer" and len(before) == 2 * first.count() - 2
    for own in (("ingest", 1), ("status", 0)):  # written again after others have come
        store.commit(*own, **steps[own])
    assert snapshot(store) == before
    check()
    store = store.compacted(str(tmp_path / "two"))
    assert snapshot(store) == before
    check()


def test_old_sightings_are_not_read(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    days = [(1, "a", "2026-01-01"), (1, "b", "2026-02-01"), (2, "a", "2026-02-01")]
    store.commit("ingest", 0, seen=spark.createDataFrame(days, "run_id bigint, seen_key string, day string"))
    runs = spark.createDataFrame([(1,)], "run_id bigint")
    got = store.seen(runs, F.lit("2026-01-15").cast("date"))
    assert [(r.run_id, r.seen_key) for r in got.collect()] == [(1, "b")]


def test_removed_ids_are_never_issued_again(spark, tmp_path):
    store = Store(spark, str(tmp_path / "one"))
    store.commit("ingest", 0, inserted=ingest(landed(spark, PAGES[0]), store.state(), PROFILE, NOW).inserted)
    store.commit("dedup", 0, removed=spark.createDataFrame([(3,)], "id bigint"))
    for number, kept in enumerate((store, store.compacted(str(tmp_path / "two")))):
        fresh = landed(spark, page(8, ("n", "New", LONG + "n", "N")))
        done = ingest(fresh, kept.state(), PROFILE, NOW, last_id=kept.last_id())
        kept.commit("ingest", 5, inserted=done.inserted)
        assert sorted(snapshot(kept)) == [1, 2, 4] and snapshot(kept)[4][0] == "n"


def test_whole_texts_and_runs_unless_limited(spark):
    many = [(f"k{i}", f"Job {i}", ("words " * 12_000) + str(i), "X") for i in range(40)]
    done = ingesting.ingest(landed(spark, page(1, *many[:20]), page(1, *many[20:], page_no=5)), spark.createDataFrame([], POSTINGS), PROFILE, NOW, sites=["indeed"])
    rows = done.inserted.collect()
    assert len(rows) == 40 and all(len(r.description) > 70_000 for r in rows)
    cut = ingesting.ingest(landed(spark, page(1, *many)), spark.createDataFrame([], POSTINGS), PROFILE, NOW, sites=["indeed"], limits=ingesting.COLLECTOR)
    rows = cut.inserted.collect()
    assert len(rows) == 25 and all(len(r.description) == 50_000 for r in rows)


def test_texts_move_once(spark):
    """One exchange of an ingest's result carries descriptions."""
    done = ingest(landed(spark, *PAGES), spark.createDataFrame([], POSTINGS), PROFILE, NOW)
    plan = done.inserted._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Relation" in line and "description" in line]
    assert len(joins) == 1
    assert "description" not in done.arrivals.columns


def test_enrichment_and_freshness(spark):
    card = """<div class="base-search-card"><a class="base-card__full-link" href="/v/x-{0}"></a><span class="sr-only">T{0}</span>
      <div class="base-search-card__metadata"><time class="job-search-card__listdate" datetime="{1}"></time></div></div>"""
    body = card.format(1, "2026-01-30") + card.format(2, "2026-01-30") + card.format(3, "2026-01-02")
    payloads = landed(spark, (1, "linkedin", "t", "l", 1, NOW, 200, "u", body))
    block = "<div class='show-more-less-html__markup'>{}</div>"
    details = spark.createDataFrame(
        [("1", 200, "u", block.format("old words"), NOW), ("1", 200, "u", block.format("python words"), NOW + timedelta(hours=1)), ("3", 200, "u", block.format("python"), NOW)],
        "source_id string, status_code int, url string, body string, fetched_at timestamp_ntz",
    )
    done = ingesting.ingest(payloads, spark.createDataFrame([], POSTINGS), PROFILE, NOW, sites=["linkedin"], details=details, hours_old=72)
    rows = {r.source_id: r for r in done.inserted.collect()}
    assert set(rows) == {"1", "2"} and (rows["1"].description, rows["2"].description) == ("python words", "")
    assert rows["1"].score > rows["2"].score and rows["1"].content_key != rows["2"].content_key


def test_detail_pages_may_come_before_with_or_after_their_card(spark, tmp_path):
    block = "<div class='show-more-less-html__markup'>{}</div>"
    cards_layout = "source_id string, title string, city string, state string, is_remote boolean, description string, date_scraped timestamp_ntz"
    pages_layout = "source_id string, status_code int, url string, body string, fetched_at timestamp_ntz"
    card = lambda k, at=NOW: (k, f"T{k}", None, None, False, "", at)
    detail = lambda k, at=NOW, url="u": (k, 200, url, block.format(f"text {k}"), at)
    far = NOW + timedelta(days=30)
    steps = [
        ([], [detail("1")]), ([card("1"), card("2"), card("3"), card("4"), card("5")], [detail("2"), detail("5", url="https://linkedin.com/signup")]),
        ([], [detail("3", NOW + timedelta(hours=20))]), ([card("9", far)], [detail("9", far)]),
    ]
    for name in ("cards", "pages"):
        (tmp_path / name).mkdir()
    for cards, pages in steps:
        for name, rows, layout in (("cards", cards, cards_layout), ("pages", pages, pages_layout)):
            if rows:
                spark.createDataFrame(rows, layout).write.mode("append").parquet(str(tmp_path / name))
        streams = [spark.readStream.schema(layout).parquet(str(tmp_path / name)) for name, layout in (("cards", cards_layout), ("pages", pages_layout))]
        out = late_descriptions(*streams).writeStream.option("checkpointLocation", str(tmp_path / "cp")).format("parquet").option("path", str(tmp_path / "out"))
        out.trigger(availableNow=True).start().awaitTermination()
    got = {r.source_id: r.description for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"1": "text 1", "2": "text 2", "3": "text 3", "4": "", "5": "", "9": "text 9"}


def test_status_stream(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.commit("ingest", 0, inserted=ingest(landed(spark, PAGES[0]), store.state(), PROFILE, NOW).inserted)
    for i, status in enumerate(["applied", "interview"]):
        text = json.dumps({"seq": i, "posting_id": 3, "status": status, "notes": "", "event_date": f"2026-02-0{i + 1}"})
        (tmp_path / "ev").mkdir(exist_ok=True)
        (tmp_path / "ev" / f"{i}.json").write_text(text)
        start_status(spark, str(tmp_path / "ev"), store, str(tmp_path / "cp")).awaitTermination()
    r = store.state().where("id = 3").first()
    assert (r.status, str(r.applied_date)) == ("interview", "2026-02-01")


def test_merged_messages_and_trend(spark, tmp_path):
    routes = spark.createDataFrame([("c1", "me")], "chat_id string, profile string")
    for name in ("s1", "s2"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.json").write_text(json.dumps({"chat_id": "c1", "text": name}) + "\n" + json.dumps({"chat_id": "x", "text": "no"}))
    streams = [spark.readStream.schema("chat_id string, text string").json(str(tmp_path / n)) for n in ("s1", "s2")]
    q = merged_messages(streams, routes).writeStream.format("memory").queryName("said").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.text for r in spark.table("said").collect()) == ["s1", "s2"]
    (tmp_path / "sc").mkdir()
    (tmp_path / "sc" / "a.json").write_text("\n".join(json.dumps({"date_scraped": f"2026-01-0{d}T05:00:00", "score": s}) for d, s in ((1, 60), (1, 45), (2, 10))))
    scored = spark.readStream.schema("date_scraped timestamp_ntz, score int").json(str(tmp_path / "sc"))
    q = continuous_trend(scored, 55).writeStream.format("memory").queryName("trend").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((str(r.day), r.total, r.high, r.medium) for r in spark.table("trend").collect()) == [("2026-01-01", 2, 1, 1), ("2026-01-02", 1, 0, 0)]
