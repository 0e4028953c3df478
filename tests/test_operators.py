import csv
import glob
import json
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postlark.functions.keys import content_key
from postlark.operators import dedup, filters, maintenance, stats
from postlark.plans import reports
from postlark.profiles import Profile
from postlark.schemas import POSTINGS, RUNS, conform

NOW = datetime(2026, 4, 6, 12)


def postings(spark, *rows):
    """Whole postings from partial ones."""
    base = {
        "source": "indeed", "source_id": "s", "url": "http://u", "title": "T", "company": "C", "country": "US", "is_remote": False,
        "description": "", "job_type": [], "date_scraped": NOW, "score": 0, "score_breakdown": None, "status": "new", "notes": "",
    }
    names = [f.split(" ")[0] for f in POSTINGS.replace("struct<keyword:int,company:int,title:int,recency:int,dealbreaker:boolean>", "b").split(", ")]
    full = [{**base, "id": i + 1, **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], POSTINGS)


def ids(df):
    return [r.id for r in df.collect()]


def test_order_and_paging(spark):
    df = postings(
        spark,
        {"score": 10, "date_posted": None}, {"score": 10, "date_posted": date(2026, 4, 1)}, {"score": 90}, {"score": 10, "date_posted": date(2026, 4, 2)},
        {"score": 10, "date_posted": None},
    )
    assert ids(filters.list_postings(df)) == [3, 4, 2, 1, 5]
    assert ids(filters.list_postings(df, limit=2, offset=1)) == [4, 2]
    assert ids(filters.list_postings(df, limit=None, min_score=11)) == [3]
    assert len(ids(filters.list_postings(df, min_score=0, status="all", company="", source=""))) == 5


def test_company_filter(spark):
    df = postings(spark, {"company": "Big Corp"}, {"company": "100% Co"}, {"company": "back\\slash"})
    assert ids(filters.apply_filters(df, company="big")) == [1]
    assert ids(filters.apply_filters(df, company="b_g")) == [1]
    assert ids(filters.apply_filters(df, company="k\\s")) == [3]


def test_posted_range(spark):
    df = postings(spark, *[{"date_posted": d} for d in (None, date(2026, 4, 1), date(2026, 3, 20))])
    assert ids(filters.posted_range(df, NOW, days=7)) == [1, 2]
    assert ids(filters.posted_range(df, NOW, since="2026-03-20", until="2026-03-20")) == [1, 3]
    assert ids(filters.fresh(df, NOW, 5)) == [1]
    with pytest.raises(ValueError, match="excludes"):
        filters.posted_range(df, NOW, days=1, until="2026-01-01")
    with pytest.raises(ValueError, match="invalid date"):
        filters.posted_range(df, NOW, since="soon")


def test_alert_states(spark):
    df = postings(spark, {"state": "TX", "is_remote": True}, {"state": "CA"}, {"state": "TX"}, {"state": None})
    assert ids(filters.alert_states_filter(df, ["California", "WA"])) == [1, 2, 4]
    assert len(ids(filters.alert_states_filter(df, []))) == 4


def test_thresholds():
    assert filters.list_threshold("new", None, 20) == 20
    assert filters.list_threshold("filtered", None, 20) == 0
    assert filters.list_threshold("filtered", 5, 20) == 5


def test_recent_and_lookup(spark):
    old = NOW - timedelta(days=30)
    df = postings(spark, {"score": 1}, {"date_scraped": old, "status": "applied"}, {"date_scraped": old}, {"dedup_key": "k", "score": 5})
    assert ids(filters.recent_context(df, NOW)) == [4, 1, 2]
    assert ids(filters.by_id(df, 3)) == [3]
    assert ids(filters.existing(df, spark.createDataFrame([("k",), ("k",), ("z",)], "dedup_key string"))) == [4]


def test_statistics(spark):
    df = postings(
        spark,
        {"score": 66, "search_term": "a"}, {"score": 52, "search_term": "a"}, {"score": 24, "search_term": "b"},
        {"score": 91, "date_scraped": NOW - timedelta(days=2)}, {"score": 0, "status": "filtered", "search_term": "b"},
    )
    r = stats.alert_stats(df.where("score > 0"), NOW, 24, 55).first()
    assert (r.total_new, r.scraped, r.high_count, r.medium_count) == (4, 3, 1, 1)
    assert {x.tier: x.cnt for x in stats.score_tiers(df).collect()} == {
        "excellent (80+)": 1, "good (55-79)": 1, "review (30-54)": 1, "low (<30)": 1,
    }
    assert [(x.search_term, x.cnt, x.avg_score) for x in stats.by_search_term(df).collect()] == [("a", 2, 59.0), ("b", 1, 24.0)]
    assert [(x.day, x.total, x.high, x.medium) for x in stats.daily_trend(df, NOW, 1, 55).collect()] == [(NOW.date(), 4, 1, 1)]
    assert len(stats.daily_trend(df, NOW, 2, 55).collect()) == 2
    runs = spark.createDataFrame(
        [
            (1, NOW, NOW, "s", "t", "l", 0, 0, None), (2, NOW, NOW, "s", "t", "l", 0, 0, "e"), (3, NOW, None, "s", "t", "l", None, None, None),
            (4, NOW - timedelta(days=8), NOW, "s", "t", "l", 0, 0, None), (5, NOW, NOW, "s", "t", "l", 3, 1, None),
        ], RUNS,
    )
    out = {k: v.collect() for k, v in stats.stats(df, runs, NOW).items()}
    assert out["zero_result_count"][0].cnt == 2 and len(out["zero_result_runs"]) == 2
    assert [r.id for r in out["recent_runs"]] == [5, 3, 2, 1, 4]
    assert out["total"][0].total == 5


def test_keepers(spark):
    old = NOW - timedelta(days=1)
    groups = {
        "a": [("new", 90, NOW), ("offer", 1, NOW), ("applied", 99, NOW)],
        "b": [("rejected", 99, NOW), ("filtered", 0, NOW), ("odd", 99, NOW)],
        "c": [("new", 5, NOW), ("new", 7, NOW), ("new", 7, old)],
        "d": [("new", 7, NOW), ("new", 7, NOW)],
        "e": [("new", 1, NOW)],
        None: [("new", 1, NOW), ("new", 1, NOW)],
    }
    df = postings(spark, *[{"content_key": k, "status": s, "score": n, "date_scraped": t} for k, rows in groups.items() for s, n, t in rows])
    kept, removed = dedup.deduplicate(df)
    assert sorted(ids(kept)) == [2, 5, 9, 10, 12, 13, 14]
    assert sorted(ids(removed)) == [1, 3, 4, 6, 7, 8, 11]
    r = dedup.dedup_summary(df).first()
    assert (r.groups, r.removed, r.kept) == (4, 7, 4)
    assert len(dedup.duplicate_members(df).collect()) == 11


def test_dedup_with_a_hot_key(spark):
    df = spark.range(900).selectExpr(
        "id", "case when id % 3 = 0 then 'hot' else cast(id as string) end content_key", "'new' status", "cast(id % 50 as int) score", "timestamp_ntz'2026-01-01' date_scraped"
    )
    kept, removed = dedup.deduplicate(df)
    assert (kept.count(), removed.count()) == (601, 299)
    assert kept.where("content_key = 'hot'").first().id == 99
    assert dedup.duplicate_members(df).where("cnt = 300").count() == 300


def test_status_events(spark):
    df = postings(spark, {"notes": "old"}, {"applied_date": date(2026, 1, 1)}, {})
    d = date(2026, 4, 5)
    events = spark.createDataFrame(
        [
            (3, 1, "rejected", "", d + timedelta(days=1)), (1, 1, "interview", "", d), (2, 1, "applied", "called", d + timedelta(days=9)),
            (4, 2, "offer", None, d), (5, 99, "applied", "", d),
        ], "seq bigint, posting_id bigint, status string, notes string, event_date date",
    )
    state, missing = maintenance.apply_status_events(df, events)
    got = {r.id: (r.status, r.notes, r.applied_date) for r in state.collect()}
    assert got == {1: ("rejected", "called", d), 2: ("offer", "", date(2026, 1, 1)), 3: ("new", "", None)}
    assert [r.posting_id for r in missing.collect()] == [99]


def test_valid_updates(one):
    text = json.dumps(
        {"updates": [{"job_id": 1, "status": "applied", "notes": None}, {"job_id": "x", "status": "offer"}, {"job_id": 2, "status": "new"}, {"job_id": 3}, {"job_id": 4.5, "status": "offer"}]}
    )
    got = one(maintenance.valid_updates(F.col("t")), t=("string", text))
    assert [(u.job_id, u.status, u.notes) for u in got] == [(1, "applied", "")]
    for bad in ("{}", "oops", None):
        assert one(maintenance.valid_updates(F.col("t")), t=("string", bad)) == []


def test_rescore(spark):
    profile = Profile("p", {"critical": ["python"]}, {}, {"title": ["bad"]})
    df = postings(
        spark,
        {"description": "python", "score": 8, "date_posted": None, "score_breakdown": (9, 9, 9, 9, None)},  # 5 + 3 = 8: unchanged
        {"description": "python", "score": 50},
        {"title": "bad", "score": 30},
        {"title": "bad", "score": 30, "status": "applied"},
        {"status": "filtered", "score": 0},
        {"status": "filtered", "score": 3, "source": "bayt"},
    )
    state, changes = maintenance.rescore(df, profile, NOW)
    got = {r.id: (r.score, r.status) for r in state.collect()}
    assert got == {1: (8, "new"), 2: (8, "new"), 3: (0, "filtered"), 4: (0, "applied"), 5: (3, "new"), 6: (3, "new")}
    assert state.where("id = 1").first().score_breakdown.keyword == 9
    assert sorted((r.id, r.delta) for r in changes.collect()) == [(2, -42), (3, -30), (4, -30), (5, 3)]
    assert changes.where("id = 3").first().breakdown == '{"dealbreaker":true}'
    assert ids(maintenance.rescore_top(changes, 2)) == [2, 3]
    r = maintenance.rescore_summary(df, profile, NOW).first()
    assert (r.total, r.changed, r.min_delta, r.max_delta, r.newly_filtered, r.unfiltered) == (6, 4, -42, 3, 1, 2)
    assert r.avg_delta == pytest.approx(-99 / 4)
    only, log = maintenance.rescore(df, profile, NOW, status="new", source="indeed")
    assert {r.id: r.score for r in only.collect()} == {1: 8, 2: 8, 3: 0, 4: 30, 5: 0, 6: 3}
    assert sorted(ids(log)) == [2, 3]


def test_backfill_and_location_fixes(spark):
    df = postings(
        spark,
        {"city": "California", "state": "United States", "content_key": None}, {"city": "Remote", "is_remote": True, "content_key": "kept"},
        {"city": "United States"}, {"city": "Detroit", "state": "USA"}, {"city": "A", "state": "Texas"}, {"city": "A", "country": "canada"},
        {"city": "ok", "state": "CA"}, {"city": "  A "},
    )
    filled = maintenance.backfill_content_keys(df)
    want = spark.range(1).select(
        content_key(F.lit("T"), F.lit("C"), F.lit(None).cast("string"), F.lit("CA"), F.lit(None).cast("date"), F.lit(""))
    ).first()[0]
    assert {r.id: r.content_key for r in filled.where("id < 3").collect()} == {1: want, 2: "kept"}
    assert filled.where("id = 1").first().city == "California"
    state, counts = maintenance.fix_locations(df)
    assert {r.reason: r.cnt for r in counts.collect()} == {
        "fields_shifted": 1, "remote_cleared": 1, "country_from_city": 1, "country_from_state": 1, "state_abbreviated": 1, "country_normalized": 1, "other": 1,
    }
    assert state.where("id = 8").first().city == "A"
    assert maintenance.fix_locations(state)[1].count() == 0


def test_export(spark, tmp_path):
    df = postings(
        spark,
        {"company": 'Q "R" & Sons, Ltd', "score": 77, "date_posted": date(2026, 4, 4), "score_breakdown": (52, 15, 0, 10, None), "comp_min": 64000.0, "comp_max": 81000.0, "comp_interval": "yearly"},
        {"company": "Umber", "score": 43, "status": "applied", "date_posted": date(2026, 3, 20)},
        {"company": "Violet\nrow", "score": 30, "source": "google", "status": "filtered"},
    )
    path = str(tmp_path / "out.csv")
    assert reports.export_postings(df, path, NOW, days=7) == 2
    rows = [r for f in sorted(glob.glob(path + "/*.csv")) for r in csv.DictReader(open(f, newline=""))]
    assert [r["company"] for r in rows] == ['Q "R" & Sons, Ltd', "Violet\nrow"]
    assert list(rows[0]) == reports.EXPORT_FIELDS
    assert rows[0]["salary"] == "$64,000 - $81,000 /yearly" and rows[1]["date_posted"] == ""
    assert reports.export_postings(df, path, NOW, status="offer") == 0
    (empty,) = [open(f).read() for f in glob.glob(path + "/*.csv")]
    assert empty.strip() == ",".join(reports.EXPORT_FIELDS)
    path = str(tmp_path / "out.json")
    assert reports.export_postings(df, path, NOW) == 3
    rows = [json.loads(line) for f in sorted(glob.glob(path + "/*.json")) for line in open(f)]
    assert [r["id"] for r in rows] == [1, 2, 3] and rows[0]["score_breakdown"]["keyword"] == 52
    assert reports.export_format("a.JSON", None) == "json" and reports.export_format("a.json", "CSV") == "csv"
    with pytest.raises(ValueError):
        reports.export_postings(df, path, NOW, fmt="xml")


def test_messages(spark):
    df = postings(
        spark,
        {"title": "Dev_1", "company": "A&B", "score": 60, "score_breakdown": (20, 0, 0, 0, None), "city": "X", "comp_min": 181000.0, "comp_max": 318000.0},
        {"score": 70, "score_breakdown": (None, None, None, None, True)},
    )
    lines = {c: [r.message_line for r in reports.alert_batch(df, c, "p").orderBy("rank").collect()] for c in reports.CHANNELS}
    assert lines["email"] == ["[70] (kw:?) #2 C: T\n  Unknown\n  http://u\n", "[60] (kw:20) #1 A&B: Dev_1\n  X | $181k-$318k\n  http://u\n"]
    assert lines["telegram"][1] == "*60* \\(kw:20\\) \\| \\#1 [A&B: Dev\\_1](http://u)\n  X \\| $181k\\-$318k"
    assert lines["slack"][1] == "*A&amp;B: Dev_1*\nScore: 60 | keywords: 20 | #1   X | $181k-$318k\nhttp://u"
    assert lines["discord"][1] == "**A&B: Dev\\_1**\nScore: 60 | keywords: 20 | #1   X | $181k-$318k\nhttp://u"
    note = reports.macos_summary(df).first()
    assert (note.title, note.body) == ("postlark: 2 new matches", "C: T (70)\\\\nA&B: Dev_1 (60)")
    single = reports.macos_summary(df.where("id = 1"), "p").first()
    assert (single.title, single.body) == ("postlark (p): A&B", "Dev_1 (Score: 60)")
    assert reports.macos_summary(df.limit(0)).count() == 0


def test_digest_and_report(spark):
    rows = [{"score": 40 + i % 30, "title": f"t{i}"} for i in range(60)] + [{"score": 99, "date_scraped": NOW - timedelta(days=3)}]
    df = postings(spark, *rows)
    top = reports.digest_rows(df, NOW, 55, []).collect()
    assert len(top) == 10 and {r.matches for r in top} == {30} and top[0].score == 69
    text = reports.digest_text(df, NOW, "telegram", 55, []).first().text
    assert text.startswith("*postlark digest* — 30 match\\(es\\)\n\n*69*") and text.endswith("\U0001f4ca 61 unreviewed \\| 60 scraped today")
    assert reports.digest_text(df, NOW, "email", 101, []).count() == 0
    tables = reports.report_tables(df, NOW, 55)
    assert (tables["high"].count(), tables["medium"].count(), tables["medium_total"].first().cnt) == (20, 20, 30)
    report = reports.report_text(tables, 55, NOW).first().text
    assert "*(showing top 20 of 30)*" in report and "| 2026-04-06 | 60 | 30 | 30 |" in report
    empty = reports.report_text(reports.report_tables(df.limit(0), NOW, 55), 55, NOW).first().text
    assert "## High" not in empty and "Trend" not in empty


def test_schema_upgrade(spark):
    old = postings(spark, {}).drop("search_term", "content_key")
    new = conform(old, POSTINGS)
    assert new.columns == conform(new, POSTINGS).columns and new.first().search_term is None


def test_routes(spark):
    said = spark.createDataFrame([("c1", "x" * 600), ("c9", "hi")], "chat_id string, text string")
    routes = spark.createDataFrame([("c1", "me")], "chat_id string, profile string")
    (r,) = maintenance.route_messages(said, routes).collect()
    assert (r.profile, len(r.text)) == ("me", 600)
    assert len(maintenance.route_messages(said, routes, 500).first().text) == 500


def test_deep_pages_equal_offset_paging_and_read_their_range_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(filters, "ID_BLOCK", 16)
    rnd = random.Random(3)
    # a third of all postings share one score and day; scores and days may be missing
    cells = [(50, date(2024, 1, 1))] + [(s, d) for s in (None, 0, 7, 99) for d in (None, date(2024, 1, 1), date(2024, 1, 1) + timedelta(9))]
    rows = [(i, *(cells[0] if i % 3 == 0 else rnd.choice(cells))) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, score int, date_posted date")
    half = df.where("id < 300")
    counts = filters.order_counts(half).unionByName(filters.order_counts(df.where("id >= 300"))).cache()
    want = [r.id for r in filters.list_postings(df, status="all", limit=None).collect()]
    for offset, limit in ((0, 10), (95, 30), (230, 60), (333, 1), (560, 50), (595, 50), (600, 5), (5000, 5)):
        assert [r.id for r in filters.deep_page(df, counts, limit=limit, offset=offset).collect()] == want[offset : offset + limit]
    # a removed posting takes one off its cell
    gone = [r for r in rows if r[0] == want[100]]
    less = counts.unionByName(filters.order_counts(spark.createDataFrame(gone, df.schema)).selectExpr("score", "date_posted", "id_block", "-n as n"))
    left = df.where(F.col("id") != want[100])
    assert [r.id for r in filters.deep_page(left, less, limit=20, offset=300).collect()] == [i for i in want if i != want[100]][300:320]
    path = str(tmp_path / "postings")
    df.write.parquet(path)
    page = filters.deep_page(spark.read.parquet(path), counts, limit=5, offset=200)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(score," in plan and "LessThanOrEqual(score," in plan
    assert filters.deep_page(df.where("false"), counts.where("false")).collect() == []
