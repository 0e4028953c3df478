import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from postlark.schemas import PAYLOADS
from postlark.sources import cards, positional
from postlark.sources.payloads import (
    cap_per_task,
    extract,
    extractor,
    ingest_tasks,
    page_prefix,
    read_payloads,
    register_extractor,
    run_rows,
    seen_first,
)

NOW = datetime(2024, 1, 31, 12)


def payload(site, body, run_id=1, page_no=1, status=200):
    text = body if isinstance(body, str) or body is None else json.dumps(body)
    return (run_id, site, "term", "place", page_no, NOW, status, "http://x", text)


def rows_of(spark, *payloads):
    df = spark.createDataFrame(list(payloads), PAYLOADS)
    out = extract(df, NOW, sorted({p[1] for p in payloads})).where("seen_key is not null")
    return sorted(out.collect(), key=lambda r: (r.run_id, r.page_no, r.pos))


def indeed_body(*jobs, cursor=None, wrap=True):
    results = [{"job": j} if wrap else j for j in jobs]
    return {"data": {"jobSearch": {"pageInfo": {"nextCursor": cursor}, "results": results}}}


INDEED = {
    "key": "q81",
    "title": "Lamp Keeper",
    "description": {"html": "<p>Mind the lamp</p>"},
    "location": {"city": "Bend", "admin1Code": "OR", "countryCode": "US", "formatted": {"long": "Bend, OR"}},
    "compensation": {"baseSalary": {"unitOfWork": "YEAR", "range": {"min": 1000.9, "max": None}}, "currencyCode": "EUR"},
    "attributes": [{"key": "k", "label": "Full-time"}, {"key": "x", "label": "Other"}],
    "employer": {"name": "Harbour Ltd"},
    "datePublished": 1711929600000,
}


def test_indeed(spark):
    (r,) = rows_of(spark, payload("indeed", indeed_body(INDEED)))
    assert (r.source, r.source_id, r.url) == ("indeed", "q81", "https://www.indeed.com/viewjob?jk=q81")
    assert (r.title, r.company, r.description) == ("Lamp Keeper", "Harbour Ltd", "Mind the lamp")
    assert (r.city, r.state, r.country, r.is_remote) == ("Bend", "OR", "US", False)
    assert (r.comp_min, r.comp_max, r.comp_currency, r.comp_interval) == (1000.0, None, "EUR", "yearly")
    assert (r.job_type, r.date_posted, r.has_cursor) == (["full_time"], date(2024, 4, 1), False)


def test_indeed_edges(spark):
    bare = {"key": "b", "title": "WFH clerk", "employer": {}, "location": {"countryCode": None}}
    odd = {**INDEED, "key": "c", "compensation": {"baseSalary": {"unitOfWork": "EON", "range": {"min": 1}}}}
    est = {**INDEED, "key": "d", "compensation": {"estimated": {"baseSalary": {"unitOfWork": "HOUR", "range": {"max": 9.9}}, "currencyCode": "EUR"}}}
    r = rows_of(spark, payload("indeed", indeed_body(bare, odd, est, wrap=False, cursor="n"), status=201))
    assert [x.source_id for x in r] == ["b", "c", "d"]
    assert (r[0].company, r[0].country, r[0].is_remote, r[0].description) == ("Unknown", None, True, "")
    assert (r[1].comp_min, r[1].comp_interval) == (None, None)
    assert (r[2].comp_max, r[2].comp_currency, r[2].comp_interval) == (9.0, "USD", "hourly")
    assert all(x.has_cursor for x in r)


def test_one_odd_item_spoils_no_other(spark):
    odd = [{"key": "x", "title": ["a"], "datePublished": "soon", "compensation": 7, "employer": "E"}, {"key": {"k": 1}, "attributes": "none"}, None, 5, "text"]
    body = indeed_body(INDEED, wrap=False)
    body["data"]["jobSearch"]["results"] = [{"job": INDEED}, *odd, {"job": {**INDEED, "key": "last"}}]
    r = {x.source_id: x for x in rows_of(spark, payload("indeed", body))}
    for key in ("q81", "last"):
        assert (r[key].title, r[key].company, r[key].description, r[key].comp_min) == ("Lamp Keeper", "Harbour Ltd", "Mind the lamp", 1000.0)
    assert r["x"].date_posted is None and r["x"].comp_min is None


GLASSDOOR = {
    "header": {
        "jobLink": "/job/88", "jobTitleText": "Map Maker", "employerNameFromSearch": "Atlas Inc", "ageInDays": 2,
        "payPercentile10": 61000, "payPercentile90": 93500, "payCurrency": "USD", "payPeriod": "ANNUAL",
    },
    "job": {"listingId": "g-4711", "description": "<i>Old</i> maps"},
    "overview": {"name": "Atlas Inc"}, "locationName": "Salem, OR", "remoteWorkTypes": [],
}


def glassdoor_body(*views):
    return {"data": {"jobListings": {"jobListings": [{"jobview": v} for v in views]}}}


def test_glassdoor(spark):
    other = {
        "header": {"jobTitleText": "X", "payPercentile10": 0, "payPercentile90": 5, "payPeriod": "EON"},
        "job": {"listingId": 77}, "overview": {"name": "Over"}, "locationName": "Remote", "remoteWorkTypes": ["W"],
    }
    empty = {"job": {"listingId": ""}}
    r = rows_of(
        spark,
        payload("glassdoor", [glassdoor_body(GLASSDOOR)], 1),
        payload("glassdoor", glassdoor_body(other, empty), 2),
    )
    assert len(r) == 2
    assert (r[0].source_id, r[0].url, r[0].title) == ("g-4711", "https://www.glassdoor.com/job/88", "Map Maker")
    assert (r[0].city, r[0].state, r[0].country, r[0].is_remote) == ("Salem", "OR", "US", False)
    assert (r[0].comp_min, r[0].comp_max, r[0].comp_interval) == (61000.0, 93500.0, "yearly")
    assert (r[0].date_posted, r[0].description) == (date(2024, 1, 29), "Old maps")
    assert (r[1].source_id, r[1].company, r[1].url) == ("77", "Over", "https://www.glassdoor.com/job-listing/77")
    assert (r[1].comp_min, r[1].comp_max, r[1].comp_interval, r[1].is_remote) == (None, 5.0, "yearly", True)
    assert (r[1].city, r[1].country) == ("Remote", "US")


def test_ziprecruiter(spark):
    a = {
        "id": "zz-17", "name": "Tile Setter", "url": "https://zip/j/1", "hiring_company": {"name": "Mosaic"},
        "job_city": "Austin", "job_state": "TX", "job_country": "US", "snippet": "<b>Grout</b> expert wanted",
        "posted_time_friendly": "2 days ago", "salary_min_annual": 47000, "salary_max_annual": 71000,
    }
    b = {"id": 5, "name": "Y", "salary_min": 20, "salary_source": "Hourly pay", "posted_time": "2024-01-02T03:04:05Z", "job_country": None}
    c = {"id": "", "name": "skip"}
    r = rows_of(spark, payload("ziprecruiter", {"jobs": [a, b, c], "continue_from": "z"}))
    assert [x.source_id for x in r] == ["zz-17", "5"]
    assert (r[0].city, r[0].state, r[0].country, r[0].description) == ("Austin", "TX", "US", "Grout expert wanted")
    assert (r[0].comp_min, r[0].comp_max, r[0].comp_interval) == (47000.0, 71000.0, "yearly")
    assert (r[0].date_posted, r[1].date_posted) == (date(2024, 1, 29), date(2024, 1, 2))
    assert (r[1].company, r[1].country, r[1].comp_min, r[1].comp_interval) == ("Unknown", None, 20.0, "hourly")


LINKEDIN = """
<html><div class="base-search-card">
 <a class="base-card__full-link" href="https://linkedin.com/jobs/view/bridge-60417?refId=abc">Link</a>
 <span class="sr-only"> Bridge Painter </span>
 <h4 class="base-search-card__subtitle"><a>Span Works</a></h4>
 <div class="base-search-card__metadata">
  <span class="job-search-card__location">Reno, NV</span>
  <time class="job-search-card__listdate" datetime="2026-05-12"></time></div>
 <span class="job-search-card__salary-info">$41,000.00 - <b>$57,500.00</b></span>
</div><div class="base-search-card"><a class="base-card__full-link">no link</a></div>
<div class="base-search-card"><a class="base-card__full-link" href="/v/x-9"></a></div></html>
"""


def test_linkedin(spark):
    r = rows_of(spark, payload("linkedin", LINKEDIN))
    assert [x.source_id for x in r] == ["60417", "9"]
    assert (r[0].title, r[0].company, r[0].city, r[0].state) == ("Bridge Painter", "Span Works", "Reno", "NV")
    assert (r[0].date_posted, r[0].comp_min, r[0].comp_max, r[0].comp_interval) == (date(2026, 5, 12), 41000.0, 57500.0, None)
    assert (r[1].title, r[1].company, r[1].city, r[1].country) == ("N/A", "N/A", None, "US")
    assert r[0].raw_count == 3


def test_linkedin_descriptions(spark):
    df = extract(spark.createDataFrame([payload("linkedin", LINKEDIN)], PAYLOADS), NOW).where("seen_key is not null")
    details = spark.createDataFrame(
        [
            ("60417", 200, "u", "<div class='show-more-less-html__markup x'>Fully <b>remote</b> &amp; fun<script>no</script></div>"),
            ("9", 200, "https://linkedin.com/signup", "<div class='show-more-less-html__markup'>No</div>"),
        ],
        "source_id string, status_code int, url string, body string",
    )
    r = {x.source_id: x for x in cards.enrich_descriptions(df, details).collect()}
    assert (r["60417"].description, r["60417"].is_remote) == ("Fully remote & fun", True)
    assert (r["9"].description, r["9"].is_remote) == ("", False)


def test_bayt(spark):
    body = """<html><body>
    <li data-js-job="1" data-job-id="by-31"><h2><a href="/en/job/by-31">Crane Operator</a></h2>
     <b class="company-name">Tall Hooks</b><span class="location-text">Aden, Yemen</span>
     <span class="date-posted">6 days ago</span></li>
    <li data-js-job="2"><h2></h2></li></body></html>"""
    other = """<div class="row has-pointer-d"><a class="job-title" href="http://b/en/uae/job-55/">Cook</a>
     <span class="time">5 hours ago</span></div>"""
    r = rows_of(spark, payload("bayt", body, 1), payload("bayt", other, 2))
    assert [x.source_id for x in r] == ["by-31", "55"]
    assert (r[0].title, r[0].company, r[0].url) == ("Crane Operator", "Tall Hooks", "https://www.bayt.com/en/job/by-31")
    assert (r[0].city, r[0].state, r[0].country, r[0].date_posted) == ("Aden", None, "Yemen", date(2024, 1, 25))
    assert (r[1].title, r[1].company, r[1].url, r[1].date_posted) == ("Cook", "Unknown", "http://b/en/uae/job-55/", date(2024, 1, 31))


def google_job(url, ident=None, place="Austin, TX, USA", age="3 days ago"):
    job = [None] * 29 + [["end"]]
    job[0], job[1], job[2], job[3] = "Dev", "Goo", place, [[url]] if url else []
    job[12], job[19], job[28] = age, "A full time job", ident
    return job


def test_google(spark):
    good, no_place = json.dumps(google_job("http://a", "id1")), json.dumps(google_job("http://b", None, "Austin", None))
    tail = "}]]]]]"
    first = f'<div data-async-fc="CUR"></div>x "520084652":{good} {tail} y "520084652":{no_place}{tail} "520084652":[oops]]{tail}'
    inner = json.dumps([[[{"other": [], "520084652": []}, {"deep": {"520084652": google_job("http://c", "id3")}}]]])
    second = ")]}'" + json.dumps([[["k", inner], ["k", [[["raw"]]]], ["short"]]]) + " end"
    r = rows_of(spark, payload("google", first, 1, 1), payload("google", second, 1, 2), payload("google", "", 2, 1))
    assert [(x.page_no, x.source_id, x.url) for x in r] == [
        (1, "id1", "http://a"), (1, "http://b", "http://b"), (2, "id3", "http://c"),
    ]
    assert (r[0].city, r[0].state, r[0].country, r[0].date_posted) == ("Austin", "TX", "USA", date(2024, 1, 28))
    assert (r[1].city, r[1].state, r[1].country, r[1].date_posted) == (None, None, None, None)
    assert (r[0].job_type, r[0].has_cursor, r[2].has_cursor) == (["full_time"], True, False)


def test_page_parsers_take_plain_rows(spark):
    """Arrow batches hold ten thousand rows, here whole pages; plain rows come a hundred at a time."""
    bodies = spark.range(1).select(F.lit("<p></p>").alias("body"))
    for parse in (cards.linkedin_cards, cards.bayt_cards, cards.detail_text, positional._posting_in):
        plan = bodies.select(parse("body"))._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "Arrow" not in plan


def test_find_by_key(one):
    text = json.dumps({"a": {"520084652": []}, "b": [{"520084652": "no"}, {"520084652": [1, 2]}], "520084652": [3]})
    assert json.loads(one(positional.find_by_key(F.col("t")), t=("string", text))) == [1, 2]
    assert one(positional.find_by_key(F.col("t")), t=("string", "{bad")) is None


@pytest.mark.parametrize("site", ["linkedin", "indeed", "google", "glassdoor", "ziprecruiter", "bayt"])
def test_nothing_found(spark, site):
    bodies = ["", "<html></html>", "{}", "[]", "null", None, "{broken"]
    assert rows_of(spark, *[payload(site, b, i) for i, b in enumerate(bodies)]) == []
    good = {"indeed": indeed_body(INDEED), "linkedin": LINKEDIN}.get(site, "")
    assert rows_of(spark, payload(site, good, status=404)) == []


def test_registry(spark):
    with pytest.raises(ValueError, match="unknown site"):
        extractor("fakeboard")
    register_extractor("plug", lambda p, as_of: extractor("indeed")(p, as_of))
    try:
        (r,) = rows_of(spark, payload("plug", indeed_body(INDEED)))
        assert r.source == "plug"
    finally:
        from postlark.sources import payloads

        payloads._EXTRACTORS.pop("plug")


def test_payload_files(spark, tmp_path):
    df = spark.createDataFrame([payload("indeed", indeed_body(INDEED))], PAYLOADS)
    df.write.json(str(tmp_path / "in"))
    assert read_payloads(spark, str(tmp_path / "in")).collect() == df.collect()


def jobs(*keys):
    return [{**INDEED, "key": k} for k in keys]


def test_run_rows(spark):
    p = [
        # a repeats on page 2, page 3 has only repeats: pages 1 and 2 count
        payload("indeed", indeed_body(*jobs("a", "b", "a"), cursor="x"), 1, 1),
        payload("indeed", indeed_body(*jobs("b", "c"), cursor="x"), 1, 2),
        payload("indeed", indeed_body(*jobs("a", "c"), cursor="x"), 1, 3),
        payload("indeed", indeed_body(*jobs("z"), cursor="x"), 1, 4),
        # no cursor after page 1
        payload("indeed", indeed_body(*jobs("a")), 2, 1),
        payload("indeed", indeed_body(*jobs("b")), 2, 2),
        # page 2 failed, page 3 is not reached
        payload("glassdoor", glassdoor_body({**GLASSDOOR, "job": {"listingId": "1"}}), 3, 1),
        payload("glassdoor", "", 3, 2, 500),
        payload("glassdoor", glassdoor_body({**GLASSDOOR, "job": {"listingId": "2"}}), 3, 3),
        # page cap
        *[payload("glassdoor", glassdoor_body({**GLASSDOOR, "job": {"listingId": str(i)}}), 4, i) for i in (1, 2, 3, 4)],
        # row cap
        payload("indeed", indeed_body(*jobs(*[f"k{i}" for i in range(40)])), 5, 1),
        # uncapped without a cursor
        payload("google", "".join(f'"520084652":{json.dumps(google_job(f"http://{i}"))}' + "}]]]]] " for i in range(30)), 6, 1),
    ]
    found = extract(spark.createDataFrame(p, PAYLOADS), NOW)
    whole = {}
    for r in run_rows(found).collect():
        whole.setdefault(r.run_id, set()).add(r.source_id)
    # Unless limits are asked for, every landed posting counts.
    assert whole[1] == {"a", "b", "c", "z"} and whole[2] == {"a", "b"} and whole[3] == {"1", "2"}
    assert len(whole[4]) == 4 and len(whole[5]) == 40 and len(whole[6]) == 30
    df = run_rows(found, 3, 25)
    got = {}
    for r in df.orderBy("run_id", "page_no", "pos").collect():
        got.setdefault(r.run_id, []).append(r.source_id)
    assert got[1] == ["a", "b", "c"]
    assert got[2] == ["a"]
    assert got[3] == ["1"]
    assert got[4] == ["1", "2", "3"]
    assert got[5] == [f"k{i}" for i in range(25)]
    assert len(got[6]) == 30


def test_offset_pages(spark):
    # Pages of ten cards: offsets 0, 10, ... 70 are below 75, so eight pages count; run 2 stops at its gap.
    rows = [(1, "linkedin", p, 10, 0 if p == 2 else 10, True) for p in range(1, 12)]
    rows += [(2, "linkedin", p, 10, 10, True) for p in (1, 2, 4)]
    df = spark.createDataFrame(rows, "run_id bigint, source string, page_no int, raw_count int, kept_rows bigint, has_cursor boolean")
    got = [(r.run_id, r.page_no) for r in page_prefix(df, 3).orderBy("run_id", "page_no").collect()]
    assert got == [(1, p) for p in range(1, 9)] + [(2, 1), (2, 2)]


def test_hot_key_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 2 run_id", "cast(id as int) page_no", "0 pos", "'k' seen_key")
    plan = seen_first(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert seen_first(df).count() == 2
    assert cap_per_task(df, 7).count() == 14


def test_tasks(spark):
    def listed(name, *values):
        return spark.createDataFrame(list(enumerate(values)), f"pos int, {name} string")

    df = ingest_tasks(listed("site", "s2", "s1"), listed("term", "t1", "t2"), listed("location", "x", "y"))
    got = [(r.site, r.term, r.location) for r in df.orderBy("position").collect()]
    assert got == [(s, t, p) for s in ("s2", "s1") for t in ("t1", "t2") for p in ("x", "y")]
    plan = df._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "collect_list" not in plan
    assert [r.position for r in df.orderBy("position").collect()] == list(range(8))
    assert ingest_tasks(listed("site"), listed("term", "t"), listed("location", "x")).count() == 0


def test_deep_pages_give_no_posting_and_no_error(spark):
    deep = "<div>" * 30_000 + "</p>" * 10
    nested = "[" * 50_000
    inner = json.dumps([[["k", '[[[{"520084652":' + "[" * 50_000]]])
    card = "<div>" * 5_000 + LINKEDIN
    r = rows_of(
        spark, payload("linkedin", deep, 1), payload("bayt", deep, 2), payload("google", ")]}'" + inner, 3, 2), payload("indeed", nested, 4),
        payload("linkedin", card, 5),
    )
    assert {x.run_id for x in r} == {5} and len(r) == 2


def test_workers_find_the_package_from_any_folder(tmp_path):
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1")
    .config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate())
from postlark.schemas import PAYLOADS
from postlark.sources.payloads import extract
rows = [(1, "linkedin", "t", "l", 1, None, 200, "u", '<div class="base-search-card"><a class="base-card__full-link" href="/v/x-9"></a></div>')]
print("FOUND", [r.source_id for r in extract(spark.createDataFrame(rows, PAYLOADS), "2024-01-31", ["linkedin"]).collect()])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "FOUND ['9']" in done.stdout, done.stderr[-2000:]
