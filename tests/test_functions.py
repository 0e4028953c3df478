from datetime import date

import pytest
from pyspark.sql import functions as F

from postlark.functions import dates, keys, location, pay, text


def col(value, kind="string"):
    return F.lit(value).cast(kind)


@pytest.mark.parametrize(
    "given, expected",
    [
        ("70250", 70250.0), ("$48,300", 48300.0), ("$19.75", 19.75), ("2.400,25", 2400.25), ("-630", -630.0),
        ("no digits", None), ("", None), ("1,5", 1.5), ("$9,876,543.21", 9876543.21),
    ],
)
def test_currency(one, given, expected):
    assert one(pay.currency_parser(col(given))) == expected


@pytest.mark.parametrize(
    "given, expected",
    [
        ("$38,000 - $52,500", ("USD", 38000.0, 52500.0)),
        ("$31.40 - $44.95", ("USD", 31.0, 44.0)),
        ("$38,000", None),
        ("$38 - lots", None),
        ("10 - 20 - 30", ("USD", 10.0, 20.0)),
    ],
)
def test_salary_range(one, given, expected):
    r = one(pay.salary_range(col(given)))
    assert (r and (r.currency, r["min"], r["max"])) == expected


@pytest.mark.parametrize(
    "low, high, interval, expected",
    [
        (38000, 52500, "yearly", "$38,000 - $52,500 /yearly"),
        (38000, 38000, None, "$38,000"),
        (0, 5, "hourly", ""),
        (None, 5, "hourly", ""),
        (2.5, None, "hourly", "$2 /hourly"),
        (3.5, 0, None, "$4"),
    ],
)
def test_comp_display(one, low, high, interval, expected):
    assert one(pay.comp_display(col(low, "double"), col(high, "double"), col(interval))) == expected


@pytest.mark.parametrize(
    "low, high, expected",
    [(64000, 92000, "$64k-$92k"), (500, 1500, "$500-$1500"), (1500, 900, "$2k-$1k"), (2500, None, "$2k"), (None, 1, "")],
)
def test_comp_concise(one, low, high, expected):
    assert one(pay.comp_display_concise(col(low, "double"), col(high, "double"))) == expected


def test_interval(one):
    assert one(pay.parse_compensation_interval(col("hour"))) == "hourly"
    assert one(pay.parse_compensation_interval(col("fortnight"))) is None


@pytest.mark.parametrize(
    "html, expected",
    [
        (None, ""),
        ("<p>Great <b>job</b></p>", "Great job"),
        ("<script>if (a < b) '</p>'</script>x<!-- <b>no</b> -->y<style>p{}</style>", "x y"),
        ("a &amp; b &lt;c&gt; &quot;q&quot; &copy;", 'a & b <c> "q" ©'),
        ("caf&eacute; &#8364;5 &#x41;", "café €5 A"),
        ("5 < 6 and 7 > 2", "5 < 6 and 7 > 2"),
        ("a  b", "a b"),
        ("&amp;lt;", "&lt;"),
    ],
)
def test_html_to_text(one, html, expected):
    assert one(text.html_to_text(F.col("h")), h=("string", html)) == expected


def test_emails(one):
    assert one(text.extract_emails(col("a@b.co, x c.d+e@f.org a@b.co"))) == ["a@b.co", "c.d+e@f.org", "a@b.co"]
    assert one(text.extract_emails(col(None))) == []


def test_job_types(one):
    assert one(text.extract_job_types(col("Contract, FULL TIME, parttime"))) == ["full_time", "part_time", "contract"]
    assert one(text.extract_job_types(col(None))) == []
    labels = F.array(F.lit("Full-time"), F.lit("Remote"), F.lit("part time"), F.lit("Temporary"))
    assert one(text.label_job_types(labels)) == ["full_time", "part_time", "temporary"]


def test_remote(one):
    assert one(text.is_remote(col("Engineer"), col("Work From Home ok")))
    assert one(text.is_remote(col("x"), col(None), col("Remotely")))
    assert not one(text.is_remote(col("x"), col("y"), col("z")))


@pytest.mark.parametrize(
    "channel, expected",
    [
        ("telegram", r"a\_b\*c\[d\]\(e\)\~\`\>\#\+\-\=\|\{\}\.\!&<\ "),
        ("discord", r"a\_b\*c[d](e)\~\`>#+-=\|{}.!&<\\ "),
        ("slack", "a_b*c[d](e)~`&gt;#+-=|{}.!&amp;&lt;\\ "),
        ("macos", "a_b*c[d](e)~`>#+-=|{}.!&<\\\\ "),
        ("email", "a_b*c[d](e)~`>#+-=|{}.!&<\\ "),
    ],
)
def test_escape(one, channel, expected):
    assert one(text.escape(F.col("s"), channel), s=("string", "a_b*c[d](e)~`>#+-=|{}.!&<\\ ")) == expected


@pytest.mark.parametrize("given, expected", [("config", "default"), ("My Job!", "my-job"), ("--", "default"), ("a_b", "a_b")])
def test_profile_name(one, given, expected):
    assert one(text.profile_name(col(given))) == expected


LOCATIONS = [
    # city, state, country, remote -> city, state, country
    (("United States", None, "US", False), (None, None, "US")),
    (("California", "United States", "US", False), (None, "CA", "US")),
    (("Detroit", "United States", "US", False), ("Detroit", None, "US")),
    (("Los Angeles", "California", "US", False), ("Los Angeles", "CA", "US")),
    (("Remote", None, "US", True), (None, None, "US")),
    (("Remote", None, "US", False), ("Remote", None, "US")),
    (("Remote", "United States", "US", True), (None, None, "US")),
    (("Georgia", "United States", "US", False), (None, "GA", "US")),
    (("Georgia", None, "US", False), (None, None, "GE")),
    (("Atlanta", "Georgia", "US", False), ("Atlanta", "GA", "US")),
    (("  ", " ca ", " ", False), (None, "CA", None)),
    (("Houston", "Texas Metropolitan Area", "usa", False), ("Houston", "TX", "US")),
    (("Austin", "TEXAS METRO AREA", "United Kingdom", False), ("Austin", "TX", "GB")),
    (("X", "Nowhere Metro Area", "Atlantis", False), ("X", "Nowhere Metro Area", "Atlantis")),
    (("London", None, "gb", False), ("London", None, "GB")),
    (("Toronto", "Ontario", "canada", False), ("Toronto", "Ontario", "CA")),
    ((None, None, None, False), (None, None, None)),
    (("Dubai", "UAE", None, False), ("Dubai", None, "AE")),
]


def test_locations(spark):
    rows = [(i, *given) for i, (given, _) in enumerate(LOCATIONS)]
    df = spark.createDataFrame(rows, "i int, city string, state string, country string, is_remote boolean")
    got = {r.i: (r.city, r.state, r.country) for r in location.normalise_location(df).collect()}
    assert got == {i: expected for i, (_, expected) in enumerate(LOCATIONS)}
    again = location.normalise_location(location.normalise_location(df))
    assert {r.i: (r.city, r.state, r.country) for r in again.collect()} == got


@pytest.mark.parametrize(
    "city, state, remote, expected",
    [("A", "CA", True, "A, CA, (Remote)"), (None, None, False, "Unknown"), (None, None, True, "(Remote)"), ("A", None, False, "A")],
)
def test_location_display(one, city, state, remote, expected):
    assert one(location.location_display(col(city), col(state), F.lit(remote))) == expected


def test_alert_states(one):
    given = F.array(F.lit(" california "), F.lit("tx"), F.lit(" Ontario"))
    assert one(location.alert_states(given)) == ["CA", "TX", "Ontario"]


@pytest.mark.parametrize(
    "site, given, expected",
    [
        ("linkedin", "Paris", ("Paris", None, "US")),
        ("linkedin", "A, B", ("A", "B", "US")),
        ("linkedin", "A, B, C, D", ("A", "B", "C")),
        ("glassdoor", "Boston, MA", ("Boston", "MA", "US")),
        ("glassdoor", "", (None, None, "US")),
        ("google", "Boston", (None, None, None)),
        ("google", "A, B", ("A", "B", None)),
        ("bayt", "Dubai, X, UAE", ("Dubai", None, "UAE")),
        ("bayt", "Dubai", ("Dubai", None, None)),
    ],
)
def test_split_location(one, site, given, expected):
    r = one(location.split_location(F.col("t"), site), t=("string", given))
    assert (r.city, r.state, r.country) == expected


DAY = date(2024, 1, 31)


def test_dates(one):
    as_of = F.lit(DAY)
    assert one(dates.iso_date(col("2026-04-01"))) == date(2026, 4, 1)
    assert one(dates.iso_date(col("2026-13-01"))) is None
    assert one(dates.iso_date(col("soon"))) is None
    assert one(dates.epoch_millis_date(col("1711929600000", "bigint"))) == date(2024, 4, 1)
    assert one(dates.epoch_millis_date(col("0", "bigint"))) is None
    assert one(dates.first_number_age(col("3 days ago"), as_of, False)) == date(2024, 1, 28)
    assert one(dates.first_number_age(col("3 hours ago"), as_of, False)) == date(2024, 1, 28)
    assert one(dates.first_number_age(col("3 Hours ago"), as_of, True)) == DAY
    assert one(dates.first_number_age(col("today"), as_of, True)) is None
    assert one(dates.timestamp_or_age(col("2026-04-01T23:59:00Z"), col("2 days ago"), as_of)) == date(2026, 4, 1)
    assert one(dates.timestamp_or_age(col("bad"), col("2 days ago"), as_of)) == date(2024, 1, 29)
    assert one(dates.timestamp_or_age(col(None), col("a day ago"), as_of)) == DAY
    assert one(dates.timestamp_or_age(col(None), col("2 weeks ago"), as_of)) is None
    assert one(dates.age_label(F.lit(date(2024, 1, 26)), as_of)) == "5d"
    assert one(dates.age_label(F.lit(DAY), as_of)) == "today"
    assert one(dates.age_label(col(None, "date"), as_of)) == "?"


def key(title="T", company="C", city="X", state="CA", day=None, description="d", prefix=None):
    return keys.content_key(col(title), col(company), col(city), col(state), col(day, "date"), col(description), prefix)


def test_keys(one):
    import hashlib

    assert one(keys.dedup_key(col("indeed"), col("1"))) == hashlib.sha256(b"indeed:1").hexdigest()[:16]
    raw = "a b|c|x|ca|2026-01-15|hello world"
    want = hashlib.sha256(raw.encode()).hexdigest()[:16]
    assert one(key(" A   B", "c ", "x", " CA", "2026-01-15", "Hello\n world ")) == want
    assert one(key(state=None)) == one(key(state=""))
    assert one(key(description="x" * 500 + "a")) != one(key(description="x" * 500 + "b"))
    assert one(key(description="x" * 500 + "a", prefix=500)) == one(key(description="x" * 500 + "b", prefix=500))
    base = one(key())
    for change in ("title", "company", "city", "state", "description"):
        assert one(key(**{change: "other"})) != base
    assert one(key(day="2026-01-15")) != base
