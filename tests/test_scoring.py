from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from postlark.operators.scoring import score, score_profiles, tier_hits
from postlark.profiles import Profile, dimension_tables, profile_diagnostics, profiles_from_tables

AS_OF = date(2026, 1, 31)
PROFILE = Profile(
    "me",
    {"critical": ["welding", "boiler"], "strong": ["riveting", "plumbing"], "moderate": ["copper", "gasket"], "weak": ["ladder"]},
    {"tier1": ["Northgate", "Ironside"], "tier2": ["Tinworks", "Boltline"], "tier3": ["Pipefit"]},
    {"title": [r"(?i)\btrainee\b", r"(?i)\bhelper\b"], "company": ["(?i)agency"], "description": ["(?i)night-? ?shift"]},
    [("pipe fitter", 15), ("boiler", 12), ("senior", 5)],
)
BIG = Profile(
    "big",
    {
        "critical": [f"c{i}x" for i in range(7)], "strong": [f"s{i}x" for i in range(8)],
        "moderate": [f"m{i}x" for i in range(9)], "weak": [f"w{i}x" for i in range(5)],
    },
    {"tier1": ["acme"]}, {}, [("boss", 50), ("lead", -5)],
)


def scored(spark, profile, title="x", company="y", description="", posted=AS_OF):
    df = spark.createDataFrame([(1, title, company, description, posted)], "id bigint, title string, company string, description string, date_posted date")
    r = score(df, profile, AS_OF).first()
    b = r.score_breakdown
    return r.score, (b.keyword, b.company, b.title, b.recency, b.dealbreaker)


def test_worked_example(spark):
    text = "welding boiler riveting plumbing copper gasket ladder"
    assert scored(spark, PROFILE, "Senior Pipe Fitter", "Northgate", text) == (60, (20, 15, 15, 10, None))


def test_caps(spark):
    text = " ".join(w for words in BIG.keywords.values() for w in words)
    assert scored(spark, BIG, "The Boss", "ACME Inc", text) == (100, (55, 15, 20, 10, None))


@pytest.mark.parametrize(
    "text, points",
    [
        ("", 0),
        ("riveting plumbing", 0),  # strong words need a critical one
        ("copper gasket ladder", 5),
        ("welding", 5),
        ("welding copper", 6),  # one and a half, cut off
        ("welding copper gasket", 8),
        ("WELDINGS gasketed", 6),
    ],
)
def test_keywords(spark, text, points):
    assert scored(spark, PROFILE, description=text)[1][0] == points


def test_keyword_gate(spark):
    gated = Profile("g", {"moderate": [f"m{i}" for i in range(8)], "weak": ["w"]})
    assert scored(spark, gated, description="m0 m1 m2 m3 m4 m5 w")[1][0] == 10
    twice = Profile("t", {"critical": ["a", "a"]})
    assert scored(spark, twice, description="a")[1][0] == 10


@pytest.mark.parametrize("company, points", [("Ironside Forge", 15), ("tinworks", 10), ("Pipefit", 6), ("Nobody", 0), ("Pipefit at Northgate", 15)])
def test_companies(spark, company, points):
    assert scored(spark, PROFILE, company=company)[1][1] == points


@pytest.mark.parametrize(
    "age, points", [(None, 3), (-3, 10), (0, 10), (1, 10), (2, 8), (3, 8), (4, 5), (7, 5), (8, 3), (14, 3), (15, 1)]
)
def test_recency(spark, age, points):
    posted = None if age is None else AS_OF - timedelta(days=age)
    assert scored(spark, PROFILE, posted=posted)[1][3] == points


@pytest.mark.parametrize(
    "where",
    [{"title": "Dev Trainee"}, {"title": "HELPER dev"}, {"company": "Best Agency"}, {"description": "Only NightShift"}],
)
def test_dealbreakers(spark, where):
    assert scored(spark, PROFILE, **where) == (0, (None, None, None, None, True))


def test_no_dealbreaker_inside_words(spark):
    assert scored(spark, PROFILE, title="Traineeship office")[1][4] is None


def test_bad_pattern_is_named(spark):
    with pytest.raises(ValueError, match="dealbreakers.title"):
        Profile("x", dealbreakers={"title": ["(?P<a>trainee)"]})  # another engine's spelling
    Profile("x", dealbreakers={"title": [r"\p{Lu}++(?<a>x)"]})
    with pytest.raises(ValueError, match=r"dealbreakers.title: \(bad"):
        Profile("x", dealbreakers={"title": ["(bad"]})


def test_long_lists_count_the_same(spark):
    words = [f"w{i}x" for i in range(200)]
    df = spark.createDataFrame([("w3x w7x w199x",)], "t string")
    assert df.select(tier_hits(F.col("t"), words).alias("n")).first().n == 3


def test_many_profiles_equal_single_ones(spark):
    rows = [(i, t, c, d, AS_OF) for i, (t, c, d) in enumerate([("Boiler", "Northgate", "welding copper"), ("Boss", "acme", "c1x m1x"), ("x trainee", "y", "")])]
    df = spark.createDataFrame(rows, "id bigint, title string, company string, description string, date_posted date")
    profiles = [Profile(f"{p.name}{i}", p.keywords, p.companies, p.dealbreakers, p.title_signals) for i in range(5) for p in (PROFILE, BIG)]
    many = {(r.profile, r.id): (r.score, r.score_breakdown) for r in score_profiles(df, profiles, AS_OF).collect()}
    assert len(many) == 30
    for p in profiles[:2]:
        for r in score(df, p, AS_OF).collect():
            assert many[(p.name, r.id)] == (r.score, r.score_breakdown)
    df2 = score_profiles(df, profiles_from_tables(dimension_tables(spark, profiles)), AS_OF)
    assert {(r.profile, r.id): (r.score, r.score_breakdown) for r in df2.collect()} == many


def test_many_profiles_are_one_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select(
        F.col("doc_id").alias("id"), F.lit("t").alias("title"), F.lit("c").alias("company"), F.col("text").alias("description"), F.lit(AS_OF).alias("date_posted")
    )
    plan = score_profiles(df, [Profile(f"p{i}", {"critical": [f"k{i}"]}) for i in range(20)], AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_diagnostics(spark):
    profiles = [
        PROFILE,
        Profile("strong", {"strong": ["a"]}, min_alert_score=55),
        Profile("gated", {"weak": ["a"]}, title_signals=[("a", 1)], min_alert_score=5, min_display_score=20),
        Profile("none"),
    ]
    got = {r.profile: r for r in profile_diagnostics(dimension_tables(spark, profiles)).collect()}
    assert got["me"].max_score == 100 and not got["me"].alert_unreachable
    assert got["strong"].max_score == 10 and got["strong"].strong_ignored and got["strong"].alert_unreachable
    assert got["gated"].max_score == 40 and got["gated"].keyword_score_capped and got["gated"].alert_below_display
    assert got["none"].no_keywords and not got["none"].strong_ignored
