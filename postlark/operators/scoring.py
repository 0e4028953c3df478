"""Explainable 0-100 scores for postings against profiles, as plain expressions."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlark.functions.lookups import any_of
from postlark.operators import textjoin
from postlark.operators.spread import attach, cut, settled
from postlark.profiles import BREAKER_FIELDS, COMPANY_TIERS, KEYWORD_TIERS, Profile, check_patterns
from postlark.schemas import BREAKDOWN

LONG_LIST = 150
# User patterns see letters of all scripts, and only \n ends a line.
FLAGS = textjoin.FLAGS


def prepared(df: DataFrame) -> DataFrame:
    """Add the lower-cased texts the scores look at, once per posting."""
    title, company = F.coalesce("title", F.lit("")), F.coalesce("company", F.lit(""))
    description = F.coalesce("description", F.lit(""))
    return df.withColumns(
        {
            "_text": F.lower(F.concat(title, F.lit(" "), description)),
            "_title": F.lower(title),
            "_company": F.lower(company),
        }
    )


def dealbreaker(profile: Profile) -> Column:
    """True when any pattern is found; cheap short fields are tried before the description."""
    check_patterns(profile.dealbreakers)
    found = [
        F.coalesce(F.col(name), F.lit("")).rlike(FLAGS + pattern)
        for name in ("title", "company", "description")
        for pattern in profile.dealbreakers.get(name, [])
    ]
    return any_of(found)


def tier_hits(text: Column, words: list[str]) -> Column:
    """How many list entries occur in the text as substrings; a repeated entry counts each time."""
    if len(words) > LONG_LIST:
        listed = F.array(*[F.lit(w.lower()) for w in words])
        return F.size(F.filter(listed, lambda w: F.contains(text, w)))
    hits = F.lit(0)
    for w in words:
        hits = hits + F.contains(text, F.lit(w.lower())).cast("int")
    return hits


def keyword_hits(profile: Profile, text: Column) -> dict[str, Column]:
    return {t: tier_hits(text, profile.keywords.get(t, [])) for t in ("critical", "strong", "moderate", "weak")}


def keyword_points(critical: Column, strong: Column, moderate: Column, weak: Column) -> Column:
    gated = F.least(F.lit(10), moderate * 2 + weak)
    full = (
        F.least(critical * 5, F.lit(25))
        + F.least(strong * 3, F.lit(18))
        + F.least(F.floor(moderate * 1.5).cast("int"), F.lit(9))
        + F.least(weak, F.lit(3))
    )
    return F.when(critical == 0, gated).otherwise(F.least(F.lit(55), full)).cast("int")


def company_points(profile: Profile, company: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for tier, points in (("tier1", 15), ("tier2", 10), ("tier3", 6)):
        names = profile.companies.get(tier, [])
        out = out.when(any_of([F.contains(company, F.lit(n.lower())) for n in names]), F.lit(points))
    return out.otherwise(F.lit(0)).cast("int")


def title_points(profile: Profile, title: Column) -> Column:
    best = F.lit(0)
    for pattern, points in profile.title_signals:
        if points > 0:
            best = F.greatest(best, F.when(F.contains(title, F.lit(pattern.lower())), points).otherwise(0))
    return F.least(F.lit(20), best).cast("int")


def recency_points(date_posted: Column, as_of: Column) -> Column:
    days = F.datediff(as_of, date_posted)
    out = F.when(date_posted.isNull(), 3)
    for limit, points in ((1, 10), (3, 8), (7, 5), (14, 3)):
        out = out.when(days <= limit, points)
    return out.otherwise(1).cast("int")


def as_date(as_of) -> Column:
    """A date column for a date, a datetime or an ISO text."""
    if isinstance(as_of, Column):
        return as_of.cast("date")
    text = as_of.isoformat()[:10] if isinstance(as_of, date) else str(as_of)[:10]
    return F.lit(text).cast("date")


def _with_hits(df: DataFrame, profile: Profile, tag: str) -> DataFrame:
    """Add the dealbreaker flag and the keyword hits as columns, so that each text search runs once."""
    hits = {f"{tag}_{t}": c for t, c in keyword_hits(profile, F.col("_text")).items()}
    return df.withColumns({f"{tag}_broken": dealbreaker(profile), **hits})


def _breakdown(profile: Profile, as_of: Column, tag: str) -> Column:
    """Score parts from the columns of ``_with_hits``; nothing but the flag for a dealbreaker."""
    parts = {
        "keyword": keyword_points(*[F.col(f"{tag}_{t}") for t in ("critical", "strong", "moderate", "weak")]),
        "company": company_points(profile, F.col("_company")),
        "title": title_points(profile, F.col("_title")),
        "recency": recency_points(F.col("date_posted"), as_of),
    }
    broken = F.col(f"{tag}_broken")
    fields = [F.when(~broken, c).alias(n) for n, c in parts.items()]
    return F.struct(*fields, F.when(broken, F.lit(True)).alias("dealbreaker")).cast(BREAKDOWN)


def total(breakdown: str) -> Column:
    parts = [F.coalesce(F.col(f"{breakdown}.{n}"), F.lit(0)) for n in ("keyword", "company", "title", "recency")]
    return F.greatest(F.lit(0), F.least(F.lit(100), parts[0] + parts[1] + parts[2] + parts[3])).cast("int")


def score(df: DataFrame, profile: Profile, as_of) -> DataFrame:
    """Add ``score`` and ``score_breakdown``. A dealbreaker scores 0 and its breakdown holds only that flag."""
    columns = [c for c in df.columns if c not in ("score", "score_breakdown")]
    rows = _with_hits(prepared(df.select(columns)), profile, "_p").withColumn("_b", _breakdown(profile, as_date(as_of), "_p"))
    return settled(rows, {"score": total("_b"), "score_breakdown": F.col("_b")}).select(
        *columns, "score_breakdown", "score"
    )


def _profile_data(profiles: list[Profile]) -> tuple[Column, dict[str, list]]:
    """All profiles as one array of numbers into lists of distinct keywords, companies, title signals and dealbreakers."""
    lists: dict[str, dict] = {"keywords": {}, "companies": {}, "signals": {}, "breakers": {}}
    number = lambda kind, entry: lists[kind].setdefault(entry, len(lists[kind]))
    data = [
        {
            "profile": p.name,
            "tiers": [[number("keywords", w.lower()) for w in p.keywords.get(t, [])] for t in KEYWORD_TIERS],
            "companies": [[number("companies", n.lower()) for n in p.companies.get(t, [])] for t in COMPANY_TIERS],
            "signals": [{"i": number("signals", s.lower()), "points": points} for s, points in p.title_signals if points > 0],
            "breakers": [number("breakers", (f, x)) for f in BREAKER_FIELDS for x in p.dealbreakers.get(f, [])],
        }
        for p in profiles
    ]
    layout = (
        "array<struct<profile:string,tiers:array<array<int>>,companies:array<array<int>>,"
        "signals:array<struct<i:int,points:int>>,breakers:array<int>>>"
    )
    return F.from_json(F.lit(json.dumps(data)), layout), {k: list(v) for k, v in lists.items()}


def _found(text: Column, words: list[str]) -> Column:
    """For each word whether the text contains it."""
    listed = F.array(*[F.lit(w) for w in words]).cast("array<string>")
    return F.transform(listed, lambda w: F.contains(text, w))


def score_profiles(df: DataFrame, profiles: list[Profile], as_of) -> DataFrame:
    """One row per (profile, posting), postings with no keyword hit too.

    The distinct keywords, names and patterns of all profiles are searched once per posting. Profiles are data: an array
    of numbers into these findings, added up per profile and exploded. So any number of profiles is one pass, no join.
    """
    if not profiles:
        raise ValueError("no profiles given")
    for p in profiles:
        check_patterns(p.dealbreakers)
    data, lists = _profile_data(profiles)
    broken = [F.coalesce(F.col(f), F.lit("")).rlike(FLAGS + x) for f, x in lists["breakers"]]
    findings = {
        "_kw": _found(F.col("_text"), lists["keywords"]),
        "_co": _found(F.col("_company"), lists["companies"]),
        "_ti": _found(F.col("_title"), lists["signals"]),
        "_db": F.array(*broken).cast("array<boolean>"),
    }
    rows = settled(prepared(df), findings)
    hit = lambda name: lambda i: F.get(F.col(name), i)
    best = lambda points: F.coalesce(F.array_max(points), F.lit(0))

    def one(p: Column) -> Column:
        hits = [F.size(F.filter(F.get(p["tiers"], F.lit(k)), hit("_kw"))) for k in range(len(KEYWORD_TIERS))]
        tiers = [F.exists(F.get(p["companies"], F.lit(k)), hit("_co")) for k in range(len(COMPANY_TIERS))]
        company = F.when(tiers[0], 15).when(tiers[1], 10).when(tiers[2], 6).otherwise(0)
        signals = F.transform(F.filter(p["signals"], lambda s: F.get(F.col("_ti"), s["i"])), lambda s: s["points"])
        stopped = F.exists(p["breakers"], hit("_db"))
        parts = [keyword_points(*hits), company, F.least(F.lit(20), best(signals)), recency_points(F.col("date_posted"), as_date(as_of))]
        fields = [F.when(~stopped, c.cast("int")).alias(n) for n, c in zip(("keyword", "company", "title", "recency"), parts)]
        breakdown = F.struct(*fields, F.when(stopped, F.lit(True)).alias("dealbreaker")).cast(BREAKDOWN)
        return F.struct(p["profile"].alias("profile"), breakdown.alias("score_breakdown"))

    out = rows.select(*df.columns, F.inline(F.transform(data, one))).withColumn("score", total("score_breakdown"))
    return out.select("profile", *df.columns, "score_breakdown", "score")


def profile_evidence(rows: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """What speaks for or against a posting in a profile: ``(row, profile)`` with hits by tier, best company tier, points and dealbreaker.

    ``rows`` are written, with ``row`` and the texts of ``prepared``; ``dims`` are the profiles as tables of any size. Only
    pairs with some evidence have a row.
    """
    text = lambda column: rows.select("row", F.coalesce(F.col(column), F.lit("")).alias("text"))

    def met(column: str, words: DataFrame) -> DataFrame:
        return textjoin.containing(text(column), words).join(words, "word")

    keywords = met("_text", dims["keywords"].select("profile", "tier", F.lower("keyword").alias("word")))
    names = met("_company", dims["companies"].select("profile", F.col("tier").alias("company"), F.lower("name").alias("word")))
    signals = met("_title", dims["title_signals"].where("points > 0").select("profile", "points", F.lower("pattern").alias("word")))
    parts = [
        keywords.groupBy("row", "profile").agg(*[F.count_if(F.col("tier") == t).cast("int").alias(t) for t in KEYWORD_TIERS]),
        names.groupBy("row", "profile").agg(F.min("company").alias("company")),
        signals.groupBy("row", "profile").agg(F.max("points").alias("points")),
    ]
    for name in BREAKER_FIELDS:
        patterns = dims["dealbreakers"].where(F.col("field") == name).select("profile", "pattern")
        parts.append(textjoin.matching(text(name), patterns).join(patterns, "pattern").select("row", "profile", F.lit(True).alias("broken")).distinct())
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    found = [F.coalesce(F.sum(t), F.lit(0)).cast("int").alias(t) for t in KEYWORD_TIERS]
    return out.groupBy("row", "profile").agg(*found, F.min("company").alias("company"), F.max("points").alias("points"), F.max("broken").alias("broken"))


def score_profile_tables(df: DataFrame, dims: dict[str, DataFrame], as_of) -> DataFrame:
    """``score_profiles`` for profiles held as tables: no list of theirs passes through the driver or a plan.

    Keywords, names, signals and patterns are joined with the texts, so the cost follows what is found. The result is one row for each
    posting and profile, hit or not.
    """
    rows = cut(prepared(df).withColumn("row", F.monotonically_increasing_id()))
    evidence = cut(profile_evidence(rows, dims))
    pairs = rows.select("row", "date_posted").crossJoin(dims["thresholds"].select("profile").distinct())
    rated = pairs.join(evidence, ["row", "profile"], "left")
    broken, company = F.coalesce("broken", F.lit(False)), F.col("company")
    parts = {
        "keyword": keyword_points(*[F.coalesce(F.col(t), F.lit(0)) for t in ("critical", "strong", "moderate", "weak")]),
        "company": F.when(company == "tier1", 15).when(company == "tier2", 10).when(company == "tier3", 6).otherwise(0),
        "title": F.least(F.lit(20), F.coalesce("points", F.lit(0))),
        "recency": recency_points(F.col("date_posted"), as_date(as_of)),
    }
    fields = [F.when(~broken, c.cast("int")).alias(n) for n, c in parts.items()]
    breakdown = F.struct(*fields, F.when(broken, F.lit(True)).alias("dealbreaker")).cast(BREAKDOWN)
    scored = rated.select("row", "profile", breakdown.alias("score_breakdown")).withColumn("score", total("score_breakdown"))
    kept = [c for c in df.columns if c not in ("score", "score_breakdown", "profile", "row")]
    return attach(scored, rows.select("row", *kept), "row").select("profile", *kept, "score_breakdown", "score")
