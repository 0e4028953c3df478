"""User profiles: what to look for, how to weigh it, and when to speak up."""

from __future__ import annotations

from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Profiles become literals of a plan, so tables beyond this bound are refused, never cut; callers may raise it.
DIMENSION_ROWS = 100_000

KEYWORD_TIERS = ("critical", "strong", "moderate", "weak")
COMPANY_TIERS = ("tier1", "tier2", "tier3")
BREAKER_FIELDS = ("title", "company", "description")


@dataclass(frozen=True)
class Profile:
    name: str
    keywords: dict[str, list[str]] = field(default_factory=dict)
    companies: dict[str, list[str]] = field(default_factory=dict)
    dealbreakers: dict[str, list[str]] = field(default_factory=dict)
    title_signals: list[tuple[str, int]] = field(default_factory=list)
    min_alert_score: int = 55
    min_display_score: int = 20
    alert_states: list[str] = field(default_factory=list)

    def __post_init__(self):
        check_patterns(self.dealbreakers)


def check_patterns(dealbreakers: dict[str, list[str]]) -> None:
    """Refuse patterns that the engine which runs them can't compile. Before a session starts there is none to ask;
    scoring asks again."""
    context = SparkContext._active_spark_context
    if context is None:
        return
    for where, patterns in dealbreakers.items():
        for pattern in patterns:
            try:
                context._jvm.java.util.regex.Pattern.compile(pattern)
            except (IllegalArgumentException, Py4JJavaError) as e:
                raise ValueError(f"invalid pattern in dealbreakers.{where}: {pattern} ({e})") from e


def dimension_tables(spark: SparkSession, profiles: list[Profile]) -> dict[str, DataFrame]:
    """The profiles as five small tables, keyed by profile."""

    def table(rows, schema):
        return spark.createDataFrame(rows, schema)

    return {
        "keywords": table(
            [
                (p.name, tier, i, k)
                for p in profiles
                for tier in KEYWORD_TIERS
                for i, k in enumerate(p.keywords.get(tier, []))
            ],
            "profile string, tier string, pos int, keyword string",
        ),
        "companies": table(
            [(p.name, tier, c) for p in profiles for tier in COMPANY_TIERS for c in p.companies.get(tier, [])],
            "profile string, tier string, name string",
        ),
        "dealbreakers": table(
            [(p.name, f, x) for p in profiles for f in BREAKER_FIELDS for x in p.dealbreakers.get(f, [])],
            "profile string, field string, pattern string",
        ),
        "title_signals": table(
            [(p.name, s, points) for p in profiles for s, points in p.title_signals],
            "profile string, pattern string, points int",
        ),
        "thresholds": table(
            [(p.name, p.min_alert_score, p.min_display_score, p.alert_states) for p in profiles],
            "profile string, min_alert_score int, min_display_score int, alert_states array<string>",
        ),
    }


def profiles_from_tables(dims: dict[str, DataFrame], max_rows: int = DIMENSION_ROWS) -> list[Profile]:
    """Read profile tables back. They are user settings, so their size is checked before they reach the driver."""

    def rows(name: str):
        found = dims[name].limit(max_rows + 1).collect()
        if len(found) > max_rows:
            raise ValueError(f"profile table {name} has more than {max_rows} rows")
        return found

    out: dict[str, Profile] = {}
    for r in rows("thresholds"):
        out[r.profile] = Profile(
            r.profile, {}, {}, {}, [], r.min_alert_score, r.min_display_score, list(r.alert_states or [])
        )
    for r in sorted(rows("keywords"), key=lambda r: r.pos):
        out[r.profile].keywords.setdefault(r.tier, []).append(r.keyword)
    for r in rows("companies"):
        out[r.profile].companies.setdefault(r.tier, []).append(r.name)
    for r in rows("title_signals"):
        out[r.profile].title_signals.append((r.pattern, r.points))
    breakers: dict[str, dict[str, list[str]]] = {}
    for r in rows("dealbreakers"):
        breakers.setdefault(r.profile, {}).setdefault(r.field, []).append(r.pattern)
    return [
        Profile(
            p.name, p.keywords, p.companies, breakers.get(p.name, {}), p.title_signals,
            p.min_alert_score, p.min_display_score, p.alert_states,
        )
        for _, p in sorted(out.items())
    ]


def profile_diagnostics(dims: dict[str, DataFrame]) -> DataFrame:
    """Per profile: the best reachable score and flags for settings that cannot work as meant."""
    per_tier = dims["keywords"].groupBy("profile").agg(
        *[F.count_if(F.col("tier") == t).cast("int").alias(f"n_{t}") for t in KEYWORD_TIERS]
    )
    companies = dims["companies"].groupBy("profile").agg(F.count("*").cast("int").alias("n_companies"))
    signals = dims["title_signals"].groupBy("profile").agg(F.count("*").cast("int").alias("n_signals"))
    out = dims["thresholds"].join(per_tier, "profile", "left").join(companies, "profile", "left")
    out = out.join(signals, "profile", "left").fillna(0)
    critical, strong = F.col("n_critical"), F.col("n_strong")
    gated = F.col("n_moderate") + F.col("n_weak")
    best = (
        F.lit(10)
        + F.when(critical > 0, 55).when(gated > 0, 10).otherwise(0)
        + F.when(F.col("n_companies") > 0, 15).otherwise(0)
        + F.when(F.col("n_signals") > 0, 20).otherwise(0)
    )
    return out.select(
        "profile",
        best.alias("max_score"),
        (F.col("min_alert_score") > best).alias("alert_unreachable"),
        (F.col("min_alert_score") < F.col("min_display_score")).alias("alert_below_display"),
        (critical + strong + gated == 0).alias("no_keywords"),
        ((critical == 0) & (strong > 0) & (gated == 0)).alias("strong_ignored"),
        ((critical == 0) & (gated > 0)).alias("keyword_score_capped"),
    )
