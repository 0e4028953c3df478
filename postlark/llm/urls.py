"""URL filters by host-suffix and path-prefix expressions.

Every URL is expanded into the expressions a rule could have written: each suffix of its host (at label borders) with
each prefix of its path. Expressions meet the rules in an equi-join on a short prefix of their SHA-256; the full digest
and the texts confirm a match, and the longest rule decides. No rule can match beyond its own length, so suffixes stop at
the rules' label count and prefixes at their path length; both are read from the rules and drop no match.

URLs that agree on the host and on that much of the path get the same verdict, so these pairs are judged once, however
many URLs share them, and joined back. All of it is DataFrame code.

Cases: a null URL, or one without ``://``, has an empty host and path; empty rule tables leave the default verdict; a null
rule path is empty; rules without host or verdict are ignored; of rules of equal length the longer host wins, then block
over allow; rows are kept one for one, repeated ones too; columns of the input that clash with ``host``, ``path``,
``rule`` or ``verdict`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SHORT = 8  # hex digits of the joined prefix
DEFAULT = "allow"


def ascii_lower(column):
    return F.translate(column, UPPER, UPPER.lower())


def with_host_and_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Add ``host`` and ``path`` of a URL; others of these names are replaced."""
    at = F.locate("://", F.col(url_col))
    rest = F.when(at > 0, F.expr(f"substring(`{url_col}`, locate('://', `{url_col}`) + 3)")).otherwise("")
    return pages.withColumns(
        {
            "host": ascii_lower(F.regexp_extract(F.coalesce(rest, F.lit("")), r"\A[^/?#]*", 0)),
            "path": F.regexp_extract(F.coalesce(rest, F.lit("")), r"\A[^/?#]*([^?#]*)", 1),
        }
    )


def _hashed(expressions: DataFrame) -> DataFrame:
    digest = F.sha2(F.concat("host", F.lit("\n"), "path"), 256)
    return expressions.withColumn("digest", digest).withColumn("short", F.substring("digest", 1, SHORT))


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """Add host, path, the deciding rule (null if none fits) and the verdict to every page."""
    known = (
        rules.where("host is not null and verdict is not null")
        .select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .distinct()
    )
    bounds = known.agg(
        F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(1)).alias("labels"),
        F.coalesce(F.max(F.length("path")), F.lit(0)).alias("chars"),
    ).first()
    parsed = with_host_and_path(pages.drop("rule", "verdict"), url_col)
    cut = F.substring(F.col("path"), 1, bounds.chars) if bounds.chars else F.lit("")
    judged = parsed.select(F.col("host").alias("_host_cut"), cut.alias("_path_cut")).distinct()

    labels = F.split("_host_cut", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(bounds.labels))), lambda n: F.array_join(F.slice(labels, -n, n), ".")
    )
    prefixes = F.transform(F.sequence(F.lit(0), F.length("_path_cut")), lambda n: F.substring(F.col("_path_cut"), F.lit(1), n))
    expressions = (
        judged.withColumn("host", F.explode(suffixes)).withColumn("path", F.explode(prefixes)).select("_host_cut", "_path_cut", "host", "path")
    )
    found = (
        _hashed(expressions).alias("u").join(_hashed(known).alias("r"), "short")
        .where("u.digest = r.digest and u.host = r.host and u.path = r.path")
        .select("_host_cut", "_path_cut", "r.host", "r.path", "r.verdict")
    )
    order = F.struct(
        (F.length("host") + F.length("path")).alias("size"),
        F.length("host").alias("host_size"),
        (F.col("verdict") == "block").alias("blocks"),
        F.concat("host", "path").alias("rule"),
        "verdict",
    )
    verdicts = found.groupBy("_host_cut", "_path_cut").agg(F.max(order).alias("_best"))
    return (
        parsed.withColumn("_path_cut", cut)
        .join(verdicts.withColumnRenamed("_host_cut", "host"), ["host", "_path_cut"], "left")
        .select(
            *parsed.columns,
            F.col("_best.rule").alias("rule"),
            F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
        )
    )
