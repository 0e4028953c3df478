"""Text clean-up, detection and escaping."""

from __future__ import annotations

import html as _html

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from postlark.functions.lookups import any_of
from postlark.shipping import ship

# Unicode white space; the four separators 0x1c-0x1f count as space too.
SPACE = r"[\s\x1c-\x1f]"
SPACE_CHARS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"

# Blocks whose content is not text. One alternation, so whichever block opens first wins.
HIDDEN_BLOCKS = (
    r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>|<!--.*?-->"
)
TAG = r"<[a-zA-Z/!?][^>]*>"

# Entities decoded with plain replaces; '&amp;' has to stay last.
COMMON_ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "),
    ("&middot;", "·"), ("&copy;", "©"), ("&ndash;", "–"), ("&mdash;", "—"), ("&amp;", "&"),
]
RARE_ENTITY = r"&(?!(?:lt|gt|quot|apos|nbsp|middot|copy|ndash|mdash|amp|#39);)(?:#[0-9]|#[xX][0-9a-fA-F]|[a-zA-Z])"


def strip(c: Column) -> Column:
    """Remove leading and trailing Unicode white space (Spark's ``trim`` removes blanks only)."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def squeeze(c: Column) -> Column:
    """Collapse every white-space run to one blank and strip."""
    return F.trim(F.regexp_replace(c, rf"(?U){SPACE}+", " "))


@pandas_udf(StringType())
def _decode_entities(s: pd.Series) -> pd.Series:
    return s.map(_html.unescape, na_action="ignore")


def html_to_text(c: Column, rare_entities: bool = True) -> Column:
    """Visible text of an HTML fragment, one blank between text nodes; null gives ''.

    Native regular expressions do the work. Only texts holding an entity outside the common list travel to an
    Arrow UDF; all others send it a null.
    """
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), HIDDEN_BLOCKS, " "), TAG, " ")
    decoded = bare
    for entity, char in COMMON_ENTITIES:
        decoded = F.replace(decoded, F.lit(entity), F.lit(char))
    if rare_entities:
        if (session := SparkSession.getActiveSession()) is not None:
            ship(session)
        rare = _decode_entities(F.when(bare.rlike(RARE_ENTITY), bare))
        decoded = F.coalesce(rare, decoded)
    return squeeze(decoded)


def extract_emails(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(EMAIL_PATTERN), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


# Label and pattern in reporting order.
JOB_TYPE_PATTERNS = [
    ("full_time", r"full\s?time"),
    ("part_time", r"part\s?time"),
    ("internship", "internship"),
    ("contract", "contract"),
]


def extract_job_types(c: Column) -> Column:
    hits = [F.when(c.rlike("(?iU)" + pattern), F.lit(name)) for name, pattern in JOB_TYPE_PATTERNS]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


# Attribute labels without dashes and blanks.
LABEL_JOB_TYPES = ["fulltime", "parttime", "contract", "internship", "temporary"]


def label_job_types(labels: Column) -> Column:
    """Job types named by an array of attribute labels; other labels are dropped."""
    names = {"fulltime": "full_time", "parttime": "part_time"}

    def one(label: Column) -> Column:
        flat = F.lower(F.regexp_replace(label, "[- ]", ""))
        out = F.when(F.lit(False), F.lit(""))
        for known in LABEL_JOB_TYPES:
            out = out.when(flat == known, F.lit(names.get(known, known)))
        return out

    found = F.filter(F.transform(labels, one), lambda x: x.isNotNull())
    return F.coalesce(found, F.array().cast("array<string>"))


def is_remote(title: Column, description: Column, place: Column | None = None) -> Column:
    parts = [F.coalesce(c, F.lit("")) for c in (title, description, F.lit("") if place is None else place)]
    text = F.lower(F.concat_ws(" ", *parts))
    # Remote markers, matched as substrings.
    return any_of([F.contains(text, F.lit(k)) for k in ("remote", "work from home", "wfh")])


def cap_description(c: Column, chars: int | None = None) -> Column:
    """The whole text, or its first characters if a limit is asked for; never null."""
    whole = F.coalesce(c, F.lit(""))
    return whole if chars is None else F.substring(whole, 1, chars)


def cut_to(c: Column, width: int | None) -> Column:
    return c if width is None else F.substring(c, 1, width)


def profile_name(c: Column) -> Column:
    """Safe profile name from a config stem; 'config' and names without usable characters become 'default'."""
    safe = F.lower(F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9_-]", "-"), r"\A-+|-+\z", ""))
    return F.when((c == "config") | (safe == ""), F.lit("default")).otherwise(safe)


# The characters each channel needs escaped.
MARKDOWN_V2 = r"([_*\[\]()~`>#+\-=|{}.!])"
DISCORD = r"([\\*_~`|])"


def escape(c: Column, channel: str) -> Column:
    """Escape free text for a message channel: telegram, slack, discord, macos or email (unchanged)."""
    if channel == "telegram":
        return F.regexp_replace(c, MARKDOWN_V2, r"\\$1")
    if channel == "discord":
        return F.regexp_replace(c, DISCORD, r"\\$1")
    if channel == "slack":
        for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            c = F.replace(c, F.lit(char), F.lit(entity))
        return c
    if channel == "macos":
        return F.regexp_replace(c, r'([\\"])', r"\\$1")
    if channel == "email":
        return c
    raise ValueError(f"unknown channel: {channel}")
