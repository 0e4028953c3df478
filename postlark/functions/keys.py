"""Identity keys: one for the source's own id, one for the content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlark.functions.text import squeeze, strip


def _short_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def dedup_key(source: Column, source_id: Column) -> Column:
    return _short_hash(F.concat(source, F.lit(":"), source_id))


def content_key(
    title: Column,
    company: Column,
    city: Column,
    state: Column,
    date_posted: Column,
    description: Column,
    prefix: int | None = None,
) -> Column:
    """Fingerprint of what a posting says. Takes normalised locations; source and country do not take part.

    The whole description counts, or with ``prefix`` its first characters as they arrive, before clean-up. The state
    is only lower-cased and stripped.
    """

    def text(c: Column) -> Column:
        return squeeze(F.lower(F.coalesce(c, F.lit(""))))

    fields = [
        text(title),
        text(company),
        text(city),
        strip(F.lower(F.coalesce(state, F.lit("")))),
        F.coalesce(F.date_format(date_posted, "yyyy-MM-dd"), F.lit("")),
        text(description if prefix is None else F.substring(description, 1, prefix)),
    ]
    # Never null; saying so lets the optimiser drop null checks on fresh keys.
    return F.coalesce(_short_hash(F.concat_ws("|", *fields)), F.lit(""))


def matches_by_content(description: Column, min_chars: int | None = None) -> Column:
    """Whether a posting may be matched by content: any may, or with ``min_chars`` only those with a longer text."""
    return F.lit(True) if min_chars is None else F.coalesce(F.char_length(description) > min_chars, F.lit(False))
