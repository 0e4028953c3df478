"""Location clean-up and display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlark.functions.lookups import COUNTRY_CODES, STATE_CODES, lookup, one_of
from postlark.functions.text import blank_to_null, strip

METRO_SUFFIX = r"(?U)[\s\x1c-\x1f]*( metropolitan area| metro area)\z"


def state_code(c: Column) -> Column:
    """Two-letter code for a state name or code, null when it is neither."""
    return F.coalesce(lookup(STATE_CODES, F.lower(c)), one_of(STATE_CODES.values(), F.upper(c)))


def country_code(c: Column) -> Column:
    return F.coalesce(lookup(COUNTRY_CODES, F.lower(c)), one_of(COUNTRY_CODES.values(), F.upper(c)))


def normalise_location(
    df: DataFrame, city: str = "city", state: str = "state", country: str = "country", remote: str = "is_remote"
) -> DataFrame:
    """Replace the three location columns by their normalised values.

    Every step is a ``when`` over literal maps, so the whole clean-up is a few projections and needs no join. The
    steps are plain columns: each is computed once and later steps refer to it.
    """
    c, s, n = F.col("_c"), F.col("_s"), F.col("_n")
    remote_c = F.coalesce(F.col(remote), F.lit(False))
    step = df.withColumns({"_c": blank_to_null(F.col(city)), "_s": blank_to_null(F.col(state)), "_n": blank_to_null(F.col(country))})
    # A city that only says 'remote' carries nothing once the flag is set.
    step = step.withColumn("_c", F.when(~(remote_c & (F.lower(c) == "remote")) | c.isNull(), c))
    # What each raw field would mean if it held another field's value.
    step = step.withColumns({"_lc": F.lower(c), "_ls": F.lower(s)}).withColumns(
        {
            "_c_state": lookup(STATE_CODES, F.col("_lc")),
            "_c_country": lookup(COUNTRY_CODES, F.col("_lc")),
            "_s_state": lookup(STATE_CODES, F.col("_ls")),
            "_s_country": lookup(COUNTRY_CODES, F.col("_ls")),
        }
    )
    shifted = F.col("_c_state").isNotNull() & F.col("_s_country").isNotNull()
    how = (
        F.when(shifted, "shifted")
        .when(s.isNull() & F.col("_c_country").isNotNull(), "country in city")
        .when(F.col("_s_country").isNotNull() & F.col("_s_state").isNull(), "country in state")
        .otherwise("")
    )
    step = step.withColumn("_how", how)
    moved = F.col("_how")
    step = step.withColumns(
        {
            "_c": F.when(~moved.isin("shifted", "country in city"), c),
            "_s": F.when(moved == "shifted", F.col("_c_state")).when(moved != "country in state", s),
            "_n": F.when(moved == "country in city", F.col("_c_country"))
            .when(moved != "", F.col("_s_country"))
            .otherwise(n),
        }
    )
    bare = strip(F.regexp_replace(F.lower(s), METRO_SUFFIX, ""))
    code = F.coalesce(lookup(STATE_CODES, bare), one_of(STATE_CODES.values(), F.upper(s)), s)
    out = step.withColumns({city: c, state: code, country: F.coalesce(country_code(n), n)})
    return out.drop("_c", "_s", "_n", "_lc", "_ls", "_c_state", "_c_country", "_s_state", "_s_country", "_how")


def location_display(city: Column, state: Column, remote: Column) -> Column:
    tag = F.when(F.coalesce(remote, F.lit(False)), F.lit("(Remote)"))
    text = F.concat_ws(", ", F.nullif(city, F.lit("")), F.nullif(state, F.lit("")), tag)
    return F.when(text == "", F.lit("Unknown")).otherwise(text)


def alert_states(states: Column) -> Column:
    """Normalised list of allowed states; unknown entries stay, stripped."""
    return F.transform(states, lambda s: F.coalesce(state_code(strip(s)), strip(s)))


def split_location(text: Column, site: str) -> Column:
    """City, state and country of a site's location line. Which part means what differs by site."""
    parts = F.transform(F.split(text, ","), strip)
    n = F.size(parts)
    first, second, third = (F.get(parts, i) for i in range(3))
    last = F.element_at(parts, -1)
    null = F.lit(None).cast("string")
    if site == "linkedin":
        city = F.when(n >= 2, first).otherwise(strip(text))
        state, country = second, F.when(n >= 3, third).otherwise(F.lit("US"))
    elif site == "glassdoor":
        filled = F.nullif(text, F.lit(""))
        city = F.when(n >= 2, first).otherwise(filled)
        state, country = second, F.coalesce(F.nullif(third, F.lit("")), F.lit("US"))
    elif site == "bayt":
        city = F.when(n >= 2, first).otherwise(F.nullif(text, F.lit("")))
        state, country = null, F.when(n >= 2, last)
    elif site == "google":
        city, state, country = F.when(n >= 2, first), second, third
    else:
        raise ValueError(f"no location format for site: {site}")
    return F.struct(city.alias("city"), state.alias("state"), country.alias("country"))
