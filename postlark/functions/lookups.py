"""Lookup tables used by location clean-up, as literal map expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# US state and territory names with their postal codes. Results depend on these exact entries.
STATE_CODES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO",
    "connecticut": "CT", "delaware": "DE", "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID",
    "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA",
    "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN",
    "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV",
    "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM", "new york": "NY", "north carolina": "NC",
    "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA",
    "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX",
    "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV",
    "wisconsin": "WI", "wyoming": "WY", "district of columbia": "DC", "puerto rico": "PR", "guam": "GU",
    "us virgin islands": "VI", "american samoa": "AS", "northern mariana islands": "MP",
}

# Country names and short forms with their two-letter codes.
COUNTRY_CODES = {
    "united states": "US", "united states of america": "US", "usa": "US", "canada": "CA", "united kingdom": "GB",
    "uk": "GB", "australia": "AU", "germany": "DE", "france": "FR", "india": "IN", "japan": "JP", "china": "CN",
    "brazil": "BR", "mexico": "MX", "spain": "ES", "italy": "IT", "netherlands": "NL", "sweden": "SE",
    "switzerland": "CH", "singapore": "SG", "ireland": "IE", "israel": "IL", "south korea": "KR",
    "new zealand": "NZ", "united arab emirates": "AE", "uae": "AE", "saudi arabia": "SA", "qatar": "QA",
    "bahrain": "BH", "kuwait": "KW", "oman": "OM", "jordan": "JO", "egypt": "EG", "lebanon": "LB",
    "pakistan": "PK", "georgia": "GE",
}


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value for ``key`` in a literal map, null when absent. Folded to one literal, so no join and no shuffle."""
    return F.try_element_at(F.str_to_map(F.lit(",".join(f"{k}:{v}" for k, v in table.items()))), key)


def one_of(values, c: Column) -> Column:
    """``c`` itself when it is among the values, else null."""
    return lookup({v: v for v in sorted(set(values))}, c)


def any_of(conditions: list[Column]) -> Column:
    """OR over conditions; false for none, and null operands count as false."""
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions], F.lit(False))
