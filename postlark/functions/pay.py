"""Pay parsing and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlark.functions.lookups import lookup
from postlark.functions.text import strip

# Unit words and the pay interval they stand for.
UNIT_INTERVALS = {"DAY": "daily", "YEAR": "yearly", "HOUR": "hourly", "WEEK": "weekly", "MONTH": "monthly"}
PERIOD_INTERVALS = {"ANNUAL": "yearly", "HOURLY": "hourly", "MONTHLY": "monthly", "WEEKLY": "weekly"}


def _filled(c: Column) -> Column:
    return F.coalesce(c != 0, F.lit(False))


def _whole(c: Column, grouping: bool) -> Column:
    """Whole number text; bround first because the displayed figure rounds half to even."""
    return F.format_string("$%,.0f" if grouping else "$%.0f", F.bround(c, 0))


def comp_display(low: Column, high: Column, interval: Column) -> Column:
    """'$100,000 - $150,000 /yearly'; '' when the lower amount is missing or zero."""
    upper = F.when(_filled(high) & (high != low), F.concat(F.lit("- "), _whole(high, True)))
    unit = F.concat(F.lit("/"), interval)
    return F.when(_filled(low), F.concat_ws(" ", _whole(low, True), upper, unit)).otherwise("")


def comp_display_concise(low: Column, high: Column) -> Column:
    """'$181k-$318k'. The lower amount alone decides whether both are shown in thousands."""

    def show(c: Column) -> Column:
        return F.when(low >= 1000, F.concat(_whole(c / 1000, False), F.lit("k"))).otherwise(_whole(c, False))

    upper = F.when(_filled(high) & (high != low), show(high))
    return F.when(_filled(low), F.concat_ws("-", show(low), upper)).otherwise("")


def currency_parser(c: Column) -> Column:
    """Amount in a money string; a separator within the last three characters is the decimal point."""
    kept = F.regexp_replace(c, "[^-0-9.,]", "")
    cut = F.greatest(F.char_length(kept) - 3, F.lit(0))
    head = F.regexp_replace(F.substring(kept, F.lit(1), cut), "[.,]", "")
    tail = F.substring(kept, cut + 1, F.lit(3))
    whole = F.concat(head, tail)
    decimal = F.when(F.contains(tail, F.lit(".")), whole).otherwise(F.replace(whole, F.lit(","), F.lit(".")))
    return decimal.try_cast("double")


def parse_compensation_interval(c: Column) -> Column:
    return lookup(UNIT_INTERVALS, F.upper(c))


def _truncated(c: Column) -> Column:
    return c.cast("double").cast("bigint").cast("double")


def _comp(low: Column, high: Column, currency: Column, interval: Column) -> Column:
    return F.struct(
        low.cast("double").alias("min"),
        high.cast("double").alias("max"),
        currency.cast("string").alias("currency"),
        interval.cast("string").alias("interval"),
    )


def salary_range(c: Column) -> Column:
    """Pay from 'low - high' text; null unless every dash-separated part is an amount and there are two or more."""
    amounts = F.transform(F.split(c, "-"), currency_parser)
    ok = (F.size(amounts) >= 2) & F.forall(amounts, lambda a: a.isNotNull())
    low, high = _truncated(F.get(amounts, 0)), _truncated(F.get(amounts, 1))
    return F.when(ok, _comp(low, high, F.lit("USD"), F.lit(None)))


def unit_pay(low: Column, high: Column, unit: Column, currency: Column) -> Column:
    """Pay given as a range with a unit word; an unknown unit or no amount at all means no pay."""
    interval = parse_compensation_interval(F.coalesce(unit, F.lit("YEAR")))
    ok = interval.isNotNull() & (low.isNotNull() | high.isNotNull())
    usd = F.coalesce(F.nullif(currency, F.lit("")), F.lit("USD"))
    return F.when(ok, _comp(_truncated(low), _truncated(high), usd, interval))


def percentile_pay(low: Column, high: Column, period: Column, currency: Column) -> Column:
    """Pay given as percentiles; zero counts as missing and an unknown period as yearly."""
    interval = F.coalesce(lookup(PERIOD_INTERVALS, F.upper(period)), F.lit("yearly"))
    usd = F.coalesce(F.nullif(currency, F.lit("")), F.lit("USD"))
    comp = _comp(F.nullif(low.cast("double"), F.lit(0.0)), F.nullif(high.cast("double"), F.lit(0.0)), usd, interval)
    return F.when(low.isNotNull() | high.isNotNull(), comp)


def annual_or_plain_pay(
    low_annual: Column, high_annual: Column, low: Column, high: Column, basis: Column
) -> Column:
    """Pay with annual figures preferred; hourly when its basis text says so."""

    def pick(annual: Column, plain: Column) -> Column:
        return F.coalesce(F.nullif(annual.cast("double"), F.lit(0.0)), plain.cast("double"))

    chosen_low, chosen_high = pick(low_annual, low), pick(high_annual, high)
    hourly = F.contains(F.lower(F.coalesce(basis, F.lit(""))), F.lit("hour"))
    comp = _comp(
        F.nullif(chosen_low, F.lit(0.0)),
        F.nullif(chosen_high, F.lit(0.0)),
        F.lit("USD"),
        F.when(hourly, F.lit("hourly")).otherwise("yearly"),
    )
    return F.when(chosen_low.isNotNull() | chosen_high.isNotNull(), comp)


def salary_text(c: Column) -> Column:
    return salary_range(strip(c))
