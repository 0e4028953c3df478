"""Postings in card-style HTML. The parser only picks raw texts out of a page; every interpretation is an expression."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from postlark.functions.dates import first_number_age, iso_date
from postlark.functions.location import location_display, normalise_location, split_location
from postlark.functions.pay import salary_range
from postlark.functions.text import is_remote
from postlark.operators.spread import attach

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"script", "style", "template"}


@dataclass(slots=True)
class Element:
    """An element of a page: what it encloses are the elements and text pieces up to its ends."""

    tag: str
    attrs: dict
    start: int
    text_start: int
    end: int = 0
    text_end: int = 0

    @property
    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()


class Page(HTMLParser):
    """A page as flat lists of elements and visible text pieces, in document order; nesting of any depth is fine."""

    def __init__(self, body: str | None):
        super().__init__()
        self.elements: list[Element] = []
        self.pieces: list[str] = []
        self._open: list[Element] = []
        self._opened: Counter = Counter()
        self.feed(body or "")
        self.close()
        self._close_from(0)

    def _close_from(self, depth: int) -> None:
        for element in self._open[depth:]:
            element.end, element.text_end = len(self.elements), len(self.pieces)
            self._opened[element.tag] -= 1
        del self._open[depth:]

    def handle_starttag(self, tag, attrs):
        element = Element(tag, dict(attrs), len(self.elements) + 1, len(self.pieces))
        self.elements.append(element)
        if tag in VOID:
            element.end, element.text_end = element.start, element.text_start
        else:
            self._open.append(element)
            self._opened[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.elements.append(Element(tag, dict(attrs), len(self.elements) + 1, len(self.pieces), len(self.elements) + 1, len(self.pieces)))

    def handle_endtag(self, tag):
        if self._opened[tag]:
            self._close_from(max(i for i, e in enumerate(self._open) if e.tag == tag))

    def handle_data(self, data):
        if not any(self._opened[tag] for tag in HIDDEN):
            self.pieces.append(data)

    def all(self, step: tuple, within: Element | None = None):
        """Elements that fit a step, in document order."""
        inside = self.elements if within is None else self.elements[within.start : within.end]
        return (e for e in inside if _fits(e, *step))

    def one(self, path: list[tuple], within: Element | None = None) -> Element | None:
        """Follow a path: the first element that fits each step, inside the one before."""
        for step in path:
            within = next(self.all(step, within), None)
            if within is None:
                return None
        return within

    def text(self, element: Element, join: str = "", strip: bool = False) -> str:
        found = self.pieces[element.text_start : element.text_end]
        return join.join(t.strip() for t in found) if strip else join.join(found).strip()


def _fits(element: Element, tag: str, how: str = "", what: str = "") -> bool:
    if element.tag != tag:
        return False
    if how == "class":
        return what in element.classes
    if how == "like":
        return any(re.search(what, c) for c in element.classes)
    return what in element.attrs if how == "with" else True


# Where the cards of each site keep their fields. A field names the ways to it, tried in order (each a path
# of steps: tag, then a class, a class pattern or an attribute), and how to read what is found: an attribute (@name) or
# the text, its pieces stripped, whole, or spaced. The value for an absent element comes last.
_META = ("div", "class", "base-search-card__metadata")
LINKEDIN = {
    "cards": [("div", "class", "base-search-card")],
    "href": ([[("a", "class", "base-card__full-link")]], "@href", None),
    "title": ([[("span", "class", "sr-only")]], "stripped", None),
    "company": ([[("h4", "class", "base-search-card__subtitle"), ("a",)]], "stripped", None),
    "place": ([[_META, ("span", "class", "job-search-card__location")]], "whole", None),
    "day": (
        [[_META, ("time", "class", "job-search-card__listdate")], [_META, ("time", "class", "job-search-card__listdate--new")]],
        "@datetime", None,
    ),
    "pay": ([[("span", "class", "job-search-card__salary-info")]], "spaced", None),
}
BAYT = {
    "cards": [("li", "with", "data-js-job"), ("div", "like", "job-item|has-pointer-d")],
    "href": ([[("a", "with", "href")]], "@href", ""),
    "title": ([[("h2",)], [("a", "like", "jb-title|job-title")]], "stripped", None),
    "company": (
        [[("b", "like", "company|employer")], [("span", "like", "company|employer")], [("div", "like", "company")]], "stripped", None,
    ),
    "place": ([[("span", "like", "location|loc")], [("div", "like", "location")]], "stripped", ""),
    "day": ([[("span", "like", "date|time|posted")]], "stripped", None),
}
BAYT_IDS, BAYT_LINK = ("data-job-id", "data-js-job"), r"/en/.*job-(\d+)"
DETAIL = ("div", "like", "show-more-less-html__markup")

CARD_FIELDS = ["card_id", "href", "title", "company", "place", "day", "pay"]
CARD = ArrayType(StructType([StructField(name, StringType()) for name in CARD_FIELDS]))


def _read(page: Page, element: Element, how: str) -> str | None:
    if how.startswith("@"):
        return element.attrs.get(how[1:])
    return page.text(element, " " if how == "spaced" else "", how == "stripped")


def _cards(body: str | None, layout: dict) -> list[tuple[Page, Element, dict]]:
    """The cards of a page with the fields of the layout. The first kind of card that occurs counts."""
    page = Page(body)
    found = next((cards for step in layout["cards"] if (cards := list(page.all(step)))), [])
    out = []
    for card in found:
        fields = dict.fromkeys(CARD_FIELDS)
        for name, (ways, how, absent) in ((n, f) for n, f in layout.items() if n != "cards"):
            at = next((e for way in ways if (e := page.one(way, card)) is not None), None)
            fields[name] = absent if at is None else _read(page, at, how)
        out.append((page, card, fields))
    return out


def _bayt_id(page: Page, card: Element) -> str | None:
    """The id a card carries, or the number in its first link to a posting."""
    carried = next((v for name in BAYT_IDS if (v := card.attrs.get(name))), None)
    links = (re.search(BAYT_LINK, e.attrs.get("href") or "") for e in page.all(("a",), card))
    return carried or next((m.group(1) for m in links if m), None)


# Pages are parsed one by one: plain rows reach Python a hundred at a time, Arrow batches would hold ten thousand pages.
@F.udf(CARD, useArrow=False)
def linkedin_cards(body: str | None) -> list[dict]:
    return [fields for _, _, fields in _cards(body, LINKEDIN)]


@F.udf(CARD, useArrow=False)
def bayt_cards(body: str | None) -> list[dict]:
    return [fields | {"card_id": _bayt_id(page, card)} for page, card, fields in _cards(body, BAYT)]


@F.udf(StringType(), useArrow=False)
def detail_text(body: str | None) -> str:
    """Description on a detail page: the visible text of its mark-up block, '' when there is none."""
    page = Page(body)
    block = page.one([DETAIL])
    return "" if block is None else re.sub(r"\s+", " ", page.text(block, " ")).strip()


def _exploded(payloads: DataFrame, cards: Column) -> DataFrame:
    pages = payloads.withColumn("_cards", cards)
    pages = pages.withColumn("raw_count", F.coalesce(F.size("_cards"), F.lit(0))).drop("body")
    return pages.select("*", F.posexplode_outer("_cards").alias("pos", "c")).drop("_cards")


def linkedin(payloads: DataFrame, as_of: Column) -> DataFrame:
    rows = _exploded(payloads, linkedin_cards("body"))
    job_id = F.element_at(F.split(F.get(F.split("c.href", r"\?"), F.lit(0)), "-"), -1)
    place = split_location(F.col("c.place"), "linkedin")
    pay = salary_range(F.col("c.pay"))
    rows = rows.withColumns({"source_id": job_id, "_place": place, "_pay": pay}).select(
        "*", "_place.*", F.col("_pay.min").alias("comp_min"), F.col("_pay.max").alias("comp_max"),
        F.coalesce("_pay.currency", F.lit("USD")).alias("comp_currency"), F.col("_pay.interval").alias("comp_interval"),
    )
    rows = normalise_location(rows.withColumn("is_remote", F.lit(False)))
    title = F.coalesce("c.title", F.lit("N/A"))
    shown = location_display(F.col("city"), F.col("state"), F.lit(False))
    return rows.withColumns(
        {
            "seen_key": F.col("source_id"),
            "url": F.concat(F.lit("https://www.linkedin.com/jobs/view/"), F.col("source_id")),
            "title": title,
            "company": F.coalesce("c.company", F.lit("N/A")),
            "description": F.lit(""),
            "place_text": shown,
            "is_remote": is_remote(title, F.lit(""), shown),
            "date_posted": iso_date(F.col("c.day")),
            "has_cursor": F.lit(True),
        }
    )


def bayt(payloads: DataFrame, as_of: Column) -> DataFrame:
    rows = _exploded(payloads, bayt_cards("body"))
    href, title = F.coalesce("c.href", F.lit("")), F.col("c.title")
    full = F.when((href == "") | href.startswith("http"), href).otherwise(
        F.concat(F.lit("https://www.bayt.com"), href)
    )
    source_id = F.when(F.coalesce(title, F.lit("")) != "", F.nullif(F.col("c.card_id"), F.lit("")))
    rows = rows.withColumns({"source_id": source_id, "_place": split_location(F.col("c.place"), "bayt")})
    return rows.select("*", "_place.*").withColumns(
        {
            "seen_key": F.col("source_id"),
            "url": full,
            "title": title,
            "company": F.coalesce("c.company", F.lit("Unknown")),
            "description": F.lit(""),
            "is_remote": is_remote(title, F.lit(""), F.col("c.place")),
            "date_posted": first_number_age(F.col("c.day"), as_of, hours_are_today=True),
            "has_cursor": F.lit(True),
        }
    )


def _readable() -> Column:
    """Detail pages that were answered and don't lead to a sign-up."""
    return (F.col("status_code") == 200) & ~F.contains(F.coalesce("url", F.lit("")), F.lit("linkedin.com/signup"))


def _filled(joined: DataFrame, columns: list[str]) -> DataFrame:
    """Descriptions from ``_detail`` where there is one; the remote flag is taken again, now with the description."""
    text = F.coalesce("_detail", "description")
    shown = location_display(F.col("city"), F.col("state"), F.lit(False))
    flag = F.col("is_remote") | is_remote(F.col("title"), text, shown)
    return joined.withColumns({"is_remote": flag, "description": text}).select(*columns)


def enrich_descriptions(postings: DataFrame, details: DataFrame) -> DataFrame:
    """Fill descriptions from detail pages (source_id, status_code, url, body, perhaps fetched_at); missing ones and
    sign-up redirects give ''."""
    # Texts are parsed where the pages lie; of repeated pages the latest with a time counts, ties by text.
    at = F.col("fetched_at") if "fetched_at" in details.columns else F.lit(None).cast("timestamp_ntz")
    read = details.where(_readable()).select("source_id", F.struct(at.alias("at"), detail_text("body").alias("text")).alias("_page"))
    texts = read.groupBy("source_id").agg(F.max("_page").alias("_page")).select("source_id", F.col("_page.text").alias("_detail"))
    return _filled(attach(postings, texts, "source_id"), postings.columns)


def late_descriptions(postings: DataFrame, details: DataFrame, wait: str = "2 days") -> DataFrame:
    """``enrich_descriptions`` for streams: a detail page counts whether it lands before, with or after its card.

    Both sides are kept for ``wait`` of event time (``date_scraped``, ``fetched_at``) and no longer; a posting whose page hasn't
    come by then goes on without a text. Of a posting's pages the first that lands counts.
    """
    cards = postings.withColumn("_at", F.col("date_scraped").cast("timestamp")).withWatermark("_at", wait)
    read = details.where(_readable()).select(
        F.col("source_id").alias("_of"), F.col("fetched_at").cast("timestamp").alias("_page_at"), detail_text("body").alias("_detail")
    )
    pages = read.withWatermark("_page_at", wait).dropDuplicatesWithinWatermark(["_of"])
    near = F.expr(f"source_id = _of AND _page_at >= _at - INTERVAL {wait} AND _page_at <= _at + INTERVAL {wait}")
    return _filled(cards.join(pages, near, "left_outer"), postings.columns)
