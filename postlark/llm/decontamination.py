"""Benchmark decontamination by template canonicalisation.

A text becomes a *template*: its words in lower case, with typed placeholders for numbers, for units after a number, and
for names (a capitalised word that follows a word inside a sentence). Windows of 8 template words are hashed and joined
with the windows of the benchmark, so a question asked again with other numbers or names still meets its original. Where
windows line up (same item, same distance between the places) the slots are compared: a value of the benchmark must
stand for one value throughout the document's copy. Alignments that break this are chance and go.

A document leaks an item if an alignment covers ``SHARE`` of the item's windows, or ``RUN`` of them (13 words). Windows
with fewer than ``LITERALS`` plain words prove nothing and are not used; items under 8 words have no window.

``leaks`` as its SQL defines it passes over copies of items without a window, copies in another case, and alignments with
one broken slot. ``decontaminate`` finds these too if asked for the ``whole`` job: ``literal_leaks`` joins windows of the
same words whatever their case and scripts without blanks by the character, and ``mend`` drops only the windows at a slot
whose value breaks with the others and doesn't equal the benchmark's. An item under 8 words is common speech more often than
a copy: it counts only where it stands alone, from one sentence mark, line break or end of the text to the next.

Rows are told apart by a key of id and text (``row_key``), so rows without an id, or with an id in common, are each judged by
their own text.

The first pass joins window hashes alone, to find the documents with any hit; only these are templated again with their
slots. The benchmark's windows are broadcast if there are at most ``BROADCAST_ROWS``, else joined by a shuffle, with the
same result. All of it is DataFrame code.

Cases: null or empty texts and an empty benchmark give no rows; a null id or item id is reported as null, once for an item
however many rows without an id leak it; a document repeated row for row is reported once; several alignments of a pair count once, the fullest; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlark.operators.spread import cut, settled

WINDOW = 8
LITERALS = 4
SHARE = 0.5
RUN = 6
BROADCAST_ROWS = 500_000
MEASURES = ["n_windows", "item_windows", "n_slots", "n_changed"]
TOKENS = r"[\p{L}\p{M}]+|[0-9]+(?:[.,][0-9]+)*|[.!?:;\n]"
ENDS = [".", "!", "?", ":", ";", "\n"]
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
LITERAL_TOKENS = rf"[{UNSPACED}]\p{{M}}*|[\p{{L}}\p{{M}}&&[^{UNSPACED}]]+|[0-9]+(?:[.,][0-9]+)*"
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometers kilometres "
    "mg g kg lb lbs oz t gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres "
    "ms s sec min h hr second seconds minute minutes hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros usd eur gbp percent degrees mph kph kmh"
).split()


def row_key(id_col: str, text_col: str) -> Column:
    """A row's id, if it has one, and the digest of its text."""
    return F.concat_ws("|", F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def _id_in(key: str) -> Column:
    """The id in a row's key; the digest after it has 32 characters."""
    return F.when(F.length(key) > 32, F.substring(key, F.lit(1), F.length(key) - 33))


def _is_number(token: Column) -> Column:
    return F.substring(token, 1, 1).between("0", "9")


def template(tokens: Column) -> Column:
    """Per token: the hash of a plain word, 1 for a number, 2 for a unit, 3 for a name; null for a sentence mark."""

    def one(token: Column, i: Column) -> Column:
        first, before = F.substring(token, 1, 1), F.get(tokens, i - 1)
        ending = F.right(before, F.lit(1))
        inside = before.isNotNull() & ~before.isin(ENDS) & (ending == F.lower(ending))
        return (
            F.when(token.isin(ENDS), F.lit(None).cast("long"))
            .when(_is_number(token), F.lit(1).cast("long"))
            .when(token.isin(UNITS) & F.coalesce(_is_number(before), F.lit(False)), F.lit(2).cast("long"))
            .when((first != F.lower(first)) & inside, F.lit(3).cast("long"))
            .otherwise(F.xxhash64(F.lower(token)))
        )

    return F.transform(tokens, one)


def _tokens(rows: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """Settle the raw tokens of each text."""
    tokens = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(TOKENS), F.lit(0))
    return settled(rows.select(*keep, text_col), {"_tokens": tokens}).drop(text_col)


def _windowed(hashes: str, value) -> Column:
    """``value(i)`` for the place i of each window of an array."""
    last = F.size(hashes) - WINDOW
    return F.explode(F.transform(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")), value))


def _hash_at(i: Column) -> Column:
    return F.xxhash64(*[F.get(F.col("_t"), i + k) for k in range(WINDOW)])


def window_hashes(rows: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """Template window hashes alone, one row each."""
    found = settled(_tokens(rows, text_col, *keep), {"_t": F.array_compact(template(F.col("_tokens")))}).drop("_tokens")
    return found.select(*keep, _windowed("_t", _hash_at).alias("hash"))


def windows_with_slots(rows: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """Template windows with place, template and, per word, the hash of what stands there."""
    found = _tokens(rows, text_col, *keep)
    both = F.arrays_zip(template(F.col("_tokens")).alias("t"), F.transform("_tokens", lambda t: F.xxhash64(F.lower(t))).alias("v"))
    found = settled(found, {"_both": F.filter(both, lambda x: x["t"].isNotNull())}).drop("_tokens")
    found = settled(found, {"_t": F.transform("_both", lambda x: x["t"]), "_v": F.transform("_both", lambda x: x["v"])}).drop("_both")
    part = lambda name, i: F.slice(F.col(name), i + 1, F.lit(WINDOW))
    window = lambda i: F.struct(i.alias("place"), _hash_at(i).alias("hash"), part("_t", i).alias("t"), part("_v", i).alias("v"))
    return found.select(*keep, _windowed("_t", window).alias("w")).select(*keep, "w.*")


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Windows of the items with enough plain words, and how many each item has."""
    plain = F.size(F.filter("t", lambda x: ~x.isin(1, 2, 3)))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).distinct()
    used = windows_with_slots(items, "text", "item_id").where(plain >= LITERALS)
    return cut(used.withColumnsRenamed({"place": "item_place", "t": "item_t", "v": "item_v"}))


def _aligned(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, mend: bool) -> DataFrame:
    """The alignments that are leaks: key of the row, item, measures."""
    known = benchmark_windows(benchmark, item_col, item_text_col)
    small = known.count() <= BROADCAST_ROWS
    ready = F.broadcast if small else (lambda df: df)
    rows = docs.select(row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))

    hit = window_hashes(rows, "text", "row").join(ready(known.select("hash").distinct()), "hash", "left_semi").select("row").distinct()
    again = rows.join(cut(hit), "row", "left_semi")
    found = windows_with_slots(again, "text", "row").join(ready(known), "hash").where(F.col("t") == F.col("item_t"))
    found = found.withColumn("shift", F.col("place") - F.col("item_place"))

    key = ["row", "item_id", "shift"]
    pairs = F.transform(F.arrays_zip("t", "v", "item_v"), lambda x, k: F.struct((F.col("item_place") + k).alias("at"), x["t"].alias("t"), x["v"].alias("v"), x["item_v"].alias("b")))
    slots = found.select(*key, F.inline(F.filter(pairs, lambda x: x["t"].isin(1, 2, 3)))).distinct()
    judged = slots.groupBy(*key, "t", "b").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.count("*").alias("n"))
    judged = judged.groupBy(*key).agg(
        F.sum("n").alias("n_slots"),
        F.sum(F.when(F.col("b") != F.col("least"), F.col("n")).otherwise(0)).alias("n_changed"),
        F.max((F.col("least") != F.col("most")).cast("int")).alias("broken"),
    )
    if mend:
        judged = judged.withColumn("broken", F.lit(0))
        found = _mended(found, slots, key)
    counted = found.groupBy(*key).agg(F.count_distinct("item_place").alias("n_windows"))
    same = [counted[k].eqNullSafe(judged[k]) for k in key]
    whole = known.groupBy(F.col("item_id").alias("whole_id")).agg(F.count_distinct("item_place").alias("item_windows"))
    aligned = counted.join(judged, same, "left").select(
        *[counted[k] for k in key], "n_windows", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_slots", "n_changed", "broken")]
    )
    sized = aligned.where("broken = 0").join(whole, F.col("item_id").eqNullSafe(F.col("whole_id")))
    leaked = sized.where((F.col("n_windows") >= SHARE * F.col("item_windows")) | (F.col("n_windows") >= RUN))
    return leaked.select("row", "item_id", *MEASURES)


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    mend: bool = False,
) -> DataFrame:
    """One row per document and item it leaks: ``n_windows``, ``item_windows``, ``n_slots``, ``n_changed`` slots.

    With ``mend``, ``n_windows`` counts those without an inconsistent slot, and other windows of an alignment don't matter.
    """
    aligned = _aligned(docs, benchmark, id_col, text_col, item_col, item_text_col, mend)
    by_id = aligned.withColumn("doc_id", _id_in("row").cast(docs.schema[id_col].dataType))
    best = by_id.groupBy("doc_id", "item_id").agg(F.max(F.struct(*MEASURES)).alias("best"))
    return best.select("doc_id", "item_id", "best.*")


def _mended(found: DataFrame, slots: DataFrame, key: list[str]) -> DataFrame:
    """Windows without an inconsistent slot. Of several values for one of the benchmark, the most frequent is taken for the copy's."""
    values = slots.groupBy(*key, "t", "b", "v").agg(F.count("*").alias("n"))
    taken = values.groupBy(*key, "t", "b").agg(F.max(F.struct("n", F.col("v") == F.col("b"), "v"))["v"].alias("taken"))
    taken = taken.select(*[F.col(k).alias(f"taken_{k}") for k in (*key, "t", "b")], "taken")
    same = [F.col(k).eqNullSafe(F.col(f"taken_{k}")) for k in (*key, "t", "b")]
    odd = slots.join(taken, same).where("v <> taken and v <> b")
    odd = odd.groupBy(*key).agg(F.collect_set("at").alias("odd")).select(*[F.col(k).alias(f"odd_{k}") for k in key], "odd")
    there = [F.col(k).eqNullSafe(F.col(f"odd_{k}")) for k in key]
    holds = F.exists("odd", lambda at: at.between(F.col("item_place"), F.col("item_place") + WINDOW - 1))
    return found.join(odd, there, "left").where(~F.coalesce(holds, F.lit(False))).select(*found.columns)


def _literal_windows(rows: DataFrame, widths: list[int], *keep: str, alone: bool = False) -> DataFrame:
    """Windows of these widths over the words of ``text`` without their case, with place and the number of words.

    ``alone``: those under ``WINDOW`` words only where they fill all between two sentence marks, line breaks or ends.
    """
    marks = alone and min(widths) < WINDOW
    pattern = rf"{LITERAL_TOKENS}|[.!?:;\n]" if marks else LITERAL_TOKENS
    tokens = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(0))
    if marks:
        rows = settled(rows.select(*keep, "text"), {"_tokens": tokens}).drop("text")
        is_mark = lambda i: F.coalesce(F.get(F.col("_tokens"), i).isin(ENDS), F.lit(True))
        word = lambda t, i: F.struct(F.xxhash64(F.lower(t)).alias("h"), is_mark(i - 1).alias("opens"), is_mark(i + 1).alias("closes"), t.isin(ENDS).alias("mark"))
        rows = settled(rows, {"_words": F.filter(F.transform("_tokens", word), lambda x: ~x["mark"])}).drop("_tokens")
        rows = settled(rows, {"_t": F.transform("_words", lambda x: x["h"]), "_words": F.col("_words")})
    else:
        rows = settled(rows.select(*keep, "text"), {"_t": F.transform(tokens, lambda w: F.xxhash64(F.lower(w)))}).drop("text")

    def windows(width: int) -> Column:
        last = F.size("_t") - width
        hashed = lambda i: F.xxhash64(*[F.get(F.col("_t"), i + k) for k in range(width)])
        window = lambda i: F.struct(i.alias("place"), F.lit(width).alias("width"), hashed(i).alias("hash"))
        places = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
        if marks and width < WINDOW:
            at = lambda i: F.get(F.col("_words"), i)
            places = F.filter(places, lambda i: at(i)["opens"] & at(i + (width - 1))["closes"])
        return F.when(last >= 0, F.transform(places, window))

    made = F.filter(F.array(*[windows(w) for w in widths]), lambda x: x.isNotNull())
    return rows.select(*keep, F.size("_t").alias("n_words"), F.explode(F.flatten(made)).alias("w")).select(*keep, "n_words", "w.*")


def _literal(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """Keys of rows and items of which they hold, in one alignment, ``SHARE`` or ``RUN`` of the windows word for word."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).distinct()
    known = _literal_windows(items, list(range(1, WINDOW + 1)), "item_id").where(F.col("width") == F.least("n_words", F.lit(WINDOW)))
    known = cut(known.select("item_id", "width", "hash", F.col("place").alias("item_place")))
    widths = [r["width"] for r in known.select("width").distinct().orderBy("width").collect()]
    ready = F.broadcast if known.count() <= BROADCAST_ROWS else (lambda df: df)
    rows = docs.select(row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    found = _literal_windows(rows, widths or [WINDOW], "row", alone=True).join(ready(known), ["width", "hash"])
    counted = found.groupBy("row", "item_id", (F.col("place") - F.col("item_place")).alias("shift")).agg(F.count_distinct("item_place").alias("n"))
    whole = known.groupBy(F.col("item_id").alias("whole_id")).agg(F.count_distinct("item_place").alias("item_windows"))
    sized = counted.join(whole, F.col("item_id").eqNullSafe(F.col("whole_id")))
    return sized.where((F.col("n") >= SHARE * F.col("item_windows")) | (F.col("n") >= RUN)).select("row", "item_id").distinct()


def literal_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """Documents and items of which they hold, in one alignment, ``SHARE`` or ``RUN`` of the windows word for word."""
    found = _literal(docs, benchmark, id_col, text_col, item_col, item_text_col)
    return found.select(_id_in("row").cast(docs.schema[id_col].dataType).alias("doc_id"), "item_id").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """The documents that leak no item; for the ``whole`` job, also not word for word or with a broken slot."""
    columns = (id_col, text_col, "item_id", "text")
    leaked = _aligned(docs, benchmark, *columns, mend=whole).select("row")
    if whole:
        leaked = leaked.union(_literal(docs, benchmark, *columns).select("row"))
    return docs.join(leaked.distinct(), row_key(id_col, text_col) == leaked["row"], "left_anti")
