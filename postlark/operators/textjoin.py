"""Joins of texts with tables of words or patterns: which text contains which word, which pattern is found where.

Searching every text for every word costs texts times words. Here a word is known by itself, or by its rarest gram if it has more than
``LONGEST`` letters. The strings of each text that have these lengths are hashed where the texts lie, in blocks of bounded size, and one
whose bit isn't set among those of the words goes no further; the rest are joined with the words. So the cost follows the texts
and the matches, not the product, and words may be a table of any size. A gram's frequency is estimated on a sample of texts; a bad
estimate, two grams with one hash or a full bitmap cost time, never a match. A simple pattern is the few short strings it spells, another is known by literals it
can't do without, one of each branch; a pattern without any meets every text.

Texts are written by the caller, ``(row, text)``. Only those that meet a long word or a pattern that has to be searched for are read again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlark.operators.spread import attach, cut
from postlark.shipping import ship

LONGEST = 16
SAMPLE = 2_000
FLAGS = "(?Ud)"
# The bitmap has 2 ** BITS bits whatever the words; a block has this many characters or one piece of a text.
BITS = 24
BLOCK = 1 << 20


def _pieces(texts: pa.Array, overlap: int) -> Iterator[tuple[int, str]]:
    """Texts with their place in the batch, long ones in pieces that overlap, so that each gram lies whole in one."""
    for i, raw in enumerate(texts):
        if raw.is_valid:
            text = raw.as_py().decode("utf-8", "replace")
            for at in range(0, max(len(text) - overlap, 1), BLOCK):
                yield i, text[at : at + BLOCK + overlap]


def _blocks(texts: pa.Array, overlap: int) -> Iterator[tuple[list[int], list[str]]]:
    places, parts, size = [], [], 0
    for i, part in _pieces(texts, overlap):
        if parts and size + len(part) > BLOCK:
            yield places, parts
            places, parts, size = [], [], 0
        places.append(i)
        parts.append(part)
        size += len(part)
    if parts:
        yield places, parts


def _hashes(letters: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """64-bit hashes of the strings of each length that start at each place, lengths ascending."""
    out = np.zeros(len(letters) + 1, np.uint64)
    for n in range(1, max(lengths, default=0) + 1):
        if len(letters) < n:
            return
        out = out[:-1] * np.uint64(0x9E3779B97F4A7C15)
        out += letters[n - 1 :]
        out ^= out >> np.uint64(29)
        if n in lengths:
            yield n, out * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n)


def _found(texts: pa.Array, lengths: list[int], bits: np.ndarray | None) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Places of texts and their distinct strings of these lengths, of those whose bit is set."""
    overlap = max([n - 1 for n in lengths if n] or [0])
    last, known = -1, {}
    for places, parts in _blocks(texts, overlap):
        whole, sizes = "".join(parts), np.array([len(p) for p in parts])
        letters = np.frombuffer(whole.encode("utf-32-le"), np.uint32).astype(np.uint64)
        of = np.repeat(np.array(places, np.int64), sizes)
        part_of = np.repeat(np.arange(len(parts)), sizes)
        if 0 in lengths:
            fresh = [p for p in dict.fromkeys(places) if p != last]
            yield np.array(fresh, np.int64), [""] * len(fresh)
        known = known if places[0] == last else {}
        for n, hashed in _hashes(letters, [n for n in lengths if n]):
            inside = part_of[: len(hashed)] == part_of[n - 1 :]
            if bits is not None:
                inside &= bits[(hashed >> np.uint64(64 - BITS)).astype(np.int64)]
            at = np.flatnonzero(inside)
            at = at[np.lexsort((hashed[at], of[at]))]
            same = (of[at[1:]] == of[at[:-1]]) & (hashed[at[1:]] == hashed[at[:-1]])
            at = at[np.concatenate((np.ones(min(len(at), 1), bool), ~same))]
            # A text in several pieces gives each string once.
            again = (of[at] == last) & np.isin(hashed[at], known.get(n, hashed[:0]))
            at = at[~again]
            if len(at):
                yield of[at], [whole[i : i + n] for i in at.tolist()]
            mine = hashed[at[of[at] == places[-1]]]
            known[n] = np.concatenate((known[n], mine)) if places[-1] == last and n in known else mine
        last = places[-1]


def _grams(rows: DataFrame, keys: list[str], text: str, lengths: list[int], bits: np.ndarray | None = None) -> DataFrame:
    """The keys of each text with its strings of these lengths (``gram``), each once, of those whose bit is set."""
    packed = None if bits is None else np.packbits(bits).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if packed is None else np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        for batch in batches:
            for places, found in _found(batch.column(len(keys)), lengths, wanted):
                taken = [batch.column(i).take(pa.array(places)) for i in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*taken, pa.array(found, pa.string())], names=[*keys, "gram"])

    ship(rows.sparkSession)
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, F.col(text).cast("binary").alias("_text")).mapInArrow(run, f"{kinds}, gram string")


def _slots(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        out = []
        for gram in batch.column(0).to_pylist():
            for _, hashed in _hashes(np.frombuffer(gram.encode("utf-32-le"), np.uint32).astype(np.uint64), [len(gram)]):
                out.append(int(hashed[0] >> np.uint64(64 - BITS)))
        at = np.unique(np.array(out, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], names=["at", "bit"])


def _bitmap(grams: DataFrame) -> np.ndarray:
    """Whether each of 2 ** BITS slots has a gram: its size is fixed, and it is put together by Spark, 64 slots a row."""
    ship(grams.sparkSession)
    words = grams.select("gram").mapInArrow(_slots, "at bigint, bit bigint")
    out = np.zeros(1 << (BITS - 6), np.int64)
    for r in words.groupBy("at").agg(F.bit_or("bit").alias("bits")).collect():
        out[r["at"]] = r["bits"]
    return np.unpackbits(out.astype("<i8").view(np.uint8), bitorder="little").astype(bool)


def indexed(texts: DataFrame, words: DataFrame) -> tuple[DataFrame, list[int]]:
    """``(gram, word)``, each distinct word, or the rarest gram of a long one, and the lengths of these grams."""
    words = cut(words.where("word is not null").select("word", F.least(F.char_length("word"), F.lit(LONGEST)).alias("size"), (F.char_length("word") > LONGEST).alias("cut")).distinct())
    lengths = sorted(r["size"] for r in words.select("size").distinct().collect())
    own = words.where("not cut").select(F.col("word").alias("gram"), "word")
    long = words.where("cut")
    if LONGEST in lengths and not long.isEmpty():
        grams = cut(_grams(long, ["word"], "word", [LONGEST]))
        total = texts.count()
        sample = texts if total <= SAMPLE else texts.where(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < int((1 << 20) * SAMPLE / total))
        uses = _grams(sample, ["row"], "text", [LONGEST], _bitmap(grams)).groupBy("gram").agg(F.count("*").alias("uses"))
        rated = grams.join(uses, "gram", "left").fillna(0, ["uses"])
        own = own.unionByName(rated.groupBy("word").agg(F.min_by("gram", F.struct("uses", "gram")).alias("gram")).select("gram", "word"))
    return cut(own), lengths


def candidates(texts: DataFrame, words: DataFrame) -> DataFrame:
    """``(row, at, word, sure)``: the words that a text holds, surely or by their rarest gram. ``at`` tells rows of one number apart."""
    index, lengths = indexed(texts, words)
    told = texts.where("row is not null").withColumn("at", F.monotonically_increasing_id())
    met = _grams(told, ["row", "at"], "text", lengths, _bitmap(index)).join(index, "gram")
    return met.select("row", "at", "word", (F.col("gram") == F.col("word")).alias("sure"))


def containing(texts: DataFrame, words: DataFrame) -> DataFrame:
    """``(row, word)`` for every text that contains a word of the table as a substring."""
    met = cut(candidates(texts, words))
    open_ = met.where("not sure").groupBy("row").agg(F.collect_set("word").alias("words"))
    looked = attach(texts.select("row", "text"), cut(open_), "row").where("words is not null")
    found = looked.select("row", F.explode(F.filter("words", lambda w: F.contains(F.col("text"), w))).alias("word"))
    return met.where("sure").select("row", "word").unionByName(found)


# Patterns


def folded(text: Column) -> Column:
    """Lower case, also for the four letters beyond ASCII that a pattern without regard to case takes for ASCII ones."""
    return F.lower(F.translate(text, "ſıİ\u212a", "siik"))


def literals(pattern: str) -> list[str]:
    """Strings of which any text that the pattern fits holds one, without regard to case; none if that isn't certain.

    Only plain runs of ASCII characters outside groups and classes count, the longest of each branch.
    """
    if "[]" in pattern or "[^]" in pattern:
        return []
    found, run, branch = [], "", []
    at, n = 0, len(pattern)
    while at <= n:
        c = pattern[at] if at < n else "|"
        if c == "\\" and at + 1 < n and not pattern[at + 1].isalnum() and pattern[at + 1].isascii():
            c, at = pattern[at + 1], at + 1
            plain = True
        elif c == "\\":
            if pattern[at + 1 : at + 2] not in tuple("bBdDsSwWAzZ"):
                return []
            plain, at = False, at + 1
        elif c == "(":
            if pattern.startswith("(?", at) and not pattern.startswith(("(?:", "(?i)"), at):
                return []
            depth, inside = 1, False
            while depth and at + 1 < n:
                at += 1
                if pattern[at] == "\\":
                    if pattern[at + 1 : at + 2] in ("Q", "E"):
                        return []
                    at += 1
                elif pattern[at] == "[":
                    inside = True
                elif pattern[at] == "]":
                    inside = False
                elif not inside:
                    depth += {"(": 1, ")": -1}.get(pattern[at], 0)
            plain = False
        elif c == "[":
            at += 1
            while at < n and pattern[at] != "]":
                if pattern[at] == "[" or pattern.startswith("&&", at):
                    return []
                at += 2 if pattern[at] == "\\" else 1
            plain = False
        elif c == "|":
            branch.append(run)
            best = max(branch, key=len)
            if not best:
                return []
            found.append(best)
            run, branch, at = "", [], at + 1
            continue
        elif c in "*?{":
            run, plain = run[:-1], False
            if c == "{":
                at = pattern.find("}", at)
                if at < 0:
                    return []
        elif c == "+":
            plain = False
        else:
            plain = c.isascii() and c not in ".^$"
        if plain:
            run += c
        else:
            branch.append(run)
            run = ""
        at += 1
    return found


_SIMPLE = re.compile(r"""\(\?i\)((?:[a-z0-9 ,;:'"/_-]\??|\([a-z0-9 |]+\)\??|\[[a-z0-9 .,;:!]+\]\??)+)""")
_ITEM = re.compile(r"(\([^)]+\)|\[[^\]]+\]|.)(\??)")
MOST_SPELLED = 64


def spelled(pattern: str) -> list[str] | None:
    """All strings that a pattern fits, if it ignores case and is simple enough to have few. It is found in a text if and only if the
    folded text holds one of them, so no pattern has to be searched for."""
    simple = _SIMPLE.fullmatch(pattern)
    if not simple:
        return None
    out = [""]
    for item, optional in _ITEM.findall(simple.group(1)):
        ways = item[1:-1].split("|") if item[0] == "(" else list(item[1:-1]) if item[0] == "[" else [item]
        out = list(dict.fromkeys(s + w for s in out for w in ways + [""] * bool(optional)))
        if len(out) > MOST_SPELLED or max(map(len, out)) > LONGEST:
            return None
    return out


def _literal_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = [(p, w, exact is not None) for p in part["pattern"] for exact in [spelled(p)] for w in exact or literals(p) or [""]]
        yield pd.DataFrame(rows, columns=["pattern", "literal", "exact"])


def matching(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``(row, pattern)`` for every text in which a pattern of the table is found."""
    ship(texts.sparkSession)
    patterns = patterns.select("pattern").where("pattern is not null").distinct()
    known = cut(patterns.mapInPandas(_literal_rows, "pattern string, literal string, exact boolean").withColumn("literal", folded(F.col("literal"))))
    low = texts.select("row", folded(F.col("text")).alias("text"))
    held = candidates(low, known.select(F.col("literal").alias("word")))
    met = cut(held.join(known.withColumnRenamed("literal", "word"), "word").select("row", "at", "pattern", (F.col("sure") & F.col("exact")).alias("sure")).distinct())
    open_ = met.where("not sure").groupBy("row").agg(F.collect_set("pattern").alias("found"))
    looked = attach(texts.select("row", "text"), cut(open_), "row").where("found is not null")
    found = looked.select("row", F.explode(F.filter("found", lambda p: F.rlike(F.col("text"), F.concat(F.lit(FLAGS), p)))).alias("pattern"))
    return met.where("sure").select("row", "pattern").unionByName(found)
