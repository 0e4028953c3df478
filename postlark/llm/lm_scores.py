"""Language-model scores from log-frequency Bloom filters.

Tokens are words in ASCII lower case and one end per document. Training documents give exact counts of all tokens and of
all bigrams, gathered in hash buckets (see :mod:`postlark.llm.chunks`). Bigram counts are quantised to powers of ``BASE``;
a bigram of level q is entered in its bucket's Bloom filter once for each level from 1 to q, so its level is read by
probing until the first miss. Every bigram that trains is entered, those seen once too, at ``BITS`` bits an entry. Chunks
ask the buckets for all their bigrams and get levels back, as they get the counts of tokens; so the filters are as large
as the corpus wants, and none is broadcast or collected.

The probability of a token after a word of training count n mixes the filter with the base,
``MIX * level count / n + (1 - MIX) * base``; after unknown words and at the start it is the base, (c + 1) / (N + V + 1).
Level counts are lower bounds, so the mixture adds up to at most 1, but for the filter's false positives (below 0.5 %).

Cases: null text is empty and has the end alone; a corpus without training rows gives the base of an empty table; rows
with a null ``trains`` aren't learned; repeated rows count as often as they occur; of clashing column names the
operator's win; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlark.llm import chunks as C
from postlark.llm import hashing as H

BASE = 2
MIX = 0.5
BITS = 12
PROBES = 8
SEGMENTS = 64
_END = H.constants(9000, 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
RESULT = "id long, n_tokens long, n_known long, base_score double, score double"


class _Tokens:
    """Token hashes of a chunk, document of each, whether it trains, and places of tokens that follow another."""

    def __init__(self, docs: pa.Table):
        data, offsets = C.texts_of(docs)
        n_docs = len(offsets) - 1
        spread = np.full(len(data) + n_docs, 0x20, np.uint8)
        owner = np.repeat(np.arange(n_docs), np.diff(offsets))
        spread[np.arange(len(data)) + owner] = _LOWER[data]
        starts, ends = H.spans(spread)
        words = H.word_hashes(spread, starts, ends)
        self.counts = np.diff(np.append(np.searchsorted(starts, offsets[:-1] + np.arange(n_docs)), len(starts))) + 1
        self.last = np.cumsum(self.counts) - 1
        self.hash = np.empty(len(words) + n_docs, np.uint64)
        end = np.zeros(len(self.hash), bool)
        end[self.last] = True
        self.hash[end], self.hash[~end] = _END[0], words
        self.doc = np.repeat(np.arange(n_docs), self.counts)
        trains = docs.column("c0").to_pylist()
        self.trains = np.array([bool(t) for t in trains], bool)[self.doc] if n_docs else np.empty(0, bool)
        follows = np.ones(len(self.hash), bool)
        follows[self.last - self.counts + 1] = False
        self.second = np.flatnonzero(follows)

    def bigrams(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the bigrams whose second tokens are at these places."""
        a, b = H.constants(8000, 2)
        return H.mixed(self.hash[at - 1] * a + self.hash[at] * b)


def _counted(hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes ascending, the sum of weights of each, and the entry number of each row."""
    keys, number = np.unique(hashes, return_inverse=True)
    return keys, np.bincount(number, weights, len(keys)).astype(np.int64), number


def _letter(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Keys as rows of bytes, then their counts compressed."""
    return struct.pack("<q", len(keys)) + keys.tobytes() + zstandard.compress(counts.astype(np.uint64).tobytes(), 3)


def _opened(letter: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    (n,) = struct.unpack_from("<q", letter)
    keys = np.zeros((n, 8), np.uint8)
    keys[:, :width] = np.frombuffer(letter, np.uint8, n * width, 8).reshape(n, width)
    return keys.view(np.uint64).ravel(), np.frombuffer(zstandard.decompress(letter[8 + n * width :]), np.uint64)


def _letters(chunk: int, hashes: np.ndarray, keys: np.ndarray, counts: np.ndarray, buckets: int) -> dict:
    parts = list(C.split_by_bucket(hashes, buckets))
    return {
        "bucket": pa.array([b for b, _ in parts], pa.int32()),
        "chunk": pa.array([chunk] * len(parts), pa.int64()),
        "body": pa.array([_letter(keys[s], counts[s]) for _, s in parts], pa.binary()),
    }


def _totals(received: list[tuple[int, bytes]]) -> list[bytes]:
    """Total count of every entry, and last the number of distinct tokens with a count and the sum of counts."""
    opened = [_opened(b, 8) for _, b in received]
    keys, totals, number = _counted(np.concatenate([k for k, _ in opened]), np.concatenate([c for _, c in opened]))
    cuts = np.cumsum([len(k) for k, _ in opened])[:-1]
    told = [zstandard.compress(x.astype(np.uint64).tobytes(), 3) for x in np.split(totals[number], cuts)]
    return told + [struct.pack(">qq", int((totals > 0).sum()), int(totals.sum()))]


def levels(counts: np.ndarray) -> np.ndarray:
    """1 for a count of one, then one more for each power of BASE."""
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(BASE) + 1e-9).astype(np.int64)


def _bigram_levels(received: list[tuple[int, bytes]]) -> list[bytes]:
    """Level of every entry, read from a filter that holds all bigrams of the bucket that train."""
    opened = [_opened(b, 6) for _, b in received]
    keys, totals, number = _counted(np.concatenate([k for k, _ in opened]), np.concatenate([c for _, c in opened]))
    trained = totals > 0
    level = levels(totals[trained])
    bits = -(-int(level.sum()) * BITS // 8) * 8
    field = segment_bits(bits, 1, keys[trained], np.zeros(len(level), np.int64), level) if bits else b""
    read = LogFrequencyFilter(bits, 1, 1, {0: field}, 1).levels(keys).astype(np.uint8)
    cuts = np.cumsum([len(k) for k, _ in opened])[:-1]
    return [zstandard.compress(x.tobytes(), 3) for x in np.split(read[number], cuts)]


def _place(keys: np.ndarray, bucket: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of a bigram at a level, from which all probes follow."""
    seed = H.mixed(keys ^ (bucket.astype(np.uint64) << np.uint64(48)) ^ H.constants(9100 + level, 1)[0])
    return seed, H.mixed(seed) | np.uint64(1)


def segment_bits(bits: int, first: int, keys: np.ndarray, buckets: np.ndarray, level: np.ndarray) -> bytes:
    """One segment of the filter: every bigram entered at each level from the first to its own."""
    out = np.zeros(bits, bool)
    for j in range(first, int(level.max(initial=0)) + 1):
        a, b = _place(keys[level >= j], buckets[level >= j], j)
        for k in range(PROBES):
            out[((a + np.uint64(k) * b) % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


class LogFrequencyFilter:
    """The whole filter: a bit field of equal size for each segment of the bucket range."""

    def __init__(self, bits: int, first: int, buckets: int, fields: dict[int, bytes], segments: int = SEGMENTS):
        self.bits, self.first, self.buckets, self.segments = bits, first, buckets, segments
        empty = bytes(bits // 8)
        self.field = np.frombuffer(b"".join(fields.get(s, empty) for s in range(segments)), np.uint8)

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """Least count of each bigram's level; 0 for bigrams not in the filter."""
        return least_counts(self.levels(hashes))

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """Level of each bigram; 0 for bigrams not in the filter."""
        level = np.zeros(len(hashes), np.int64)
        bucket = C.bucket_of(hashes, self.buckets)
        start = segment_of(bucket, self.buckets, self.segments) * self.bits
        keys = hashes & np.uint64((1 << 48) - 1)
        inside, j = np.arange(len(hashes)), self.first
        while len(inside) and self.bits:
            a, b = _place(keys[inside], bucket[inside], j)
            for k in range(PROBES):
                at = start[inside] + ((a + np.uint64(k) * b) % np.uint64(self.bits)).astype(np.int64)
                hit = (self.field[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
                inside, a, b = inside[hit], a[hit], b[hit]
            level[inside] = j
            j += 1
        return level


def least_counts(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, float(BASE) ** (level - 1), 0.0)


def segment_of(bucket: np.ndarray, buckets: int, segments: int = SEGMENTS) -> np.ndarray:
    return bucket * segments // buckets


def lm_scores(docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (log10) of every whole text."""
    held = C.Chunks(docs.withColumn("_trains", F.coalesce(trains, F.lit(False))), id_col, text_col, ["_trains"])
    buckets = held.buckets

    def token_messages(chunk: int, docs: pa.Table, got: dict) -> Iterator[dict]:
        tokens = _Tokens(docs)
        keys, counts, _ = _counted(tokens.hash, tokens.trains)
        yield _letters(chunk, keys, keys, counts, buckets)

    totals = held.ask("tokens", held.map(token_messages, C.MESSAGE), _totals)
    number = lambda at: F.conv(F.hex(F.substring("body", at, 8)), 16, 10).cast("long")
    sums = totals.where("chunk = -1").agg(F.sum(number(1)).alias("v"), F.sum(number(9)).alias("n")).first()
    kinds, length = sums["v"] or 0, sums["n"] or 0

    def bigram_messages(chunk: int, docs: pa.Table, got: dict) -> Iterator[dict]:
        tokens = _Tokens(docs)
        keys, counts, _ = _counted(tokens.bigrams(tokens.second), tokens.trains[tokens.second])
        yield _letters(chunk, keys, C.six_bytes(keys), counts, buckets)

    grams = held.ask("bigrams", held.map(bigram_messages, C.MESSAGE), _bigram_levels)

    def scores(chunk: int, docs: pa.Table, got: dict) -> Iterator[dict]:
        tokens = _Tokens(docs)
        keys, _, number = _counted(tokens.hash, tokens.trains)
        seen = np.zeros(len(keys))
        for b, s in C.split_by_bucket(keys, buckets):
            seen[s] = np.frombuffer(zstandard.decompress(got["tokens"][b]), np.uint64)
        c = seen[number]
        base = (c + 1) / (length + 1 * (kinds + 1))
        full = base.copy()
        at = tokens.second
        context = c[at - 1]
        keys, _, number = _counted(tokens.bigrams(at), np.ones(len(at)))
        level = np.zeros(len(keys), np.int64)
        for b, s in C.split_by_bucket(keys, buckets):
            level[s] = np.frombuffer(zstandard.decompress(got["bigrams"][b]), np.uint8)
        share = np.minimum(least_counts(level)[number] / np.maximum(context, 1), 1.0)
        full[at] = np.where(context > 0, MIX * share + (1 - MIX) * base[at], base[at])
        n = len(tokens.counts)
        yield {
            "id": docs.column("id"),
            "n_tokens": pa.array(tokens.counts, pa.int64()),
            "n_known": pa.array(np.bincount(tokens.doc, c > 0, n).astype(np.int64)),
            "base_score": pa.array(np.bincount(tokens.doc, np.log10(base), n)),
            "score": pa.array(np.bincount(tokens.doc, np.log10(full), n)),
        }

    out = held.map(scores, RESULT, [totals.where("chunk >= 0"), grams])
    return out.withColumn("train_tokens", F.lit(length).cast("long"))
