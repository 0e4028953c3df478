"""Substring dedup by difference-cover anchors.

A window of 13 words is removed from a document if its words also start somewhere in a document with a smaller id.

The residues {0, 1, 3} modulo 7 form a difference cover: for any two places i and j some shift below 7 takes both to a
covered residue. So two equal windows of 13 words hold, at one and the same shift, an *anchor*: 7 words starting at
covered places in both documents. Only anchors, three places of seven, are hashed and compared across the corpus; the
windows around shared anchors are then extended to 13 words and settled by their full hash.

Rounds (see :mod:`postlark.llm.chunks`):

1. *Blocks.* Documents are cut at places chosen by content. A block with the 12 words after it that also lies in a
   document with a smaller id is settled whole. This folds groups of copies, of any size, to one holder per passage; the
   least holder of any window always lies in a block that stays.
2. *Anchors* of the blocks that stay; which ones do two documents hold?
3. *Windows* with a shared anchor: the least document id of each window hash (96 bits).

Cases: null or empty text has no words and keeps the empty string; texts under 13 words stay; equal ids never remove
from each other; a null id counts as larger than all others; repeated rows give repeated results; an empty table gives
an empty result. Results hold ``id``, ``n_words``, ``n_removed``, ``kept_text`` and the carried columns, where an
operator's column wins over a carried one of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from postlark.llm import chunks as C
from postlark.llm import hashing as H

WINDOW = 13
COVER_MODULUS = 7
COVER = (0, 1, 3)
ANCHOR = WINDOW - COVER_MODULUS + 1
BLOCK_WORDS = 64  # a power of two


class _Words:
    """Words of a chunk: hashes, document of each word, place in its document, and which places start a window."""

    def __init__(self, docs: pa.Table):
        data, offsets = C.texts_of(docs)
        self.ids = C.ids_of(docs)
        # Words never run across documents: cut them at document borders.
        space = np.uint8(0x20)
        n_docs = len(offsets) - 1
        spread = np.full(len(data) + n_docs, space, np.uint8)
        lengths = np.diff(offsets)
        spread[np.arange(len(data)) + np.repeat(np.arange(n_docs), lengths)] = data
        starts, ends = H.spans(spread)
        self.hash = H.word_hashes(spread, starts, ends)
        first_byte = offsets[:-1] + np.arange(n_docs)
        self.counts = np.diff(np.append(np.searchsorted(starts, first_byte), len(starts)))
        self.first = np.cumsum(self.counts) - self.counts
        self.doc = np.repeat(np.arange(n_docs), self.counts)
        self.place = np.arange(len(starts)) - self.first[self.doc]
        self.valid = self.place + WINDOW <= self.counts[self.doc]
        self.id = self.ids[self.doc]

    def blocks(self):
        """Start of each block, its digest, and its document's id. A block opens at a document's first window and wherever the hash says."""
        opens = self.valid & ((self.place == 0) | (self.hash & np.uint64(BLOCK_WORDS - 1) == 0))
        starts = np.flatnonzero(opens)
        last_window = self.first + np.maximum(self.counts - WINDOW, 0)
        next_start = np.append(starts[1:], len(self.hash))
        end = np.minimum(next_start, last_window[self.doc[starts]] + 1) if len(starts) else starts
        raw = self.hash.tobytes()
        digests = b"".join(
            hashlib.blake2b(raw[8 * a : 8 * (b + WINDOW - 1)], digest_size=12).digest() for a, b in zip(starts.tolist(), end.tolist())
        )
        parts = np.frombuffer(digests, np.dtype([("h", "<u8"), ("c", "<u4")]))
        return starts, end, (parts["h"].copy(), parts["c"].copy()), self.id[starts]

    def staying(self, buckets: int, bodies: dict) -> tuple[np.ndarray, np.ndarray]:
        """Window starts settled as repeated by their block, and those still to settle."""
        starts, end, digests, ids = self.blocks()
        told = C.repeated_blocks(digests, ids, buckets, bodies)
        repeated = np.zeros(len(self.hash), bool)
        if len(starts):
            inside = np.repeat(told, end - starts)
            at = np.arange(len(inside)) + np.repeat(starts - (np.cumsum(end - starts) - (end - starts)), end - starts)
            repeated[at] = inside
        return repeated, self.valid & ~repeated

    def anchors(self, stays: np.ndarray) -> np.ndarray:
        """Covered places whose anchor lies inside a window to settle."""
        n = len(self.hash) - ANCHOR + 1
        if n <= 0:
            return np.empty(0, np.int64)
        total = np.concatenate(([0], np.cumsum(stays)))
        at = np.flatnonzero(np.isin(self.place[:n] % COVER_MODULUS, COVER))
        return at[total[at + 1] - total[np.maximum(at + ANCHOR - WINDOW, 0)] > 0]

    def candidates(self, stays: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Windows to settle that hold a shared anchor."""
        mark = np.zeros(len(self.hash) + WINDOW, np.int32)
        mark[shared] = 1
        total = np.concatenate(([0], np.cumsum(mark)))
        at = np.flatnonzero(stays)
        return at[total[at + COVER_MODULUS] - total[at] > 0]


def _windows(words: _Words, at: np.ndarray):
    hashes = H.window_hashes(words.hash, WINDOW, 5000, at)
    checks = (H.window_hashes(words.hash, WINDOW, 6000, at) >> np.uint64(32)).astype(np.uint32)
    return C.entries_of(hashes, checks, words.id[at])


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] = (), keep_untouched: bool = False
) -> DataFrame:
    """Remove from each document the words of 13-word windows that a document with a smaller id also holds.

    ``kept_text`` has the kept words joined by one blank; with ``keep_untouched`` a text that loses nothing stays as it is.
    """
    held = C.Chunks(docs, id_col, text_col, carry)
    buckets = held.buckets

    def block_messages(chunk: int, docs: pa.Table, got: dict) -> Iterator[dict]:
        _, _, digests, ids = _Words(docs).blocks()
        entries, _ = C.entries_of(*digests, ids)
        yield C.sent(chunk, entries, entries["hash"], buckets)

    blocks = held.ask("blocks", held.map(block_messages, C.MESSAGE), C.smaller_elsewhere)

    def anchor_messages(chunk: int, docs: pa.Table, got: dict) -> Iterator[dict]:
        words = _Words(docs)
        _, stays = words.staying(buckets, got.get("blocks", {}))
        at = words.anchors(stays)
        hashes, _, _ = C.distinct_anchors(H.window_hashes(words.hash, ANCHOR, 4000, at), words.id[at])
        yield C.sent(chunk, C.six_bytes(hashes), hashes, buckets)

    anchors = held.ask("anchors", held.map(anchor_messages, C.MESSAGE, [blocks]), C.held_twice)

    def settle(docs: pa.Table, got: dict):
        words = _Words(docs)
        repeated, stays = words.staying(buckets, got.get("blocks", {}))
        at = words.anchors(stays)
        hashes, twice, number = C.distinct_anchors(H.window_hashes(words.hash, ANCHOR, 4000, at), words.id[at])
        shared = twice | C.bits_back(hashes, buckets, got.get("anchors", {}))
        return words, repeated, words.candidates(stays, at[shared[number]])

    def window_messages(chunk: int, docs: pa.Table, got: dict) -> Iterator[dict]:
        words, _, at = settle(docs, got)
        entries, _ = _windows(words, at)
        yield C.sent(chunk, entries, entries["hash"], buckets)

    windows = held.ask("windows", held.map(window_messages, C.MESSAGE, [blocks, anchors]), C.smaller_elsewhere)

    own = ["id", "n_words", "n_removed", "kept_text"]
    carried = [(inner, outer, kind) for inner, outer, kind in held.carried if outer not in own]

    def result(chunk: int, docs: pa.Table, got: dict) -> Iterator[dict]:
        words, repeated, at = settle(docs, got)
        entries, number = _windows(words, at)
        found = (words.id[at] > entries["id"][number]) | C.bits_back(entries["hash"], buckets, got.get("windows", {}))[number]
        repeated[at[found]] = True
        gone = C.covered(np.flatnonzero(repeated), WINDOW, len(words.hash))
        total = np.concatenate(([0], np.cumsum(gone)))
        removed = total[words.first + words.counts] - total[words.first]
        texts = []
        for text, a, n, r in zip(docs.column("text").to_pylist(), words.first.tolist(), words.counts.tolist(), removed.tolist()):
            if keep_untouched and not r:
                texts.append(text)
                continue
            parts = (text or "").encode().split()
            if r:
                keep = ~gone[a : a + n]
                parts = [p for p, k in zip(parts, keep.tolist()) if k]
            texts.append(b" ".join(parts).decode())
        yield {
            "id": docs.column("id"),
            "n_words": pa.array(words.counts, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "kept_text": pa.array(texts, pa.string()),
        } | {inner: docs.column(inner) for inner, _, _ in carried}

    fields = [StructField("id", LongType()), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType())]
    schema = StructType(fields + [StructField(inner, kind) for inner, _, kind in carried])
    out = held.map(result, schema, [blocks, anchors, windows])
    return out.select(*own, *[out[inner].alias(outer) for inner, outer, _ in carried])
