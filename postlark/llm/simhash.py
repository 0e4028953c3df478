"""SimHash near-dedup with a byte-position inverted index and count filtering.

A text's fingerprint holds a bit where over half of its shingles' XXH64 values do. Two fingerprints within ``DISTANCE``
bits agree in at least 8 - ``DISTANCE`` of their 8 bytes by position. The inverted index posts every *distinct*
fingerprint under each choice of 8 - ``DISTANCE`` byte positions with their values: a close pair meets in a list, and as
only ``DISTANCE`` bytes are free there, no list holds more than 256 ** ``DISTANCE`` fingerprints, however many documents
there are. For a pair that meets, the shared positional bytes are tallied, pairs below the guaranteed minimum dropped, and
the differing bits counted. A pair that meets in several lists is kept in the first of them only. Short lists compare
neighbours, long ones probe the few patterns a close fingerprint can have, so no list expands into all its pairs.

Copies share a fingerprint and enter the index once. Links join fingerprints; components are found by stars over tables.

Cases: null, empty and blank texts have fingerprint zero and link like any other; fewer words than a shingle give one
shingle of all words; a null id takes part but is never a component's id (null if there is no other); repeated rows give
repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlark.llm.components import components
from postlark.operators.spread import cut
from postlark.shipping import ship

SHINGLE = 3
DISTANCE = 2
SEED = 42
SLAB = 1 << 16
NEIGHBOURS = 64


def fingerprint_rows(batches: Iterator[pa.RecordBatch], shingle: int = SHINGLE) -> Iterator[pa.RecordBatch]:
    """``(id, fingerprint)`` of ``(id, text)``; counts are added up in slabs, so a long text needs no more memory."""
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        texts = batch.column("text").to_pylist()
        ones, shingles = np.zeros((len(texts), 64), np.int32), np.zeros(len(texts), np.int64)
        held: list[int] = []
        owners: list[int] = []
        cuts: list[int] = []

        def count():
            if held:
                bits = np.unpackbits(np.array(held, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                np.add.at(ones, owners, np.add.reduceat(bits, cuts, axis=0, dtype=np.int32))
                held.clear(), owners.clear(), cuts.clear()

        for k, text in enumerate(texts):
            words = (text or "").encode().lower().split()
            if not words:
                continue
            n = max(len(words) - shingle + 1, 1)
            shingles[k] = n
            for a in range(0, n, SLAB):
                part = words[a : a + SLAB + shingle - 1]
                values = (
                    [digest(b" ".join(x), SEED) for x in zip(*(part[j:] for j in range(shingle)))]
                    if len(words) >= shingle
                    else [digest(b" ".join(words), SEED)]
                )
                owners.append(k)
                cuts.append(len(held))
                held.extend(values)
                if len(held) >= SLAB:
                    count()
        count()
        bits = (2 * ones > shingles[:, None]).astype(np.uint8)
        prints = np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints, pa.int64())], ["id", "fingerprint"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: fingerprint_rows(batches, shingle), "id long, fingerprint long")


def _free(distance: int) -> list[int]:
    """The free bytes of each list kind, as masks of bits; kinds in a fixed order."""
    return [sum(0xFF << (8 * p) for p in places) for places in combinations(range(8), distance)]


def _close(lists: np.ndarray, prints: np.ndarray, kinds: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Close pairs of rows in the same list, from rows sorted by list and fingerprint, each pair in its first kind only."""
    free = np.array(_free(distance), np.uint64)
    first, second = [], []
    sizes = np.bincount(lists)[lists]
    short = np.flatnonzero(sizes <= NEIGHBOURS)
    for step in range(1, NEIGHBOURS):
        a, b = short[:-step], short[step:]
        met = lists[a] == lists[b]
        if not met.any():
            break
        first.append(a[met])
        second.append(b[met])
    for group in np.unique(lists[sizes > NEIGHBOURS]):
        lo, hi = np.searchsorted(lists, [group, group + 1])
        own = prints[lo:hi]
        bits = [np.uint64(1 << b) for b in range(64) if int(free[kinds[lo]]) >> b & 1]
        patterns = [sum(c) for d in range(1, distance + 1) for c in combinations([int(b) for b in bits], d)]
        for pattern in patterns:
            probe = own ^ np.uint64(pattern)
            at = np.minimum(np.searchsorted(own, probe), len(own) - 1)
            hit = np.flatnonzero((own[at] == probe) & (own < probe))
            first.append(lo + hit)
            second.append(lo + at[hit])
    if not first:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = np.concatenate(first), np.concatenate(second)
    differ = prints[a] ^ prints[b]
    tally = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    keep = (tally >= 8 - distance) & (np.bitwise_count(differ) <= distance)
    a, b, differ = a[keep], b[keep], differ[keep]
    earliest = np.argmax((differ[:, None] & ~free[None, :]) == 0, axis=1) if len(a) else np.empty(0, np.int64)
    mine = earliest == kinds[a]
    return a[mine], b[mine]


def link_rows(batches: Iterator[pa.RecordBatch], distance: int = DISTANCE) -> Iterator[pa.RecordBatch]:
    """Links ``(u, v)`` from postings ``(kind, shared, fingerprint)`` sorted by all three."""
    held = None
    for batch in batches:
        rows = [np.asarray(batch.column(n)).astype(t) for n, t in (("kind", np.int64), ("shared", np.int64), ("fingerprint", np.int64))]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        if not len(rows[0]):
            continue
        new = np.concatenate(([True], (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)))
        last = np.flatnonzero(new)[-1]  # the last list may go on in the next batch
        held = [x[last:] for x in rows]
        yield from _linked([x[:last] for x in rows], new[:last], distance)
    if held is not None:
        new = np.zeros(len(held[0]), bool)
        new[0] = True
        yield from _linked(held, new, distance)


def _linked(rows: list[np.ndarray], new: np.ndarray, distance: int) -> Iterator[pa.RecordBatch]:
    if len(new) < 2:
        return
    several = ~(new & np.concatenate((new[1:], [True])))
    lists = (np.cumsum(new) - 1)[several]
    kinds, prints = rows[0][several], rows[2][several].view(np.uint64)
    order = np.lexsort((prints, lists))
    prints = prints[order]
    a, b = _close(np.unique(lists, return_inverse=True)[1], prints, kinds, distance)
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(prints[a].view(np.int64)), pa.array(prints[b].view(np.int64))], ["u", "v"])


def links(classes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs of distinct fingerprints within ``distance`` bits, each once."""
    kinds = [
        F.struct(F.lit(k).alias("kind"), F.col("fingerprint").bitwiseAND(F.lit(_signed(~mask & (1 << 64) - 1))).alias("shared"), "fingerprint")
        for k, mask in enumerate(_free(distance))
    ]
    postings = classes.select(F.inline(F.array(*kinds)))
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = postings.repartition(parts, "kind", "shared").sortWithinPartitions("kind", "shared")
    return dealt.mapInArrow(lambda batches: link_rows(batches, distance), "u long, v long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``id``, ``fingerprint`` and ``component_id``, the least id among all documents reachable over links."""
    prints = cut(fingerprints(docs, id_col, text_col, shingle))
    classes = cut(prints.groupBy("fingerprint").agg(F.min("id").alias("least")))
    stars = components(links(classes, distance))
    rooted = classes.join(stars.withColumnRenamed("u", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "least", F.coalesce("v", "fingerprint").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    reached = rooted.join(named, "root").select("fingerprint", "component_id")
    return prints.join(reached, "fingerprint").select("id", "fingerprint", "component_id")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The document with the least id of each group; rows without an id stay."""
    groups = simhash_groups(docs, id_col, text_col, shingle, distance)
    gone = groups.where("id <> component_id").select("id").distinct()
    return docs.join(gone, docs[id_col] == gone["id"], "left_anti")
