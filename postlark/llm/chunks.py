"""Rounds between corpus chunks and hash buckets.

A *chunk* is one row that holds some whole documents as a compressed Arrow stream. Chunks are dealt by their number and
checkpointed once, so later passes read them in place without another shuffle. A pass over chunks sends sorted hash
lists to *buckets*; a bucket sees every entry of its hash range, from all chunks, and answers each chunk with one bit or
number per entry. What moves is a few bytes per hash, already made distinct inside the chunk: a key that fills a third
of the corpus is sent at most once per chunk, and nothing is gathered beyond one bucket of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from postlark.operators.spread import cut, shared_folder
from postlark.shipping import ship

CHUNK_BYTES = 2 << 20
CHUNK_ROWS = 20_000
BUCKET_BYTES = 16 << 20
MIN_BUCKETS = 64
CHUNK = "chunk long, body binary, size long"
MESSAGE = "bucket int, chunk long, body binary"
ANSWER = "chunk long, kind string, bucket int, body binary"
_ZSTD = pa.ipc.IpcWriteOptions(compression="zstd")


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=_ZSTD) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(body)).read_all()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    held: list[pa.RecordBatch] = []
    size = rows = 0

    def row():
        table = pa.Table.from_batches(held).combine_chunks()
        return pa.RecordBatch.from_pydict(
            {"chunk": pa.array([(part << 32) + number], pa.int64()), "body": [packed(table)], "size": pa.array([size], pa.int64())}
        )

    for batch in batches:
        offset = 0
        while offset < batch.num_rows:
            rest = batch.slice(offset)
            total = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(rest.column("text")), 0)))
            take = int(np.searchsorted(total, max(CHUNK_BYTES - size, 1))) + 1
            take = min(take, rest.num_rows, CHUNK_ROWS - rows)
            held.append(rest.slice(0, take))
            size, rows, offset = size + int(total[take - 1]), rows + take, offset + take
            if size >= CHUNK_BYTES or rows >= CHUNK_ROWS:
                yield row()
                held, size, rows, number = [], 0, 0, number + 1
    if held:
        yield row()


class Chunks:
    """The documents of a table as checkpointed chunks, with columns ``id`` and ``text`` first and others after."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] = ()):  # noqa: B006
        spark = docs.sparkSession
        ship(spark)
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(shared_folder(spark))
        rows = docs.select(
            F.col(id_col).cast("long").alias("id"),
            F.col(text_col).cast("string").alias("text"),
            *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)],
        )
        self.carried = [(f"c{i}", c, docs.schema[c].dataType) for i, c in enumerate(carry)]
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # A plan that adapts forgets how its result is dealt; a fixed one keeps it through the checkpoint, so that later
        # passes need no exchange of texts.
        adaptive = spark.conf.get("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            self.rows = rows.mapInArrow(_pack, CHUNK).repartition(parts, "chunk").checkpoint()
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        total = self.rows.agg(F.sum("size")).first()[0] or 0
        self.total_bytes = int(total)
        self.buckets = max(MIN_BUCKETS, int(total // BUCKET_BYTES))

    def map(self, function: Callable[[int, pa.Table, dict], Iterator[dict]], schema: str | StructType, answers: list[DataFrame] = ()) -> DataFrame:
        """``function(chunk, documents, {kind: {bucket: body}})`` of each chunk, with the answers sent back to it."""
        arrow = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)
        if not answers:

            def alone(batches):
                for batch in batches:
                    for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("body")):
                        for part in function(chunk, unpacked(body.as_py()), {}):
                            yield from _table(part, arrow).to_batches()

            return self.rows.select("chunk", "body").mapInArrow(alone, schema)

        def both(left, right):
            got: dict = {}
            for kind, bucket, body in zip(*(right.column(n).to_pylist() for n in ("kind", "bucket", "body"))):
                got.setdefault(kind, {})[bucket] = body
            out = [
                part
                for chunk, body in zip(left.column("chunk").to_pylist(), left.column("body").to_pylist())
                for part in function(chunk, unpacked(body), got)
            ]
            return pa.concat_tables([_table(p, arrow) for p in out]) if out else arrow.empty_table()

        told = answers[0]
        for more in answers[1:]:
            told = told.unionByName(more)
        return self.rows.select("chunk", "body").groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(both, schema)

    def ask(self, kind: str, messages: DataFrame, answer: Callable[[list[tuple[int, bytes]]], list[bytes]]) -> DataFrame:
        """Gather messages by bucket, answer every sender, and write the answers down.

        An answer beyond the last sender's is a summary of the bucket, filed under chunk -1.
        """

        def reply(key, table):
            senders = table.column("chunk").to_pylist()
            order = np.argsort(senders, kind="stable")
            bodies = table.column("body").to_pylist()
            told = answer([(senders[i], bodies[i]) for i in order])
            kept = list(zip([senders[i] for i in order] + [-1], told))
            bucket = key[0].as_py()
            return pa.table(
                {
                    "chunk": pa.array([c for c, _ in kept], pa.int64()),
                    "kind": pa.array([kind] * len(kept), pa.string()),
                    "bucket": pa.array([bucket] * len(kept), pa.int32()),
                    "body": pa.array([b for _, b in kept], pa.binary()),
                }
            )

        return cut(messages.groupBy("bucket").applyInArrow(reply, ANSWER))


def _table(part: dict, arrow: pa.Schema) -> pa.Table:
    return pa.table({n: part[n] for n in arrow.names}).cast(arrow)


def texts_of(docs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All text bytes of a chunk, and the offsets where documents begin and end (null: empty)."""
    column = docs.column("text").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    buffers = column.buffers()
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def ids_of(docs: pa.Table) -> np.ndarray:
    """Document ids; null counts as the largest id, so such a row is never the first holder of anything."""
    return np.asarray(pc.fill_null(docs.column("id"), np.iinfo(np.int64).max)).astype(np.int64)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort order of keys, start of each run of equal keys in that order, and each row's run number."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(keys) else np.empty(0, bool)
    run = np.empty(len(keys), np.int64)
    run[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), run


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket from the high half of a hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def split_by_bucket(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Slices of ascending hashes that belong to each bucket that has some."""
    which = bucket_of(hashes, buckets)
    if len(which):
        starts = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1])))
        for a, b in zip(starts, [*starts[1:], len(which)]):
            yield int(which[a]), slice(int(a), int(b))


def smaller_elsewhere(received: list[tuple[int, bytes]]) -> list[bytes]:
    """Entries (hash 8, check 4, least id 8 bytes). Answer: a bit for each, set if some chunk has it under a smaller id."""
    parts = [np.frombuffer(b, ENTRY) for _, b in received]
    entries = np.concatenate(parts)
    order = np.lexsort((entries["check"], entries["hash"]))
    h, c = entries["hash"][order], entries["check"][order]
    starts = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1]))))
    least = np.minimum.reduceat(entries["id"][order], starts)
    bit = np.empty(len(entries), bool)
    bit[order] = np.repeat(least, np.diff(np.append(starts, len(entries)))) < entries["id"][order]
    return [np.packbits(x).tobytes() for x in np.split(bit, np.cumsum([len(p) for p in parts])[:-1])]


ENTRY = np.dtype([("hash", "<u8"), ("check", "<u4"), ("id", "<i8")])


def entries_of(hashes: np.ndarray, checks: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, check) with the least id, in ascending order, and the entry number of each input row."""
    order = np.lexsort((checks, hashes))
    h, c = hashes[order], checks[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1]))) if len(h) else np.empty(0, bool)
    starts = np.flatnonzero(new)
    out = np.empty(len(starts), ENTRY)
    out["hash"], out["check"] = h[starts], c[starts]
    out["id"] = np.minimum.reduceat(ids[order], starts) if len(starts) else 0
    number = np.empty(len(hashes), np.int64)
    number[order] = np.cumsum(new) - 1
    return out, number


def sent(chunk: int, entries: np.ndarray, hashes: np.ndarray, buckets: int) -> dict:
    """Message rows of a chunk's ascending entries."""
    parts = list(split_by_bucket(hashes, buckets))
    return {
        "bucket": pa.array([b for b, _ in parts], pa.int32()),
        "chunk": pa.array([chunk] * len(parts), pa.int64()),
        "body": pa.array([entries[s].tobytes() for _, s in parts], pa.binary()),
    }


def bits_back(hashes: np.ndarray, buckets: int, bodies: dict[int, bytes], facts: int = 1) -> np.ndarray:
    """The answers' bits in the order of the entries sent; one row of bits per fact, or the only one."""
    out = np.zeros((facts, len(hashes)), bool)
    for b, s in split_by_bucket(hashes, buckets):
        n = s.stop - s.start
        out[:, s] = np.unpackbits(np.frombuffer(bodies[b], np.uint8), count=facts * n).astype(bool).reshape(facts, n)
    return out[0] if facts == 1 else out


def repeated_blocks(digests: tuple[np.ndarray, np.ndarray], ids: np.ndarray, buckets: int, bodies: dict[int, bytes]) -> np.ndarray:
    """For each block: whether its content also lies in a document with a smaller id."""
    entries, number = entries_of(*digests, ids)
    answer = bits_back(entries["hash"], buckets, bodies)
    return (ids > entries["id"][number]) | answer[number]


def six_bytes(hashes: np.ndarray) -> np.ndarray:
    """The low 48 bits of each hash, as rows of six bytes: enough to look for candidates."""
    return np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, :6]


def held_twice(received: list[tuple[int, bytes]], many: int | None = None) -> list[bytes]:
    """Entries of six bytes, distinct in each chunk. Answer: a bit for each, set if two chunks or more sent it.

    With ``many``, a second bit for each tells whether more than so many chunks did.
    """
    parts = [np.frombuffer(b, np.uint8).reshape(-1, 6) for _, b in received]
    wide = np.zeros((sum(map(len, parts)), 8), np.uint8)
    wide[:, :6] = np.concatenate(parts)
    order, starts, run = grouped(wide.view(np.uint64).ravel())
    senders = np.diff(np.append(starts, len(order)))[run]
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    facts = [senders > limit for limit in ((1,) if many is None else (1, many))]
    return [np.packbits(np.concatenate(x)).tobytes() for x in zip(*(np.split(f, cuts) for f in facts))]


def distinct_anchors(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes ascending, whether two documents of the chunk hold each, and each row's entry number."""
    order, starts, run = grouped(hashes)
    if not len(hashes):
        return hashes, np.empty(0, bool), run
    held = ids[order]
    twice = np.minimum.reduceat(held, starts) != np.maximum.reduceat(held, starts)
    return hashes[order][starts], twice, run


def covered(marks: np.ndarray, width: int, total: int) -> np.ndarray:
    """Places covered by the windows of ``width`` that start at the (distinct) marks."""
    step = np.zeros(total + 1, np.int32)
    step[marks] += 1
    step[marks + width] -= 1
    return np.cumsum(step[:-1]) > 0
