"""Merkle manifest of a table: a leaf per row, a tree per group, one root over the groups.

Leaves stand in the order of their ids inside a group, and nothing is sorted for it. The ids of a group are a bitmap whose
words of 64 ids are merged with ``bit_or`` inside each task before they meet; empty words aren't stored. Over the words
stands a directory of popcounts: running sums among at most ``2 ** FAN`` siblings at each level, so no window ever holds
more, however many ids a group has. A leaf's slot is a rank query: the directory's count before its word, plus the bits
below its own. Slots key the arrays that reduce the tree: one array of ``ARITY ** depth`` slots becomes one node, and the
nodes of all arrays are the slots of the next tier, until each group has one. The groups' nodes, in the order of their
names, are the slots of a last tree.

Proofs go down the same tiers: an array gets the siblings on the way from its node to the root, and hands each slot its
own. A document's proof is the digest of all siblings of its path; ``folded_root`` climbs the path again from the leaf
given for checking.

Cases: ids that repeat inside a group share a bit; their rows are ordered by leaf, equal leaves in any order, and the
count beyond the bit is kept with the word. Null ids come first, null groups likewise. Null texts are part of the leaf as
``-``. One group, id or row may own a third of the table: counts are combined inside tasks, joins are plain ones that
Spark splits, arrays have a bounded number of slots. Long texts are hashed by Spark as they stand. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlark.operators.spread import cut, dense_rank_of, numbered, sequenced
from postlark.shipping import ship

ARITY = 8
DEPTH = 4
WORD = 6
FAN = 12
ARRAY = "grp long, block long, size long, body binary, top string"
ABOVE = "grp long, block long, above array<string>"
RESULT = "doc_id long, grp long, leaf string, root string, proof_sha256 string, folded_root string"


def digest(columns: list[Column]) -> Column:
    """SHA-256 of the values, each as ``-`` if null, else as its number of UTF-8 bytes, a colon and itself."""
    parts = [c.cast("string") for c in columns]
    told = [F.when(p.isNull(), "-").otherwise(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p)) for p in parts]
    return F.sha2(F.concat(*told).cast("binary"), 256)


# Bitmaps, popcount directory, rank queries


def starts(counts: DataFrame, low: int, high: int) -> DataFrame:
    """``(grp, key, start)``: the number of ids of the group before each word, of ``(grp, key, n)`` with keys low to high."""
    last = high - low < 1 << FAN
    before = Window.partitionBy("grp", "up").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    level = counts.withColumn("up", F.lit(0) if last else F.shiftright("key", FAN))
    inside = level.select("grp", "key", "up", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("inside"))
    if last:
        return inside.select("grp", "key", F.col("inside").alias("start"))
    above = starts(level.groupBy("grp", F.col("up").alias("key")).agg(F.sum("n").alias("n")), low >> FAN, high >> FAN)
    above = above.select("grp", F.col("key").alias("up"), F.col("start").alias("outside"))
    return inside.join(above, ["grp", "up"]).select("grp", "key", (F.col("inside") + F.col("outside")).alias("start"))


def ranked(rows: DataFrame) -> DataFrame:
    """Add ``slot``, the 0-based place by id in the group, to rows ``(row, grp, id, leaf, ...)`` with unique ``row``."""
    low = F.col("id").bitwiseAND(F.lit((1 << WORD) - 1)).cast("int")
    keyed = rows.withColumn("key", F.shiftright("id", WORD)).withColumn("bit", F.call_function("shiftleft", F.lit(1).cast("long"), low))
    below = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), low))
    words = cut(keyed.where("id is not null").groupBy("grp", "key").agg(F.bit_or("bit").alias("bits"), F.count("*").alias("n")))
    facts = words.agg(F.min("key").alias("low"), F.max("key").alias("high"), F.max(F.col("n") > F.bit_count("bits")).alias("tied")).first()
    nulls = rows.where("id is null").groupBy("grp").agg(F.count("*").alias("nulls"))
    if facts["low"] is None:
        slots = keyed.select(*rows.columns, F.lit(0).cast("long").alias("slot"), F.lit(True).alias("tie"))
        return _spread_ties(cut(slots))
    directory = words.join(starts(words.select("grp", "key", "n"), facts["low"], facts["high"]), ["grp", "key"])
    directory = directory.join(nulls, "grp", "left").withColumn("start", F.col("start") + F.coalesce("nulls", F.lit(0)))
    if facts["tied"]:
        crowded = words.where(F.col("n") > F.bit_count("bits")).select("grp", "key")
        extra = keyed.where("id is not null").join(crowded, ["grp", "key"], "left_semi").groupBy("grp", "key", "bit").agg(F.count("*").alias("n"))
        extra = extra.where("n > 1").groupBy("grp", "key").agg(F.collect_list(F.struct("bit", (F.col("n") - 1).alias("more"))).alias("extra"))
        directory = directory.join(extra, ["grp", "key"], "left")
    else:
        directory = directory.withColumn("extra", F.lit(None).cast("array<struct<bit:bigint,more:bigint>>"))
    directory = cut(directory.select("grp", "key", "bits", "start", "extra"))
    lower = F.filter("extra", lambda e: e["bit"].bitwiseAND(below) != 0)
    place = F.col("start") + F.bit_count(F.col("bits").bitwiseAND(below))
    place = place + F.coalesce(F.aggregate(lower, F.lit(0).cast("long"), lambda a, e: a + e["more"]), F.lit(0))
    tie = F.coalesce(F.exists("extra", lambda e: e["bit"] == F.col("bit")), F.lit(False)) | F.col("id").isNull()
    slots = keyed.join(directory, ["grp", "key"], "left").select(*rows.columns, F.coalesce(place, F.lit(0)).alias("slot"), tie.alias("tie"))
    slots = cut(slots)
    any_tie = facts["tied"] or nulls.limit(1).count()
    return _spread_ties(slots) if any_tie else slots.drop("tie")


def _spread_ties(slots: DataFrame) -> DataFrame:
    """Rows of one id share the first slot; deal them over the slots after it, by leaf."""
    tied = sequenced(slots.where("tie").select("row", "grp", "id", "leaf"), ["grp", "id", "leaf", "row"], "seq")
    placed = cut(dense_rank_of(tied, "seq", "place"))
    first = placed.groupBy("grp", "id").agg(F.min("place").alias("first"))
    apart = placed.alias("p").join(first.alias("f"), F.col("p.grp").eqNullSafe(F.col("f.grp")) & F.col("p.id").eqNullSafe(F.col("f.id")))
    apart = cut(apart.select("row", (F.col("place") - F.col("first")).alias("after")))
    names = [c for c in slots.columns if c not in ("slot", "tie")]
    return slots.join(apart, "row", "left").select(*names, (F.col("slot") + F.coalesce("after", F.lit(0))).alias("slot"))


# Slot arrays


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _levels(nodes: list[str], last: bool, depth: int) -> list[list[str]]:
    """All levels of one array, from its slots up: ``depth`` levels, or, for a group's only array, until one node is left."""
    out = [nodes]
    while len(out[-1]) > 1 if last else len(out) <= depth:
        below = out[-1]
        out.append([_hash("".join(below[a : a + ARITY])) for a in range(0, len(below), ARITY)])
    return out


def _paths(levels: list[list[str]], above: list[str]) -> list[list[list[str]]]:
    """For each level but the top, the siblings of every node up to the root: left, right, left, right, ..."""
    out = [[above]]
    for nodes in reversed(levels[:-1]):
        upper = out[-1]
        out.append(
            [
                ["".join(nodes[k - k % ARITY : k]), "".join(nodes[k + 1 : k - k % ARITY + ARITY]), *upper[k // ARITY]]
                for k in range(len(nodes))
            ]
        )
    return out[::-1]


def _fold(node: str, path: list[str]) -> str:
    for left, right in zip(path[0::2], path[1::2]):
        node = _hash(left + node + right)
    return node


def arrays(slots: DataFrame, depth: int) -> DataFrame:
    """Slot arrays with their nodes, of ``(grp, size, slot, digest, ...)``; size is the group's number of slots."""
    size = ARITY**depth
    kept = [c for c in slots.columns if c not in ("grp", "size")]

    def pack(key, table):
        table = table.sort_by("slot")
        count = table.column("size")[0].as_py()
        top = _levels(table.column("digest").to_pylist(), count <= size, depth)[-1][0]
        sink = pa.BufferOutputStream()
        held = table.select(kept)
        with pa.ipc.new_stream(sink, held.schema) as out:
            out.write_table(held)
        return pa.table(
            {"grp": [key[0].as_py()], "block": [key[1].as_py()], "size": [count], "body": [sink.getvalue().to_pybytes()], "top": [top]},
            pa.schema([("grp", pa.int64()), ("block", pa.int64()), ("size", pa.int64()), ("body", pa.binary()), ("top", pa.string())]),
        )

    bits = (size - 1).bit_length()
    return cut(slots.withColumn("block", F.shiftright("slot", bits)).groupBy("grp", "block").applyInArrow(pack, ARRAY))


def _unpacked(row: dict, depth: int) -> tuple[pa.Table, list[list[str]]]:
    table = pa.ipc.open_stream(row["body"]).read_all()
    return table, _levels(table.column("digest").to_pylist(), row["size"] <= ARITY**depth, depth)


def tiers(slots: DataFrame, sizes: int, depth: int) -> list[DataFrame]:
    """Arrays of all tiers; ``sizes`` is the greatest number of slots of a group."""
    out, size = [arrays(slots, depth)], ARITY**depth
    while sizes > size:
        sizes = -(-sizes // size)
        tops = out[-1].where(F.col("size") > size)
        smaller = F.ceil(F.col("size") / size).cast("long")
        out.append(arrays(tops.select("grp", smaller.alias("size"), F.col("block").alias("slot"), F.col("top").alias("digest")), depth))
    return out


def tops(levels: list[DataFrame], depth: int) -> DataFrame:
    """``(grp, top)``: each group's last node."""
    ends = [t.where(F.col("size") <= ARITY**depth).select("grp", "top") for t in levels]
    out = ends[0]
    for more in ends[1:]:
        out = out.unionByName(more)
    return out


def handed_down(level: DataFrame, above: DataFrame, depth: int) -> DataFrame:
    """``(grp, block, above)`` for the arrays one tier below, from the siblings above each array of this tier."""

    def hand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                table, nodes = _unpacked(row, depth)
                slots = table.column("slot").to_pylist()
                paths = _paths(nodes, row["above"])[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["grp"]] * len(slots), pa.int64()), pa.array(slots, pa.int64()), pa.array(paths, pa.list_(pa.string()))], ["grp", "block", "above"]
                )

    return level.join(above, ["grp", "block"]).mapInArrow(hand, ABOVE)


def proofs(level: DataFrame, above: DataFrame, depth: int) -> DataFrame:
    """A row per leaf of the lowest tier, whose arrays hold ``id``, ``digest`` and ``checked``."""

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                table, nodes = _unpacked(row, depth)
                paths = _paths(nodes, row["above"])[0]
                leaves, checked = table.column("digest").to_pylist(), table.column("checked").to_pylist()
                n = len(leaves)
                yield pa.RecordBatch.from_arrays(
                    [
                        table.column("id").combine_chunks().cast(pa.int64()),
                        pa.array([row["grp"]] * n, pa.int64()),
                        pa.array(leaves),
                        pa.array([_fold(leaves[0], paths[0])] * n),
                        pa.array([_hash("".join(p)) for p in paths]),
                        pa.array([_fold(leaf if given is None else given, p) for leaf, given, p in zip(leaves, checked, paths)]),
                    ],
                    ["doc_id", "grp", "leaf", "root", "proof_sha256", "folded_root"],
                )

    return level.join(above, ["grp", "block"]).mapInArrow(prove, RESULT)


def manifest(docs: DataFrame, group: str, id_col: str, leaf: Column, checked: Column, depth: int = DEPTH) -> DataFrame:
    """``doc_id``, ``grp`` (the group's number), ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    ``leaf`` is each row's digest; ``checked`` the digest given for checking, null where it is the leaf itself.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(group).alias("named"), F.col(id_col).cast("long").alias("id"), leaf.alias("leaf"), checked.alias("checked"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    groups = cut(numbered(rows.groupBy("named").agg(F.count("*").alias("size")), ["named"], "grp"))
    facts = groups.agg(F.max("size"), F.count("*")).first()
    largest, count = facts[0] or 0, facts[1]
    keyed = rows.join(groups.withColumnRenamed("named", "same"), F.col("named").eqNullSafe(F.col("same"))).drop("named", "same")
    slots = ranked(keyed).withColumnRenamed("leaf", "digest")
    lower = tiers(slots.select("grp", "size", "slot", "id", "digest", "checked"), largest, depth)
    subroots = cut(tops(lower, depth))
    upper = tiers(subroots.select(F.lit(0).cast("long").alias("grp"), F.lit(count).cast("long").alias("size"), (F.col("grp") - 1).alias("slot"), F.col("top").alias("digest")), count, depth)
    none = F.array().cast("array<string>").alias("above")
    ends = lambda level: level.where(F.col("size") <= ARITY**depth)
    above = ends(upper[-1]).select("grp", "block", none)
    for level in reversed(upper):
        above = cut(handed_down(level, above, depth))
    for number in range(len(lower) - 1, -1, -1):
        # A group's siblings above its last node come from the tree of groups; those of its other arrays from the tier above.
        at_end = ends(lower[number]).select("grp", "block")
        if number == len(lower) - 1:
            own, over = above.select(F.col("block").alias("of"), "above"), None
        else:
            over = handed_down(lower[number + 1], over_next, depth)
        mine = at_end.join(own, F.col("grp") + F.lit(-1) == F.col("of")).select("grp", "block", "above")
        over_next = cut(mine if over is None else mine.unionByName(over))
    done = proofs(lower[0], over_next, depth).join(subroots.withColumnRenamed("top", "subroot"), "grp")
    columns = ["doc_id", "grp", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    return done.select(*columns, (F.col("folded_root") == F.col("root")).alias("verified"))
