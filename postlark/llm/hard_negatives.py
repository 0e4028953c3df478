"""Hard-negative mining with a multiway hyperplane tree of the GNAT kind.

A node of the tree holds split points, and a row belongs to the child whose split point is nearest. The tree's points are
chosen from a sample of ``SAMPLE`` rows, farthest first, but every row is put into a leaf, and each node knows from all rows the least and
the greatest distance between each of its split points and the rows below each child. An anchor's distances to the split
points then bound its distance to all rows of a child, and with the lengths of the vectors its score with them:
a child is passed over if these bounds miss the anchor's window, or can't reach the best rows found so far. What remains is
scored exactly, in integers.

Leaves are cut into chunks of about ``CHUNK`` rows by a hash, anchors into blocks of neighbouring leaves. A task scores a block against
``TOGETHER`` chunks and gives at most the wanted number of rows for each anchor; Spark merges them. Two passes are made: the
nearest rows of the same label, then, inside the windows these open, the nearest rows of other labels.

Cases: rows with a null label, a null vector, or a null or non-finite component take no part; shorter vectors count as ending
in zeros, components are held within ``LARGEST``, so that no score overflows; ties go to the smaller id, null ids last; repeated rows are different rows;
a null id is never an anchor; labels and copies of any frequency share the same chunks, so no group is gathered; a table
without anchors or positives gives an empty result; other columns are ignored. There is no text in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlark.llm.vectors import distances, farthest_first, lists, matrix, read, sampled, stored, whole
from postlark.operators.spread import cut
from postlark.shipping import ship

FANOUT = 16
SAMPLE = 8192
CHUNK = 4096
ANCHORS = 2048
TOGETHER = 8
MAX_LEAVES = 2048
SLAB = 1 << 21
LARGEST = 1 << 26
CHUNKS = "leaf int, chunk long, body binary, low array<double>, high array<double>"
BLOCKS = "block long, body binary"
FOUND = "arow long, place int, score long, id long, row long"


@dataclass
class Tree:
    """Split points of each node; ``paths`` names the (node, child) steps to each leaf."""

    points: list[np.ndarray] = field(default_factory=list)
    children: list[list[tuple[str, int]]] = field(default_factory=list)
    paths: list[list[tuple[int, int]]] = field(default_factory=list)
    low: dict[int, np.ndarray] = field(default_factory=dict)
    high: dict[int, np.ndarray] = field(default_factory=dict)

    def grow(self, sample: np.ndarray, weight: float, chunk: int, path: list[tuple[int, int]]) -> tuple[str, int]:
        splits = len(sample) * weight > chunk and len(sample) >= 4 * FANOUT and len(self.paths) < MAX_LEAVES
        points = farthest_first(sample, FANOUT) if splits else sample[:0]
        if len(points) < 2:
            self.paths.append(path)
            return "leaf", len(self.paths) - 1
        node = len(self.points)
        self.points.append(points)
        self.children.append([])
        near = distances(sample, points).argmin(axis=1)
        for j in range(len(points)):
            self.children[node].append(self.grow(sample[near == j], weight, chunk, [*path, (node, j)]))
        return "node", node

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        out = np.zeros(len(vectors), np.int32)
        work = [(0, np.arange(len(vectors)))] if self.points else []
        while work:
            node, rows = work.pop()
            near = distances(vectors[rows], self.points[node]).argmin(axis=1)
            for j, (kind, number) in enumerate(self.children[node]):
                if kind == "leaf":
                    out[rows[near == j]] = number
                elif (near == j).any():
                    work.append((number, rows[near == j]))
        return out

    def ranges(self, leaf: int, vectors: np.ndarray) -> tuple[list[float], list[float]]:
        """Least and greatest distance of a leaf's vectors to each split point on its path, then of their lengths."""
        columns = [distances(vectors, self.points[node]) for node, _ in self.paths[leaf]]
        columns.append(np.linalg.norm(vectors, axis=1)[:, None])
        held = np.concatenate(columns, axis=1)
        return held.min(axis=0).tolist(), held.max(axis=0).tolist()

    def bounds(self, anchors: np.ndarray, leaves: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score each anchor can have with the rows of each leaf."""
        square = (anchors * anchors).sum(axis=1)
        length = np.sqrt(square)
        to: dict[int, np.ndarray] = {}
        least, most = np.empty((len(anchors), len(leaves))), np.empty((len(anchors), len(leaves)))
        for at, leaf in enumerate(leaves):
            low, high = self.low[leaf], self.high[leaf]
            near, far, first = np.zeros(len(anchors)), np.full(len(anchors), np.inf), 0
            for node, _ in self.paths[leaf]:
                if node not in to:
                    to[node] = distances(anchors, self.points[node])
                lo, hi = low[first : first + to[node].shape[1]], high[first : first + to[node].shape[1]]
                first += to[node].shape[1]
                near = np.maximum(near, np.maximum(to[node] - hi, lo - to[node]).max(axis=1))
                far = np.minimum(far, (to[node] + hi).min(axis=1))
            near, far = near * (1 - 1e-9) - 1e-3, far * (1 + 1e-9) + 1e-3
            slack = 1e-6 * (square + high[-1] ** 2) + 1
            most[:, at] = np.minimum((square + high[-1] ** 2 - np.maximum(near, 0) ** 2) / 2, length * high[-1]) + slack
            least[:, at] = np.maximum((square + low[-1] ** 2 - far**2) / 2, -length * high[-1]) - slack
        return least, most


class _Best:
    """The best rows found for each anchor and place, by score and then by id."""

    def __init__(self, anchors: int, places: int, wanted: int):
        self.score = np.full((anchors, places, wanted), _NONE)
        self.id = np.full((anchors, places, wanted), _LAST)
        self.row = np.full((anchors, places, wanted), _LAST)

    def add(self, which: np.ndarray, place: int, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        parts = [np.concatenate([old[which, place], new], axis=1) for old, new in ((self.score, score), (self.id, ids), (self.row, rows))]
        order = np.lexsort((parts[2], parts[1], -parts[0]))[:, : self.score.shape[2]]
        self.score[which, place], self.id[which, place], self.row[which, place] = (np.take_along_axis(p, order, axis=1) for p in parts)


_NONE = -(1 << 62)
_LAST = np.iinfo(np.int64).max


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    if a.size and b.size and a.shape[1] * np.abs(a).max() * np.abs(b).max() < 1 << 53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _search(tree: Tree, dim: int, block: dict, chunks: list[tuple[int, dict]], windows: bool, wanted: int, low: int, high: int) -> dict:
    """Best rows of some chunks for a block of anchors, each chunk only for the anchors it can matter to."""
    anchors = block["v"].reshape(-1, dim)
    leaves = sorted({leaf for leaf, _ in chunks})
    least, most = tree.bounds(anchors, leaves)
    if windows:
        opened = block["positive"].reshape(len(anchors), -1)
        there = opened != _NONE
        floor, roof = -((-low * np.where(there, opened, 0)) // 100), (high * np.where(there, opened, 0)) // 100
        there &= floor <= roof
    else:
        there = np.ones((len(anchors), 1), bool)
        floor, roof = np.full((len(anchors), 1), _NONE), np.full((len(anchors), 1), -_NONE)
    best = _Best(len(anchors), there.shape[1], wanted)
    chunks = sorted(chunks, key=lambda c: -most[:, leaves.index(c[0])].max(initial=0))
    for leaf, held in chunks:
        at = leaves.index(leaf)
        vectors = held["v"].reshape(-1, dim)
        for a in range(0, len(anchors), max(1, SLAB // max(len(vectors), 1))):
            part = np.arange(a, min(a + max(1, SLAB // max(len(vectors), 1)), len(anchors)))
            live = there[part] & (most[part, at, None] >= np.maximum(floor[part], best.score[part, :, -1])) & (least[part, at, None] <= roof[part])
            part, live = part[live.any(axis=1)], live[live.any(axis=1)]
            if not len(part):
                continue
            score = _scores(anchors[part], vectors)
            same = block["label"][part][:, None] == held["label"]
            score[same if windows else ~same] = _NONE
            if not windows:
                score[block["row"][part][:, None] == held["row"]] = _NONE
            for place in range(there.shape[1]):
                rows = np.flatnonzero(live[:, place])
                if not len(rows):
                    continue
                inside = score[rows]
                if windows:
                    inside[(inside < floor[part[rows], place, None]) | (inside > roof[part[rows], place, None])] = _NONE
                top = np.empty((len(rows), min(wanted, len(vectors))), np.int64)
                value = np.empty_like(top)
                for k in range(top.shape[1]):  # rows stand by id, and argmax takes the first of equals
                    top[:, k] = inside.argmax(axis=1)
                    value[:, k] = inside[np.arange(len(rows)), top[:, k]]
                    inside[np.arange(len(rows)), top[:, k]] = _NONE
                best.add(part[rows], place, value, held["id"][top], held["row"][top])
    anchor, place, k = np.nonzero(best.score > _NONE)
    return {
        "arow": block["row"][anchor],
        "place": place.astype(np.int32),
        "score": best.score[anchor, place, k],
        "id": best.id[anchor, place, k],
        "row": best.row[anchor, place, k],
    }


class Index:
    """The tree over all rows ``(row, id, label, v)``, and its chunks."""

    def __init__(self, rows: DataFrame, chunk: int = CHUNK, together: int = TOGETHER):
        self.spark, self.rows, self.together = rows.sparkSession, rows, together
        facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
        self.count, self.dim = facts["n"], max(facts["dim"] or 1, 1)
        dim = self.dim
        sample = sampled(rows, "row", self.count, SAMPLE).select("v").toArrow()
        points = matrix(sample.column("v"), dim)
        tree = Tree()
        tree.grow(points, self.count / max(len(points), 1), chunk, [])
        sent = self.spark.sparkContext.broadcast(tree)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf = sent.value.leaves(matrix(batch.column("v"), dim))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

        columns = rows.select("row", "id", "label", "v")
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns.schema)
        self.placed = cut(columns.mapInArrow(place, schema + ", leaf int"))
        sizes = {r["leaf"]: r["count"] for r in self.placed.groupBy("leaf").count().collect()}
        parts = np.array([-(-sizes.get(leaf, 0) // chunk) for leaf in range(len(tree.paths))], np.int64)
        first = np.cumsum(parts) - parts
        layout = F.broadcast(self.spark.createDataFrame([(i, int(p), int(f)) for i, (p, f) in enumerate(zip(parts, first)) if p], "leaf int, parts long, first long"))
        dealt = self.placed.join(layout, "leaf").withColumn("chunk", F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))).drop("parts", "first")

        def pack(key, table):
            table = table.sort_by([("id", "ascending"), ("row", "ascending")])
            vectors = matrix(table.column("v"), dim)
            low, high = sent.value.ranges(key[0].as_py(), vectors)
            ids = table.column("id").fill_null(_LAST)
            body = stored({"row": table.column("row"), "id": ids, "label": table.column("label"), "v": lists(vectors)})
            return pa.table(
                {"leaf": [key[0].as_py()], "chunk": [key[1].as_py()], "body": [body], "low": [low], "high": [high]},
                pa.schema([("leaf", pa.int32()), ("chunk", pa.int64()), ("body", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]),
            )

        self.chunks = cut(dealt.groupBy("leaf", "chunk").applyInArrow(pack, CHUNKS))
        ranges = self.chunks.select("leaf", F.posexplode(F.arrays_zip("low", "high")).alias("at", "x"))
        ranges = ranges.groupBy("leaf", "at").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high")).orderBy("leaf", "at").toArrow().to_pydict()
        for leaf in sorted(set(ranges["leaf"])):
            mine = [i for i, x in enumerate(ranges["leaf"]) if x == leaf]
            tree.low[leaf] = np.array([ranges["low"][i] for i in mine])
            tree.high[leaf] = np.array([ranges["high"][i] for i in mine])
        sent.unpersist()
        self.tree = self.spark.sparkContext.broadcast(tree)

    def blocks(self, anchors: DataFrame, size: int = ANCHORS) -> DataFrame:
        """Anchors ``(row, label, v, leaf, positive)`` packed so that a block's anchors lie in neighbouring leaves."""
        counts = {r["leaf"]: r["count"] for r in anchors.groupBy("leaf").count().collect()}
        layout, block, held = [], 0, 0
        for leaf in sorted(counts):
            if held and held + counts[leaf] > size:
                block, held = block + 1, 0
            parts = -(-counts[leaf] // size)
            layout.append((leaf, parts, block))
            block, held = (block + parts, 0) if parts > 1 else (block, held + counts[leaf])
        layout = F.broadcast(self.spark.createDataFrame(layout, "leaf int, parts long, first long"))
        dim = self.dim

        def pack(key, table):
            positive = table.column("positive").combine_chunks()
            vectors = matrix(table.column("v"), dim)
            wide = max(np.asarray(positive.value_lengths()).max(initial=0), 1)
            opened = np.full((len(vectors), wide), _NONE)
            opened[np.arange(wide) < np.asarray(positive.value_lengths())[:, None]] = np.asarray(positive.flatten())
            columns = {"row": table.column("row"), "label": table.column("label"), "v": lists(vectors)}
            columns["positive"] = lists(opened)
            return pa.table({"block": [key[0].as_py()], "body": [stored(columns)]}, pa.schema([("block", pa.int64()), ("body", pa.binary())]))

        dealt = anchors.join(layout, "leaf").withColumn("block", F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts")))
        return cut(dealt.select("block", "row", "label", "v", "positive").groupBy("block").applyInArrow(pack, BLOCKS))

    def search(self, blocks: DataFrame, windows: bool, wanted: int, low: int = 0, high: int = 0) -> DataFrame:
        """At most ``wanted`` rows for each anchor, place and task: of its own label, or of other labels inside its windows."""
        tree, dim = self.tree, self.dim

        def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, body in zip(batch.column("block").to_pylist(), batch.column("body").to_pylist()):
                    block = read(body)
                    leaves = sorted(tree.value.low)
                    keep = leaves
                    if windows:
                        least, most = tree.value.bounds(block["v"].reshape(-1, dim), leaves)
                        opened = block["positive"].reshape(len(least), -1)
                        hit = np.zeros(len(leaves), bool)
                        for p in opened.T:
                            real = p != _NONE
                            floor, roof = -((-low * np.where(real, p, 0)) // 100), (high * np.where(real, p, 0)) // 100
                            hit |= ((most >= floor[:, None]) & (least <= roof[:, None]) & (real & (floor <= roof))[:, None]).any(axis=0)
                        keep = [leaf for leaf, h in zip(leaves, hit) if h]
                    yield pa.RecordBatch.from_arrays([pa.array([number] * len(keep), pa.int64()), pa.array(keep, pa.int32())], ["block", "leaf"])

        pairs = cut(blocks.mapInArrow(reached, "block long, leaf int"))
        task = F.floor(F.col("chunk") / self.together).alias("task")
        right = pairs.join(self.chunks.select("leaf", "chunk", "body"), "leaf").select("block", task, "leaf", "body")
        tasks = pairs.join(self.chunks.select("leaf", "chunk"), "leaf").select("block", task).distinct()
        left = tasks.join(blocks, "block").select(F.col("block").alias("of_block"), F.col("task").alias("of_task"), F.col("body").alias("anchors"))

        def find(key, anchors, chunks):
            block = read(anchors.column("anchors")[0].as_py())
            held = [(leaf, read(body)) for leaf, body in zip(chunks.column("leaf").to_pylist(), chunks.column("body").to_pylist())]
            found = _search(tree.value, dim, block, held, windows, wanted, low, high)
            return pa.table({n: pa.array(found[n], t) for n, t in _FOUND.items()})

        return left.groupBy("of_block", "of_task").cogroup(right.groupBy("block", "task")).applyInArrow(find, FOUND)


_FOUND = {"arow": pa.int64(), "place": pa.int32(), "score": pa.int64(), "id": pa.int64(), "row": pa.int64()}


def hard_negatives(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", chunk: int = CHUNK, block: int = ANCHORS,
) -> DataFrame:
    """The first negatives whose score is ``low`` to ``high`` hundredths of the positive's, for each anchor and positive.

    Vectors hold whole numbers. The result has ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``.
    """
    spark = rows.sparkSession
    ship(spark)
    held = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.greatest(F.least(x, F.lit(float(LARGEST))), F.lit(float(-LARGEST))).cast("int"))
    part = rows.where(F.col(label_col).isNotNull() & whole(vector_col))
    part = part.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), held.alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    part = cut(part.withColumn("row", F.monotonically_increasing_id()))
    index = Index(part, chunk)
    anchors = index.placed.join(part.where("anchor").select("row"), "row", "left_semi")
    none = F.array().cast("array<bigint>").alias("positive")
    first = Window.partitionBy("arow", "place").orderBy(F.desc("score"), F.asc("id"), F.asc("row"))
    near = index.search(index.blocks(anchors.select("row", "label", "v", "leaf", none), block), False, positives)
    near = cut(near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= positives))
    told = near.groupBy(F.col("arow").alias("row")).agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("p"))
    opened = anchors.join(told, "row").select("row", "label", "v", "leaf", F.col("p.score").alias("positive"))
    found = index.search(index.blocks(opened, block), True, negatives, low, high)
    found = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    named = lambda c: F.when(F.col(c) < _LAST, F.col(c))
    pairs = near.select("arow", (F.col("rank") - 1).alias("place"), named("id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = found.select("arow", "place", "rank", named("id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = part.where("anchor").select(F.col("row").alias("arow"), F.col("id").alias("anchor_id"))
    done = found.join(pairs, ["arow", "place"]).join(ids, "arow")
    return done.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
