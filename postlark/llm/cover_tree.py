"""Embedding near-dedup by a dual traversal of cover trees.

Vectors of one label are nodes in nested levels of halving radii. Above stand centers, chosen from a sample farthest
first; a row hangs on its nearest center, in the shell its distance falls in (``RADII``), and label, center and shell make a
node whose least and greatest distance are measured on all rows. Below, each node's rows are cut into chunks of about ``CHUNK``, and a
chunk holds a cover tree of its own: greedy nets of radius 1, 1/2, 1/4, ... in which every net holds the one above it.

The traversal goes down pairs of nodes from both sides. A pair whose covering radii keep all its rows apart is pruned; one
whose radii keep all its rows together is settled without looking at them; what is left at the end is compared in double
precision. So a tight cloud of copies, of whatever size, costs a few node pairs, and counts and components of it are exact without a
row for each of its links. Pairs of nodes are found per label from at most ``CENTERS`` times the number of shells nodes;
pairs of chunks are Spark joins, and a task gives at most one row for each vector of its two chunks: a count, and the
least member of what is linked inside it. Components of these are found by stars over tables.

Equal vectors of a label are one class with a weight.

Cases: vectors that are null, zero or hold null or non-finite components, and rows with a null label, link with nothing: no
links, a component of their own, kept. Shorter vectors count as ending in zeros. Repeated rows link with each other. A
null id takes part but is never a component's id (null if there is no other). An empty table gives an empty result; other
columns are ignored. There is no text in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlark.llm.components import components
from postlark.llm.vectors import distances, farthest_first, lists, matrix, read, sampled, stored, whole
from postlark.operators.spread import cut
from postlark.shipping import ship

LEAST = 0.98
SAMPLE = 8192
CENTERS = 256
CHUNK = 2048
RADII = (1.0, 0.5, 0.25, 0.125, 0.0625)
SMALL = 1 << 10
SLAB = 1 << 16
SLACK = 1e-7
TREES = "node long, chunk long, body binary"
LINKS = "u long, v long, n long"


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, initial=1e-300)[:, None]
    return scaled / np.linalg.norm(scaled, axis=1)[:, None]


def linked(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least member of each point's component, of n points and the links between u and v."""
    least = np.arange(n)
    while len(u):
        a, b = least[u], least[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while (least[least] != least).any():
            least = least[least]
    return least


class Nets:
    """Nested nets of some unit vectors, which are put in an order in which every node is a run of rows."""

    def __init__(self, vectors: np.ndarray):
        n = len(vectors)
        node, above = np.zeros(n, np.int64), []
        for radius in RADII:
            center = np.full(n, -1)
            order = np.argsort(node, kind="stable")
            runs = np.flatnonzero(np.concatenate([[True], node[order][1:] != node[order][:-1]])) if n else []
            for a, b in zip(runs, [*runs[1:], n]):
                rows = order[a:b]
                own = node[rows[0]]
                rows = np.concatenate([[own], rows[rows != own]])  # the node's own center first, so that nets are nested
                while len(rows):
                    gap = np.linalg.norm(vectors[rows] - vectors[rows[0]], axis=1)
                    near = gap <= radius
                    near[0] = True
                    center[rows[near]] = rows[0]
                    rows = rows[~near]
            above.append(center)
            node = center
        self.order = np.lexsort(above[::-1]) if n else np.empty(0, np.int64)
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        held = vectors[self.order]
        self.starts, self.centers, self.radii = [], [], []
        for center in above:
            mine = place[center[self.order]]
            starts = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]])) if n else np.empty(0, np.int64)
            gap = np.linalg.norm(held - held[mine], axis=1)
            self.starts.append(starts)
            self.centers.append(mine[starts])
            self.radii.append(np.maximum.reduceat(gap, starts) if n else np.empty(0))


class Tree:
    """A chunk as it is stored: classes, weights and vectors in the order of its nets, and the nets."""

    def __init__(self, body: bytes, dim: int):
        columns = read(body)
        self.cls, self.weight, self.v = columns["cls"], columns["weight"], columns["v"].reshape(-1, dim)
        n = len(self.cls)
        self.sums = np.concatenate([[0], np.cumsum(self.weight)])
        self.starts, self.ends, self.centers, self.radii = [], [], [], []
        for k in range(len(RADII)):
            starts = np.flatnonzero(columns[f"center{k}"] >= 0)
            self.starts.append(starts)
            self.ends.append(np.append(starts[1:], n))
            self.centers.append(columns[f"center{k}"][starts])
            self.radii.append(columns[f"radius{k}"][starts])

    @staticmethod
    def stored(cls: np.ndarray, weight: np.ndarray, vectors: np.ndarray) -> bytes:
        nets = Nets(vectors)
        columns = {"cls": cls[nets.order], "weight": weight[nets.order], "v": lists(vectors[nets.order])}
        for k, (starts, centers, radii) in enumerate(zip(nets.starts, nets.centers, nets.radii)):
            center, radius = np.full(len(cls), -1), np.zeros(len(cls))
            center[starts], radius[starts] = centers, radii
            columns |= {f"center{k}": center, f"radius{k}": radius}
        return stored(columns)

    def below(self, level: int, node: int) -> np.ndarray:
        """The node's children, numbered on the next level."""
        first, last = np.searchsorted(self.starts[level + 1], [self.starts[level][node], self.ends[level][node]])
        return np.arange(first, last)


class Traversal:
    """All links between two chunks, or inside one: weighted counts, and which vectors hang together."""

    def __init__(self, a: Tree, b: Tree, same: bool, least: float):
        self.a, self.b, self.same, self.least = a, b, same, least
        self.reach = np.sqrt(2 - 2 * least)
        self.trees = (a, b)
        self.base = 0 if same else len(a.cls)
        self.size = len(a.cls) + (0 if same else len(b.cls))
        self.count = np.zeros(self.size, np.int64)
        self.steps = np.zeros(self.size + 1, np.int64)
        self.chain = np.zeros(self.size + 1, np.int64)
        self.u: list[np.ndarray] = []
        self.v: list[np.ndarray] = []
        self.small: list[tuple[np.ndarray, ...]] = []
        if len(a.cls) and len(b.cls):
            self.visit(0, np.arange(len(a.starts[0])), np.arange(len(b.starts[0])), same)
            self.compare()

    def visit(self, level: int, i: np.ndarray, j: np.ndarray, mirrored: bool) -> None:
        """All pairs of a node of i with one of j; of a mirrored block, each pair once."""
        a, b = self.a, self.b
        cosine = a.v[a.centers[level][i]] @ b.v[b.centers[level][j]].T
        gap = np.sqrt(np.maximum(2 - 2 * cosine, 0))
        cover = a.radii[level][i][:, None] + b.radii[level][j]
        sizes = (a.ends[level][i] - a.starts[level][i])[:, None] * (b.ends[level][j] - b.starts[level][j])
        reach = np.triu(np.ones(gap.shape, bool)) if mirrored else np.ones(gap.shape, bool)
        single = reach & (sizes == 1)
        if mirrored:
            np.fill_diagonal(single, False)
        x, y = np.nonzero(single & (cosine >= self.least))
        self.link(a.starts[level][i[x]], b.starts[level][j[y]])
        reach &= (gap - cover <= self.reach + SLACK) & (sizes > 1)
        together = reach & (gap + cover <= self.reach - SLACK) & (sizes > SMALL)
        for x, y in zip(*np.nonzero(together)):
            self.settle(level, i[x], j[y], mirrored and x == y)
        x, y = np.nonzero(reach & ~together)
        sizes = sizes[x, y]
        x, y, own = i[x], j[y], mirrored & (x == y)
        leaf = (sizes <= SMALL) if level + 1 < len(RADII) else np.ones(len(x), bool)
        if leaf.any():
            s, t = x[leaf], y[leaf]
            self.small.append((a.starts[level][s], a.ends[level][s], b.starts[level][t], b.ends[level][t], own[leaf]))
        for s, t, o in zip(x[~leaf], y[~leaf], own[~leaf]):
            self.visit(level + 1, a.below(level, s), b.below(level, t), o)

    def settle(self, level: int, i: int, j: int, own: bool) -> None:
        """Every row of one node is linked with every row of the other."""
        a, b, base = self.a, self.b, self.base
        (s, e), (t, f) = (a.starts[level][i], a.ends[level][i]), (b.starts[level][j], b.ends[level][j])
        self.steps[s] += b.sums[f] - b.sums[t]
        self.steps[e] -= b.sums[f] - b.sums[t]
        self.chain[s] += 1
        self.chain[e - 1] -= 1
        if own:
            self.count[s:e] -= a.weight[s:e]
            return
        self.steps[base + t] += a.sums[e] - a.sums[s]
        self.steps[base + f] -= a.sums[e] - a.sums[s]
        self.chain[base + t] += 1
        self.chain[base + f - 1] -= 1
        self.u.append(np.array([s]))
        self.v.append(np.array([base + t]))

    def compare(self) -> None:
        """Rows of the node pairs that are left, in slabs."""
        if not self.small:
            return
        s, e, t, f, own = (np.concatenate(x) for x in zip(*self.small))
        sizes = (e - s) * (f - t)
        big = np.flatnonzero(sizes > SLAB)
        for k in big:
            for x in range(s[k], e[k], max(1, SLAB // (f[k] - t[k]))):
                y = min(x + max(1, SLAB // (f[k] - t[k])), e[k])
                self.meet(*(g.ravel() for g in np.meshgrid(np.arange(x, y), np.arange(t[k], f[k]), indexing="ij")), np.full((y - x) * (f[k] - t[k]), own[k]))
        rest = np.flatnonzero(sizes <= SLAB)
        total = np.cumsum(sizes[rest])
        while len(rest):
            take = max(1, int(np.searchsorted(total, SLAB, side="right")))
            k, rest = rest[:take], rest[take:]
            total = total[take:] - total[take - 1] if len(rest) else total
            many = sizes[k]
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            width = np.repeat(f[k] - t[k], many)
            self.meet(np.repeat(s[k], many) + at // width, np.repeat(t[k], many) + at % width, np.repeat(own[k], many))

    def meet(self, x: np.ndarray, y: np.ndarray, own: np.ndarray) -> None:
        a, b = self.a, self.b
        once = ~own | (x < y)
        x, y = x[once], y[once]
        close = np.einsum("ij,ij->i", a.v[x], b.v[y]) >= self.least
        self.link(x[close], y[close])

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        """These rows of one chunk are linked with those of the other."""
        if not len(x):
            return
        self.count += np.bincount(x, self.b.weight[y], self.size).astype(np.int64)
        self.count += np.bincount(self.base + y, self.a.weight[x], self.size).astype(np.int64)
        few = linked(self.size, x, self.base + y)
        moved = np.flatnonzero(few != np.arange(self.size))
        self.u.append(moved)
        self.v.append(few[moved])

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes that have links here, the least of what each hangs together with, and their weighted counts."""
        count = self.count + np.cumsum(self.steps[:-1])
        chained = np.flatnonzero(np.cumsum(self.chain[:-1]) > 0)
        u, v = np.concatenate([chained, *self.u]), np.concatenate([chained + 1, *self.v])
        least = linked(self.size, u.astype(np.int64), v.astype(np.int64))
        cls = self.a.cls if self.same else np.concatenate([self.a.cls, self.b.cls])
        told = np.flatnonzero((count > 0) | (least != np.arange(self.size)))
        return cls[told], cls[least[told]], count[told]


def _shell(gap: np.ndarray) -> np.ndarray:
    return (gap[:, None] <= np.array(RADII)).sum(axis=1).astype(np.int32)


def node_pairs(nodes: DataFrame, centers, least: float) -> DataFrame:
    """``(a, b, together)`` for the node pairs of each label that may hold links."""
    reach = float(np.sqrt(2 - 2 * least))

    def traverse(key, table):
        order = table.sort_by("node")
        node, center, near, far = (np.asarray(order.column(c)) for c in ("node", "center", "near", "far"))
        held = centers.value[center]
        out = []
        for a in range(0, len(node), 256):
            part = slice(a, a + 256)
            gap = np.where(center[part, None] == center, 0, distances(held[part], held))
            apart = np.maximum(gap - far[part, None] - far, np.maximum(near[part, None] - far, near - far[part, None]) - gap)
            x, y = np.nonzero((apart <= reach + SLACK) & (np.arange(len(node))[part, None] <= np.arange(len(node))))
            together = gap[x, y] + far[part][x] + far[y] <= reach - SLACK
            out.append((node[part][x], node[y], together))
        a, b, together = (np.concatenate(x) for x in zip(*out))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "together": pa.array(together)})

    return nodes.select("label", "node", "center", "near", "far").groupBy("label").applyInArrow(traverse, "a long, b long, together boolean")


def near_vectors(
    docs: DataFrame, least: float = LEAST, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", chunk: int = CHUNK, most_centers: int = CENTERS
) -> DataFrame:
    """``id``, ``n_links`` and ``component_id`` of every row; rows link if their labels are equal and their cosine is at least ``least``."""
    spark = docs.sparkSession
    ship(spark)
    there = F.col(label_col).isNotNull() & whole(vector_col) & F.exists(F.col(vector_col).cast("array<double>"), lambda x: x != 0)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"), F.coalesce(there, F.lit(False)).alias("there"))
    rows = cut(rows)
    classes = rows.where("there").groupBy("label", "v").agg(F.count("*").alias("weight"), F.min("id").alias("least"))
    classes = cut(classes.withColumn("cls", F.monotonically_increasing_id()))
    facts = classes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    alone = F.lit(0).cast("long").alias("n_links")
    if not facts["n"]:
        return rows.select("id", alone, F.col("id").alias("component_id"))
    dim = facts["dim"]
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0]
    sample = sampled(classes, "cls", facts["n"], SAMPLE).select("v").toArrow()
    points = unit(matrix(sample.column("v"), dim)) if sample.num_rows else np.eye(1, dim)
    centers = spark.sparkContext.broadcast(farthest_first(points, max(1, min(most_centers, -(-largest // chunk)))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gap = distances(unit(matrix(batch.column("v"), dim)), centers.value)
            center = gap.argmin(axis=1)
            gap = gap[np.arange(len(gap)), center]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(center, pa.int32()), pa.array(_shell(gap)), pa.array(gap)], ["cls", "center", "shell", "gap"])

    placed = cut(classes.select("cls", "v").mapInArrow(place, "cls long, center int, shell int, gap double"))
    hung = cut(classes.select("cls", "label", "v", "weight").join(placed, "cls"))
    nodes = hung.groupBy("label", "center", "shell").agg(
        F.min("gap").alias("near"), F.max("gap").alias("far"), F.count("*").alias("size"), F.sum("weight").alias("weight"), F.min("cls").alias("first")
    )
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    pairs = cut(node_pairs(nodes, centers, least))
    known = nodes.select("label", "center", "shell", "node", F.col("size"))
    of_node = cut(hung.join(known, ["label", "center", "shell"]).select("cls", "node", "size", "weight", "v"))

    # Node pairs whose rows are all linked.
    together = pairs.where("together")
    sides = together.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).distinct()
    gained = sides.join(nodes.select(F.col("node").alias("b"), "weight"), "b").groupBy("a").agg(F.sum("weight").alias("gained"), F.max(F.col("a") == F.col("b")).alias("own"))
    gained = cut(gained.withColumnRenamed("a", "node"))
    whole_links = of_node.join(gained, "node").select("cls", (F.col("gained") - F.when(F.col("own"), F.col("weight")).otherwise(0)).alias("n"))
    firsts = nodes.select("node", "first")
    whole_edges = of_node.join(gained.select("node"), "node").join(firsts, "node").select(F.col("cls").alias("u"), F.col("first").alias("v"))
    across = together.join(firsts.select(F.col("node").alias("a"), F.col("first").alias("u")), "a").join(firsts.select(F.col("node").alias("b"), F.col("first").alias("v")), "b")

    # The others, chunk by chunk.
    parts = F.ceil(F.col("size") / chunk).cast("long")
    dealt = of_node.withColumn("part", F.pmod(F.xxhash64("cls"), parts))

    def pack(key, table):
        body = Tree.stored(np.asarray(table.column("cls")), np.asarray(table.column("weight")), unit(matrix(table.column("v"), dim)))
        return pa.table({"node": [key[0].as_py()], "chunk": [key[1].as_py()], "body": [body]}, pa.schema([("node", pa.int64()), ("chunk", pa.int64()), ("body", pa.binary())]))

    trees = dealt.select("node", "part", "cls", "weight", "v").groupBy("node", "part").applyInArrow(pack, TREES)
    trees = cut(trees.select("node", F.monotonically_increasing_id().alias("tree"), "body"))
    open_ = pairs.where(~F.col("together"))
    left = trees.select(F.col("node").alias("a"), F.col("tree").alias("x"))
    right = trees.select(F.col("node").alias("b"), F.col("tree").alias("y"))
    met = cut(open_.join(left, "a").join(right, "b").where((F.col("a") != F.col("b")) | (F.col("x") <= F.col("y"))).select("x", "y"))
    bodies = met.join(trees.select(F.col("tree").alias("x"), F.col("body").alias("xs")), "x").join(trees.select(F.col("tree").alias("y"), F.col("body").alias("ys")), "y")

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            for k in range(batch.num_rows):
                a = Tree(batch.column("xs")[k].as_py(), dim)
                b = a if x[k] == y[k] else Tree(batch.column("ys")[k].as_py(), dim)
                u, v, n = Traversal(a, b, x[k] == y[k], least).result()
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(n, pa.int64())], ["u", "v", "n"])

    found = cut(bodies.mapInArrow(traverse, LINKS))

    counts = found.select(F.col("u").alias("cls"), "n").unionByName(whole_links).groupBy("cls").agg(F.sum("n").alias("n"))
    edges = found.select("u", "v").unionByName(whole_edges).unionByName(across.select("u", "v")).where("u <> v")
    stars = components(edges)
    rooted = classes.select("label", "v", "weight", "least", "cls").join(stars.select(F.col("u").alias("cls"), F.col("v").alias("root")), "cls", "left")
    rooted = rooted.join(counts, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    told = cut(rooted.join(named, "root").select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"))
    done = rows.where("there").join(told, ["label", "v"]).select("id", "n_links", "component_id")
    return done.unionByName(rows.where("not there").select("id", alone, F.col("id").alias("component_id")))
