"""Hard negatives and near copies of vectors against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlark.llm import cover_tree
from postlark.llm import hard_negatives as hn
from postlark.llm import queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def unit(rnd, dim):
    v = np.array([rnd.gauss(0, 1) for _ in range(dim)])
    return v / np.linalg.norm(v)


def table(n, seed, dim=8, spread=(0.0, 0.02, 0.05, 0.2), labels=3):
    """Clouds of copies of several widths, single vectors, and rows that can't take part."""
    rnd = random.Random(seed)
    heads = [unit(rnd, dim) for _ in range(5)]
    rows = []
    for k in range(n):
        v = unit(rnd, dim) if rnd.random() < 0.3 else rnd.choice(heads) + rnd.choice(spread) * unit(rnd, dim)
        rows.append((k, [float(x) for x in v * rnd.choice([1, 1, 0.5])], rnd.randrange(labels)))
    odd = [None, [], [0.0] * dim, [None] + [0.1] * (dim - 1), [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1)]
    rows += [(n + k, v, 1) for k, v in enumerate(odd)]
    rows += [(n + 10, rows[0][1], None), (None, rows[1][1], rows[1][2]), (n + 11, [1.0], 0), (n + 12, [1.0] + [0.0] * (dim - 1), 0)]
    rows += rows[:4]
    rnd.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def fine(v, dim):
    v = None if v is None or any(x is None or not math.isfinite(x) for x in v) else v
    return None if v is None else np.concatenate([np.array(v, np.float32).astype(float), np.zeros(dim - len(v))])


def near_brute(rows, dim):
    vectors = [fine(v, dim) for _, v, _ in rows]
    there = [v is not None and np.any(v != 0) and r[2] is not None for v, r in zip(vectors, rows)]
    link = [
        [
            j for j in range(len(rows))
            if i != j and there[i] and there[j] and rows[i][2] == rows[j][2]
            and vectors[i] @ vectors[j] / (np.linalg.norm(vectors[i]) * np.linalg.norm(vectors[j])) >= 0.98
        ]
        for i in range(len(rows))
    ]
    out = []
    for i, r in enumerate(rows):
        seen, work = {i}, [i]
        while work:
            for j in link[work.pop()]:
                if j not in seen:
                    seen.add(j)
                    work.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((r[0], len(link[i]), least))
    return sorted(out, key=repr)


def near(spark, rows, **args):
    done = cover_tree.near_vectors(frame(spark, rows), **args)
    return sorted((tuple(r) for r in done.collect()), key=repr)


@pytest.mark.parametrize("seed,args", [(1, {}), (2, {"chunk": 16, "most_centers": 3}), (3, {"chunk": 7, "most_centers": 20})])
def test_links_and_components(spark, seed, args):
    rows = table(150, seed)
    got = near(spark, rows, **args)
    assert got == near_brute(rows, 8) and max(n for _, n, _ in got) > 5


def test_a_tight_cloud_is_settled_by_its_nodes(spark, monkeypatch):
    rnd = random.Random(4)
    head = unit(rnd, 8)
    rows = [(k, [float(x) for x in head + 0.004 * unit(rnd, 8)], 1) for k in range(120)] + table(60, 5)
    assert near(spark, rows, chunk=16, most_centers=8) == near_brute(rows, 8)


def test_traversal_of_two_chunks_counts_all_links():
    rnd = np.random.default_rng(6)
    heads = cover_tree.unit(rnd.normal(size=(6, 8)))
    v = cover_tree.unit(heads[rnd.integers(0, 6, 700)] + rnd.choice([0, 0.01, 0.06], (700, 1)) * rnd.normal(size=(700, 8)))
    w = rnd.integers(1, 4, 700)
    a, b = (cover_tree.Tree(cover_tree.Tree.stored(np.arange(700)[s], w[s], v[s]), 8) for s in (slice(0, 400), slice(400, 700)))
    link = v @ v.T >= 0.98
    np.fill_diagonal(link, False)
    for x, y, same, mask in ((a, a, True, np.arange(700) < 400), (a, b, False, None)):
        u, least, n = cover_tree.Traversal(x, y, same, 0.98).result()
        own = link & (mask[:, None] & mask if same else (np.arange(700) < 400)[:, None] != (np.arange(700) < 400))
        want = own @ w
        got = np.zeros(700, int)
        got[u] = n
        assert (got == want).all()
        roots = cover_tree.linked(700, *np.nonzero(own))
        told = np.arange(700)
        told[u] = least
        hang = cover_tree.linked(700, np.arange(700), told)
        assert (hang == roots).all()


def test_empty_and_unusable_tables(spark):
    assert near(spark, []) == []
    assert near(spark, [(1, None, 1), (2, [0.0], 2)]) == [(1, 0, 1), (2, 0, 2)]
    assert hn.hard_negatives(frame(spark, []), F.col("vec_id") % 50 == 0).collect() == []
    assert hn.hard_negatives(frame(spark, [(50, [1.0], 1)]), F.col("vec_id") % 50 == 0).collect() == []


def negatives_brute(rows, dim, every):
    part = [(i, r[0], r[2], np.floor(256 * fine(r[1], dim)).astype(int)) for i, r in enumerate(rows) if fine(r[1], dim) is not None and r[2] is not None]
    last = lambda r: (r[1] is None, r[1] or 0)
    out = []
    for a in part:
        if a[1] is None or a[1] % every:
            continue
        score = lambda x: int(a[3] @ x[3])  # noqa: E731, B023
        order = sorted((x for x in part if x[0] != a[0]), key=lambda x: (-score(x), last(x)))
        for p in [x for x in order if x[2] == a[2]][:5]:
            fit = [x for x in order if x[2] != a[2] and 50 * score(p) <= 100 * score(x) <= 95 * score(p)]
            out += [(a[1], p[1], k + 1, x[1], score(p), score(x)) for k, x in enumerate(fit[:3])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,args", [(1, {}), (2, {"chunk": 16, "block": 4}), (3, {"chunk": 40, "block": 100})])
def test_negatives(spark, seed, args, monkeypatch):
    rows = table(400, seed, dim=6)
    index = frame(spark, rows).withColumn("embedding", F.when(queries.vectors.whole("embedding"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))))
    done = hn.hard_negatives(index, F.col("vec_id") % 10 == 0, **args)
    got = sorted((tuple(r) for r in done.collect()), key=repr)
    want = negatives_brute(rows, 6, 10)
    assert len(got) == len(want) > 100
    # Rows with the same id and score may stand for each other.
    assert got == want


def test_large_components_stay_exact(spark):
    rows = [(0, [3e5, 1.0], 1), (1, [2e5, 5.0], 1), (2, [1.5e5, 2.0], 2), (3, [-1e30, 1e30], 2), (4, [1e5, 9e4], 2)]
    index = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    scaled = index.withColumn("embedding", F.transform("embedding", lambda x: F.floor(x * 256)))
    got = [tuple(r) for r in hn.hard_negatives(scaled, F.col("vec_id") == 0).collect()]
    held = [[max(min(math.floor(x * 256), hn.LARGEST), -hn.LARGEST) for x in v] for _, v, _ in rows]
    score = lambda i: sum(a * b for a, b in zip(held[0], held[i]))
    assert got == [(0, 1, 1, 2, score(1), score(2)), (0, 1, 2, 4, score(1), score(4))][: len(got)] and got


def test_children_are_eliminated_by_their_ranges():
    rnd = np.random.default_rng(1)
    heads = rnd.normal(size=(12, 4)) * 100
    points = np.floor(heads[rnd.integers(0, 12, 2000)] + rnd.normal(size=(2000, 4)))
    tree = hn.Tree()
    tree.grow(points, 1.0, 50, [])
    leaf = tree.leaves(points)
    for k in np.unique(leaf):
        low, high = tree.ranges(int(k), points[leaf == k])
        tree.low[int(k)], tree.high[int(k)] = np.array(low), np.array(high)
    leaves = sorted(tree.low)
    least, most = tree.bounds(points[:40], leaves)
    true = points[:40] @ points.T
    for at, k in enumerate(leaves):
        assert (true[:, leaf == k].max(axis=1) <= most[:, at]).all() and (true[:, leaf == k].min(axis=1) >= least[:, at]).all()
    best = np.sort(true, axis=1)[:, -5]
    assert len(leaves) > 12 and (most >= best[:, None]).mean() < 0.4


def test_clashing_names(spark):
    rows = table(80, 9)
    docs = frame(spark, rows)
    for name in ("row", "id", "v", "leaf", "cls", "node", "weight", "there", "least", "anchor"):
        docs = docs.withColumn(name, F.lit("x"))
    assert sorted((tuple(r) for r in cover_tree.near_vectors(docs).collect()), key=repr) == near_brute(rows, 8)
    whole = F.when(queries.vectors.whole("embedding"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)))
    assert sorted((tuple(r) for r in hn.hard_negatives(docs.withColumn("embedding", whole), F.col("vec_id") % 10 == 0).collect()), key=repr) == negatives_brute(rows, 8, 10)
