"""The Merkle manifest against a plain loop over all rows."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from postlark.llm import manifest
from postlark.llm.queries import documents_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(text):
    return sha256(text.encode()).hexdigest()


def leaf(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, below, paths):
    """Top of one tree; adds the siblings of every node to the paths of the rows below it."""
    while len(nodes) > 1:
        runs = [range(a, min(a + 8, len(nodes))) for a in range(0, len(nodes), 8)]
        for run in runs:
            for k in run:
                for row in below[k]:
                    paths[row].append(("".join(nodes[j] for j in run if j < k), "".join(nodes[j] for j in run if j > k)))
        nodes, below = [digest("".join(nodes[k] for k in run)) for run in runs], [[r for k in run for r in below[k]] for run in runs]
    return nodes[0]


def brute(rows):
    leaves, paths = [leaf(r) for r in rows], [[] for _ in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaves[i]))
    langs = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    members = [[i for i in order if rows[i][2] == g] for g in langs]
    subroots = [climb([leaves[i] for i in m], [[i] for i in m], paths) for m in members]
    root = climb(subroots, members, paths)
    out = []
    for i, r in enumerate(rows):
        node = leaves[i]
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
            node = leaf((*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])))
        for left, right in paths[i]:
            node = digest(left + node + right)
        proof = digest("".join(left + right for left, right in paths[i]))
        out.append((r[0], leaves[i], subroots[langs.index(r[2])], root, proof, node, node == root))
    return out


def result(spark, rows, depth=manifest.DEPTH, **extra):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name, column in extra.items():
        docs = docs.withColumn(name, column)
    done = documents_manifest(docs, depth)
    return [tuple(r) for r in done.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def table(n, seed=0, ids=None):
    rnd = random.Random(seed)
    langs = ["en", "en", "en", "dé", None, "zz"]
    return [
        (i, rnd.choice(["web", None, "a:b"]), rnd.choice(langs), rnd.choice([None, 3]), rnd.choice([None, "", "Ab Ç", "x" * 3000, f"T{i}"]))
        for i in (ids or rnd.sample(range(-5 * n, 5 * n), n))
    ]


def key(rows):
    return sorted(rows, key=repr)


def test_equals_plain_loop_with_nulls_and_empty_texts(spark):
    rows = table(700) + [(9999, None, "one", 1, "Lone Leaf")]
    assert key(result(spark, rows)) == key(brute(rows))


def test_ids_that_repeat_and_null_ids(spark):
    rnd = random.Random(5)
    ids = [rnd.choice([None, 7, 7, 63, 64, -1, -(1 << 63), (1 << 63) - 1, 1 << 40]) for _ in range(120)] + list(range(90))
    rows = table(len(ids), 1, ids)
    rows += rows[:40]
    assert key(result(spark, rows)) == key(brute(rows))


def test_only_null_ids(spark):
    rows = table(20, 2, [None] * 20)
    assert key(result(spark, rows)) == key(brute(rows))


def test_several_tiers_of_arrays(spark, monkeypatch):
    monkeypatch.setattr(manifest, "FAN", 3)
    rows = table(400, 3) + [(20_000 + k, "s", f"g{k}", 1, "Q") for k in range(70)]
    assert key(result(spark, rows, depth=1)) == key(brute(rows))


def test_empty_table_and_clashing_names(spark):
    assert result(spark, []) == []
    rows = table(50, 4)
    extra = {c: F.lit("x") for c in ("row", "grp", "slot", "size", "key", "block", "leaf", "id", "digest")}
    assert key(result(spark, rows, **extra)) == key(brute(rows))


@pytest.mark.parametrize("count", [1, 8, 9, 64, 65])
def test_shapes(spark, count):
    rows = [(k, "s", "en", 1, "T") for k in range(count)]
    assert key(result(spark, rows)) == key(brute(rows))
