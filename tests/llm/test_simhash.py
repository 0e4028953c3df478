import random

import pytest
import xxhash

from postlark.llm import simhash
from postlark.llm.simhash import keep_one_per_group, links, simhash_groups

from .fixtures import corpus, frame, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[a : a + 3]) for a in range(max(len(w) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, ids, distance=2):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    distinct = sorted(set(prints))
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    least = {}
    for p, i in zip(prints, ids):
        if i is not None:
            least[find(p)] = min(least.get(find(p), i), i)
    return [least.get(find(p)) for p in prints]


def near_copies(seed):
    rnd = random.Random(seed)
    rows = corpus(n=30, seed=seed)
    base = " ".join(f"Word{rnd.randint(0, 99)}" for _ in range(400)).split()
    for i in range(60):
        copy = list(base)
        copy[rnd.randrange(400)] = f"x{i}"
        rows.append((2000 + i, " ".join(copy)))
    return rows


@pytest.mark.parametrize("slab", [1 << 16, 50])
def test_equals_brute_force(spark, slab, monkeypatch):
    monkeypatch.setattr(simhash, "SLAB", slab)
    rows = near_copies(3)
    got = simhash_groups(frame(spark, rows)).collect()
    prints = [fingerprint(t) for _, t in rows]
    want = [(i, p, c) for (i, _), p, c in zip(rows, prints, components(prints, [i for i, _ in rows]))]
    assert sorted(((r.id, r.fingerprint & (1 << 64) - 1, r.component_id) for r in got), key=repr) == sorted(want, key=repr)
    assert len({c for _, p, c in want if c and c >= 2000}) < 30


def test_slabs_of_one_long_text(spark):
    rows = [(1, "a b c d " * 500)]
    batch = frame(spark, rows).withColumnRenamed("doc_id", "id").toArrow().to_batches()
    (whole,) = simhash.fingerprint_rows(batch)
    assert whole.column("fingerprint").to_pylist()[0] & (1 << 64) - 1 == fingerprint(rows[0][1])


def test_long_lists_give_the_same_links(spark, monkeypatch):
    rnd = random.Random(1)
    prints = {0x1234567890ABCDEF ^ rnd.getrandbits(16) ^ (rnd.getrandbits(8) << 40) for _ in range(300)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    want = {frozenset((a, b)) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2}
    got = [frozenset((r.u & (1 << 64) - 1, r.v & (1 << 64) - 1)) for r in links(spark.createDataFrame(signed, "fingerprint long")).collect()]
    assert len(got) == len(want) and set(got) == want


def test_one_of_each_group_stays(spark):
    rows = [(5, "a b c d", "n"), (3, "A b c d", None), (9, "other words here now", "o"), (None, "a b c d", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    assert sorted((tuple(r) for r in keep_one_per_group(docs).collect()), key=repr) == sorted([rows[1], rows[2], rows[3]], key=repr)
    assert simhash_groups(frame(spark, [])).collect() == []
