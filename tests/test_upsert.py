import random

import pytest
from pyspark.sql import functions as F

from postlark.operators import spread
from postlark.operators.spread import attach, cut, numbered, sequenced, shared_folder
from postlark.operators.upsert import apply_changes, membership, resolve
from postlark.schemas import BREAKDOWN

STORED = f"id bigint, dedup_key string, content_key string, score int, score_breakdown {BREAKDOWN}, status string"
BATCH = f"seq bigint, dedup_key string, content_key string, long boolean, score int, score_breakdown {BREAKDOWN}, status string"


def breakdown(tag):
    return (tag, 0, 0, 0, None)


def fold(stored, batch):
    """The rule, row by row. Returns (state by id, outcomes)."""
    state = {r[0]: dict(key=r[1], content=r[2], score=r[3], breakdown=r[4], status=r[5]) for r in stored}
    outcomes = []
    for seq, key, content, long, score, parts, status in batch:
        hit = next((i for i in sorted(state) if state[i]["key"] == key), None)
        if hit is not None:
            row = state[hit]
            row.update(score=score, breakdown=parts)
            if row["status"] in ("new", "filtered"):
                row["status"] = status
            outcomes.append((seq, hit, "key"))
            continue
        hit = next((i for i in sorted(state) if long and content and state[i]["content"] == content), None)
        if hit is not None:
            if score > state[hit]["score"]:
                state[hit].update(score=score, breakdown=parts)
            outcomes.append((seq, hit, "content"))
            continue
        new = max(state, default=0) + 1
        state[new] = dict(key=key, content=content, score=score, breakdown=parts, status=status)
        outcomes.append((seq, new, "insert"))
    return state, outcomes


def run(spark, stored, batch):
    s, b = spark.createDataFrame(stored, STORED), spark.createDataFrame(batch, BATCH)
    done = resolve(s, b)
    outcomes = sorted((r.seq, r.target_id, r.kind) for r in done.outcome.collect())
    after = {r.id: (r.score, r.score_breakdown.keyword, r.status) for r in apply_changes(s, done.updated).collect()}
    for r in done.inserted.collect():
        after[r.id] = (r.score, r.score_breakdown.keyword, r.status)
    return after, outcomes, done.rounds


def check(spark, stored, batch):
    state, outcomes = fold(stored, batch)
    after, got, rounds = run(spark, stored, batch)
    assert got == outcomes
    assert after == {i: (r["score"], r["breakdown"][0], r["status"]) for i, r in state.items()}
    return rounds


def random_case(rng, group, n_stored, n_batch, seq0, id0):
    """Rows of one independent group: its keys never meet another group's."""
    keys = [f"{group}k{i}" for i in range(rng.randint(1, 5))]
    contents = [f"{group}c{i}" for i in range(rng.randint(1, 4))]
    sticky = ["new", "filtered", "applied", "rejected"]
    stored = []
    for i, key in enumerate(rng.sample(keys, min(len(keys), rng.randint(0, n_stored)))):
        content = rng.choice(contents + [None])
        stored.append((id0 + i, key, content, rng.randint(0, 5), breakdown(-id0 - i), rng.choice(sticky)))
    batch = []
    for i in range(rng.randint(1, n_batch)):
        row = (seq0 + i, rng.choice(keys), rng.choice(contents), rng.random() < 0.7, rng.randint(0, 5))
        batch.append((*row, breakdown(seq0 + i), rng.choice(["new", "filtered"])))
    return stored, batch


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_row_by_row(spark, seed):
    rng = random.Random(seed)
    stored, batch = [], []
    for g in range(150):
        s, b = random_case(rng, f"g{g}", 4, 12, g * 100, g * 10 + 1)
        stored, batch = stored + s, batch + b
    check(spark, stored, batch)


def test_chain_needs_rounds(spark):
    # Each row's key was just used by a copy of the previous content, so settling goes link by link.
    batch, seq = [], 0
    for i in range(4):
        batch.append((seq, f"k{i}", f"c{i}", True, 1, breakdown(seq), "new"))
        batch.append((seq + 1, f"k{i + 1}", f"c{i}", True, 2, breakdown(seq + 1), "new"))
        seq += 2
    assert check(spark, [], batch) >= 1
    short_first = [
        (0, "a", "x", True, 1, breakdown(0), "new"),
        (1, "b", "x", True, 1, breakdown(1), "new"),
        (2, "b", "y", True, 1, breakdown(2), "new"),
        (3, "c", "y", True, 1, breakdown(3), "new"),
        (4, "c", "z", True, 1, breakdown(4), "new"),
    ]
    assert check(spark, [], short_first) > 1


def test_long_chain_settles_by_jumps(spark):
    """Ten thousand alternating keys and contents: each row waits for the one before."""
    n = 20_000
    rows = spark.range(n).select(
        F.col("id").alias("seq"), F.concat(F.lit("k"), F.floor((F.col("id") + 1) / 2)).alias("dedup_key"),
        F.concat(F.lit("c"), F.floor(F.col("id") / 2)).alias("content_key"), F.lit(True).alias("long"),
    )
    chosen, rounds = membership(rows)
    assert rounds < 20 and sorted(r.seq for r in chosen.collect()) == list(range(0, n, 2))


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_membership_on_tangled_chains(spark, seed):
    """Chains that meet, with short rows and rows without content among them."""
    rng = random.Random(seed)
    rows = []
    for seq in range(600):
        i = seq // 2
        key, content = f"k{i + seq % 2 - rng.choice([0, 0, 0, 0, 1, 3])}", f"c{i - rng.choice([0, 0, 0, 0, 1, 2])}"
        rows.append((seq, key, None if rng.random() < 0.05 else content, rng.random() < 0.9))
    keys, contents, want = set(), set(), []
    for seq, key, content, long in rows:
        if key not in keys and not (long and content in contents):
            want.append(seq)
            keys.add(key)
            contents |= {content} - {None}
    chosen, _ = membership(spark.createDataFrame(rows, "seq bigint, dedup_key string, content_key string, long boolean"))
    assert sorted(r.seq for r in chosen.collect()) == want


@pytest.fixture()
def small_skew(spark):
    """Let Spark cut even small partitions, so that the test's hot keys count as skewed."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1b",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200b",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k in settings:
        spark.conf.unset(k)


def test_one_hot_key(spark, small_skew):
    hot = [(i, "same", "c", True, i % 7, breakdown(i), "new") for i in range(300)]
    copies = [(300 + i, f"k{i}", "c", True, i % 9, breakdown(300 + i), "new") for i in range(300)]
    short = [(600 + i, f"s{i}", "c", False, 1, breakdown(600 + i), "new") for i in range(100)]
    check(spark, [(7, "other", "c", 3, breakdown(-1), "offer")], hot + copies + short)
    mixed = short + hot + copies
    check(spark, [], [(i, *row[1:]) for i, row in enumerate(mixed)])


def test_empty(spark):
    assert check(spark, [], []) == 0
    assert check(spark, [(1, "k", None, 1, breakdown(1), "new")], []) == 0


def test_membership_marks_sure_rows(spark):
    df = spark.createDataFrame([(0, "a", "x", True), (1, "a", "x", True), (2, "b", "x", False)], "seq bigint, dedup_key string, content_key string, long boolean")
    got, rounds = membership(df)
    assert sorted(r.seq for r in got.collect()) == [0, 2] and rounds == 1


def test_attach_keeps_every_row(spark, small_skew):
    rows = spark.range(1000).selectExpr("id", "case when id % 3 = 0 then 'hot' when id % 100 = 1 then null else concat('k', id % 50) end k")
    table = spark.createDataFrame([("hot", 1), ("k1", 2), ("zz", 3)], "k string, v int")
    got = attach(rows.repartition(6), table, "k")
    want = rows.join(table, "k", "left").select("id", "k", "v")
    assert sorted(got.collect(), key=lambda r: r.id) == sorted(want.collect(), key=lambda r: r.id)
    assert "isSkew=true" in got._jdf.queryExecution().executedPlan().toString() or got.count() == 1000


def test_scratch_tables_go(spark):
    folder = shared_folder(spark)
    with spread.scratch(spark):
        kept = cut(spark.range(3))
        path = kept.inputFiles()[0].rsplit("/", 1)[0]
        assert spread.exists(spark, path)
    assert not spread.exists(spark, path) and spread.exists(spark, folder)


def test_numbers(spark):
    rows = spark.range(5000).selectExpr("id", "(id * 7919) % 5003 x")
    got = numbered(rows, [F.desc("x")]).orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(1, 5001))
    assert [r.x for r in got] == sorted((r.x for r in got), reverse=True)
    seqs = sequenced(rows, ["x"]).orderBy("seq").collect()
    assert [r.x for r in seqs] == sorted(r.x for r in seqs)


def test_cut_uses_the_named_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder
    df = cut(spark.range(3).withColumn("y", F.rand()))
    assert df.count() == 3 and all(f.startswith(folder) or folder in f for f in df.inputFiles())
