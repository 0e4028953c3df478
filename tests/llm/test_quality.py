import math
import random

from postlark.llm import quality
from postlark.llm.quality import ALPHA, DELTA, GRID, RATIOS, STEPS, admitted, binomial_tail, cutoffs, enough, judge_quality, strata, text_counts

from .fixtures import corpus, frame, words


def brute(text):
    text = text or ""
    w = words(text)
    lines = [s for s in text.split("\n") if words(s)]
    windows = [tuple(w[a : a + 8]) for a in range(len(w) - 7)]
    hit = {a + k for a, x in enumerate(windows) if windows.count(x) > 1 for k in range(8)}
    return (
        len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), len(lines),
        sum(text.count(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    )


def test_counts_equal_brute_force(spark):
    rows = [r for r in corpus(n=25) if len(r[1] or "") < 9000]
    rows += [(1, "A|b\nA|b\n \n\nA|b"), (2, "a b c d e f g h " * 3), (3, "x\r\nx\r\ny"), (4, "😀 é\x0b#"), (5, "q " * 9)]
    got = text_counts(frame(spark, rows)).select("doc_id", *quality.COUNTS).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((i, *brute(t)) for i, t in rows), key=repr)


def test_tail_is_exact():
    for n, p in ((1, 0.3), (40, 0.005), (700, 0.01), (3000, 0.005)):
        terms = [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(min(n, 60) + 1)]
        for k in range(0, int(n * p) + 1):
            assert abs(binomial_tail(k, n, p) - sum(terms[: k + 1])) < 1e-10
    assert binomial_tail(0, 0, 0.1) == 1.0 and binomial_tail(50, 100, 0.1) == 1.0


MEASURED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long"


def test_cutoffs_pass_the_binomial_test_and_are_the_strictest(spark):
    rnd = random.Random(0)
    rows = [(i, 200, 1000, rnd.randint(0, 20) if i % 90 else 150, 0, rnd.randint(0, 12), 10, 0) for i in range(4000)]
    labels = spark.createDataFrame([(i, 1) for i in range(4000)] + [(None, 1), (7, 0)], "doc_id long, quality int")
    found = cutoffs(spark.createDataFrame(rows, MEASURED), labels)
    good = [r for r in rows if r[0] != 7]
    want = None
    for k in range(STEPS):
        away = sum(r[3] / 200 > GRID["symbol_ratio"][k] or r[5] / 200 > GRID["repeat_ratio"][k] for r in good)
        if binomial_tail(away, len(good), ALPHA) > DELTA:
            break
        want = k
    assert 0 < want < STEPS - 1
    assert found == [{name: GRID[name][want] for name in RATIOS}] * 4  # one band has all labels, so all share a stratum


def test_bands_are_joined_until_each_stratum_can_be_tested(spark):
    assert enough(ALPHA, DELTA / 4) == 217 and enough(ALPHA, DELTA) == 149
    for n in (149, 217):
        d = DELTA if n == 149 else DELTA / 4
        assert admitted([0] * STEPS + [n], ALPHA, d) == STEPS - 1 and admitted([0] * STEPS + [n - 1], ALPHA, d) is None
    assert strata([376, 2084, 803, 44], 217) == [0, 1, 2, 2] and strata([217] * 4, 217) == [0, 1, 2, 3]
    assert strata([38, 208, 80, 4], 217) == [0] * 4 and strata([0, 0, 100, 217], 217) == [0] * 4 and strata([5, 0, 0, 0], 217) == [0] * 4
    assert strata([10, 300, 10, 300], 217) == [0, 0, 1, 1]
    # every stratum with 217 good documents gets cutoffs, and they turn documents away
    lengths = (60, 300, 1000, 5000)
    rows = [(b * 1000 + i, n, 5 * n, 3 * n if i >= 217 else 0, 0, 0, 10, 0) for b, n in enumerate(lengths) for i in range(230)]
    labels = spark.createDataFrame([(b * 1000 + i, int(i < 217)) for b in range(4) for i in range(230)], "doc_id long, quality int")
    found = cutoffs(spark.createDataFrame(rows, MEASURED), labels)
    assert [sorted(f) for f in found] == [sorted(RATIOS)] * 4


def test_no_more_than_the_stated_share_of_holdouts_loses_too_much():
    """Of 2000 drawn holdouts, at most the share DELTA (and chance) admits a step whose true loss is ALPHA or more."""
    rnd = random.Random(5)
    share = [0.0011] * STEPS  # of good documents turned away from each step on: the true loss passes ALPHA at step 18
    wrong = useful = 0
    for _ in range(2000):
        draws = rnd.choices(range(STEPS + 1), [*share, 1 - sum(share)], k=900)
        reached = admitted([draws.count(k) for k in range(STEPS + 1)], ALPHA, DELTA)
        wrong += reached is not None and sum(share[: reached + 1]) >= ALPHA
        useful += reached is not None
    assert wrong / 2000 <= DELTA + 3 * math.sqrt(DELTA * (1 - DELTA) / 2000) and useful > 1800


def test_a_registered_table_has_cutoffs_in_force(spark):
    """The table on which the SQL is compared has documents that only the method turns away."""
    from postlark.llm.queries import op9_quality_rules

    got = op9_quality_rules(spark, "/root/testdata/sf0.01").where("rejected_by is not null and not base_failed")
    assert got.where("kept").count() == 0 and got.count() > 0


def test_verdicts_and_cases(spark):
    rows = [(i, f"{i} " + "plain words of text " * 3 + f"{i} more {i} and so on up to {i} twenty words") for i in range(30)]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows + [(99, None), (100, "#" * 30), (None, "")]], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    got = {r.doc_id: r for r in judge_quality(docs, labels).collect()}
    assert all(got[i].kept == (not got[i].base_failed) for i in range(30))
    assert [(got[i].base_failed, got[i].kept) for i in (99, 100, None)] == [(True, False)] * 3
    assert judge_quality(docs.where("false"), labels).collect() == []
    few = judge_quality(docs, labels.where("false")).where("not kept and not base_failed").count()
    assert few == 0
