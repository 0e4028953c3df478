import pytest
from pyspark.sql import functions as F

from postlark.llm.substring import dedup_substrings

from .fixtures import corpus, frame, words


def brute(rows, size=13):
    last = float("inf")
    least = {}
    for i, t in rows:
        w = words(t)
        for a in range(len(w) - size + 1):
            key = tuple(w[a : a + size])
            least[key] = min(least.get(key, last), last if i is None else i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for a in range(len(w) - size + 1):
            if least[tuple(w[a : a + size])] < (last if i is None else i):
                gone[a : a + size] = [True] * size
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed=seed)
    got = dedup_substrings(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)
    assert sum(r.n_removed for r in got) > 100


def test_empty_table_and_clashing_columns(spark):
    assert dedup_substrings(frame(spark, [])).collect() == []
    schema = "doc_id long, text string, n_words string, body string, `a b` int"
    rows = [(1, "a\nb", "x", "y", 1), (2, None, None, None, None)]
    got = dedup_substrings(spark.createDataFrame(rows, schema), carry=["n_words", "body", "a b"], keep_untouched=True)
    assert got.columns == ["id", "n_words", "n_removed", "kept_text", "body", "a b"]
    assert {tuple(r) for r in got.collect()} == {(1, 2, 0, "a\nb", "y", 1), (2, 0, 0, None, None, None)}


def test_one_passage_in_every_document(spark):
    passage = " ".join(f"w{k}" for k in range(20))
    rows = [(i, f"{i} x{i} {passage} y{i}") for i in range(300)]
    got = {r.id: r for r in dedup_substrings(frame(spark, rows)).select("id", "n_removed", F.length("kept_text").alias("n")).collect()}
    assert got[0].n_removed == 0 and all(got[i].n_removed == 20 for i in range(1, 300))
