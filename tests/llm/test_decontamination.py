import random

import pytest

from postlark.llm import decontamination
from postlark.llm.decontamination import decontaminate, leaks, literal_leaks

ITEM = "A train leaves with 120 passengers and Alice meets Bob after 35 km of track, so how many hours of travel remain for 120 people?"
AGAIN = "intro text here. A train leaves with 77 passengers and Clara meets Dave after 4.5 km of track, so how many hours of travel remain for 77 people? outro"
BROKEN = "A train leaves with 77 passengers and Clara meets Dave after 4 km of track, so how many hours of travel remain for 78 people?"


def rows_of(df):
    return {(r.doc_id, r.item_id): (r.n_windows, r.item_windows, r.n_slots, r.n_changed) for r in df.collect()}


@pytest.mark.parametrize("limit", [500_000, 0])
def test_finds_copies_and_consistent_variants(spark, limit, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", limit)
    rnd = random.Random(0)
    filler = lambda n: " ".join(rnd.choice(["ab", "cd", "ef", "gh", "Ij", "9", "12.5"]) + rnd.choice("klmn") for _ in range(n))
    docs = [
        (1, filler(50) + " " + ITEM + " " + filler(3000)), (2, AGAIN), (3, BROKEN), (4, filler(500)), (5, None), (6, ""),
        (7, ITEM.upper()), (1, "again"), (None, ITEM), (8, "1 2 3 4 5 6 7 8 9 10 11 12"), (9, ITEM[:40]), (2, AGAIN),
    ]
    bench = [(10, ITEM), (11, "too short"), (12, None), (10, ITEM), (13, "1 2 3 4 5 6 7 8 9 10 11 12")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, hash string")
    bench = spark.createDataFrame(bench, "item_id long, text string")
    got = rows_of(leaks(docs, bench))
    assert set(got) == {(1, 10), (2, 10), (None, 10)}
    assert got[1, 10][3] == 0 and got[2, 10][2:] == (6, 5)
    kept = sorted((tuple(r) for r in decontaminate(docs, bench).collect()), key=repr)
    # the other text under id 1 is clean and stays
    assert [r[0] for r in kept if r[0] != 1] == [3, 4, 5, 6, 7, 8, 9] and [r for r in kept if r[0] == 1] == [(1, "again", "x")]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert leaks(docs, bench.where("false")).collect() == []
    assert leaks(docs.where("false"), bench).collect() == []
    assert decontaminate(docs, bench).collect() == []


def test_whole_job_finds_literal_copies(spark):
    thai = "中文句子没有空格所以要按字分开"
    docs = [
        (7, ITEM.upper()), (8, "x 1 2 3 4 5 6 7 8 9 10 11 12 y"), (9, "It is this: Too Short! So there."), (10, ITEM.title()), (11, "前" + thai + "后"),
        (12, "too long, short"), (13, "1 2 3 5 4 6 7 9 8 10 12 11"), (16, "It is too short for this."), (17, "too short"), (14, None), (15, ITEM[:30]),
    ]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(10, ITEM), (11, "too short"), (12, None), (13, "1 2 3 4 5 6 7 8 9 10 11 12"), (14, thai)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in literal_leaks(docs, bench).collect()}
    assert got == {(7, 10), (8, 13), (9, 11), (10, 10), (11, 14), (17, 11)}
    assert {r.doc_id for r in decontaminate(docs, bench, whole=True).collect()} == {12, 13, 14, 15, 16}
    assert decontaminate(docs, bench.where("false"), whole=True).count() == 11 and literal_leaks(docs.where("false"), bench).collect() == []


def test_whole_job_keeps_windows_without_the_broken_slot(spark):
    typo = ITEM.replace("for 120", "for 121")
    docs = spark.createDataFrame([(3, BROKEN), (2, AGAIN), (4, typo), (None, BROKEN), (5, "other words")], "doc_id long, text string")
    bench = spark.createDataFrame([(10, ITEM)], "item_id long, text string")
    assert set(rows_of(leaks(docs, bench))) == {(2, 10)}
    got = rows_of(leaks(docs, bench, mend=True))
    assert set(got) == {(3, 10), (2, 10), (4, 10), (None, 10)}
    assert got[2, 10][0] == got[2, 10][1] and got[4, 10][0] == got[4, 10][1] - 2
    assert {r.doc_id for r in decontaminate(docs, bench, whole=True).collect()} == {5}


@pytest.mark.parametrize("whole", [False, True])
def test_rows_without_an_id_or_with_one_in_common_are_judged_by_their_own_text(spark, whole):
    rows = [(None, ITEM), (None, "a clean text about trains"), (None, "another clean text"), (None, None), (5, ITEM), (5, "clean under a shared id"), (None, ITEM)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(10, ITEM)], "item_id long, text string")
    kept = sorted((tuple(r) for r in decontaminate(docs, bench, whole=whole).collect()), key=repr)
    assert kept == sorted((r for r in rows if r[1] != ITEM), key=repr)
    assert set(rows_of(leaks(docs, bench))) == {(None, 10), (5, 10)}


def test_halves_of_an_item_in_two_rows_without_an_id_are_not_added_up(spark):
    words = [a + b for a in "bcdf" for b in "aeiouyrs"]
    halves = [(None, " ".join(words[:12] + ["x"] * 20)), (None, " ".join(["y"] * 20 + words[20:]))]
    docs = spark.createDataFrame(halves, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert leaks(docs, bench).collect() == [] and decontaminate(docs, bench, whole=True).count() == 2


def test_items_of_a_word_or_two_leave_ordinary_sentences_alone(spark):
    bench = spark.createDataFrame([(1, "Yes"), (2, "The answer"), (3, "42")], "item_id long, text string")
    clean = ["Yes we went there", "In 42 days the answer came", "The answer is 42 today"]
    copies = ["Is it? Yes. Good", "first line\nthe ANSWER\nlast line", "42"]
    docs = spark.createDataFrame(list(enumerate(clean + copies)), "doc_id long, text string")
    assert {r.doc_id for r in decontaminate(docs, bench, whole=True).collect()} == {0, 1, 2}
