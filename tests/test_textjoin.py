import random

import pytest
from pyspark.sql import functions as F

from postlark.operators import textjoin
from postlark.operators.spread import cut

TEXTS = [
    "senior python engineer", "", None, "java and javascript", "C++ / c# dev", "ab", "a", "été à paris 𝒳𝒴z",
    "x" * 5000 + " needle " + "y" * 5000, "line one\nline two", "100% remote (eu)", "pythonic python python",
]


def table(spark, texts=TEXTS):
    return cut(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row long, text string"))


def test_containing_equals_every_search(spark):
    words = ["python", "java", "a", "", "c++", "c#", "needle", "e\nline", "été", "𝒳𝒴", "xx", "nowhere", "python", "PYTHON", "(eu)", "100%", "javascripts"]
    got = textjoin.containing(table(spark), spark.createDataFrame([(w,) for w in words], "word string"))
    want = {(i, w) for i, t in enumerate(TEXTS) for w in words if t is not None and w in t}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert textjoin.containing(table(spark), spark.createDataFrame([], "word string")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_containing_on_random_texts(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 60))) for _ in range(150)]
    words = {"".join(rng.choice("abc ") for _ in range(rng.randint(1, 7))) for _ in range(200)}
    got = textjoin.containing(table(spark, texts), spark.createDataFrame([(w,) for w in words], "word string"))
    assert {tuple(r) for r in got.collect()} == {(i, w) for i, t in enumerate(texts) for w in words if w in t}


@pytest.mark.parametrize(
    "pattern,want",
    [
        ("(?i)unpaid", ["unpaid"]), (r"\bintern(ship)?\b", ["intern"]), ("abc|de+f", ["abc", "de"]), ("colou?r", ["colo"]), ("a*", []),
        ("x|", []), ("[abc]def", ["def"]), (r"c\+\+", ["c++"]), ("(foo|bar)", []), ("(?x) a b", []), (r"\Qa.b\E", []), ("ab{0,2}c", ["a"]),
        ("^start.*end$", ["start"]), (r"\d{3}-long", ["-long"]), ("(?<n>a)bcd", []), ("[]x]yes", []), ("straße", ["stra"]), ("(?:a[)]b)cde", ["cde"]),
    ],
)
def test_literals(pattern, want):
    assert textjoin.literals(pattern) == want


def test_matching_equals_every_pattern(spark):
    texts = ["Unpaid INTERNSHIP", "internal", "no match", "", None, "5 years of C++", "İntern", "maſter", "colour and color", "one\ntwo", "KKlvin"]
    patterns = [r"(?i)unpaid", r"(?i)\bintern(ship)?\b", r"^$", r"c\+\+", r"(?i)c\+\+", r"\d+ years", "colou?r", "one.two", "(?s)one.two", "(?i)master", "(?i)kkl", "x|match", "[0-9]"]
    rows = table(spark, texts)
    got = textjoin.matching(rows, spark.createDataFrame([(p,) for p in patterns], "pattern string"))
    each = [rows.where(F.col("text").rlike(textjoin.FLAGS + p)).select("row", F.lit(p).alias("pattern")) for p in patterns]
    want = {tuple(r) for part in each for r in part.collect()}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 10


def test_many_patterns_are_rows_not_expressions(spark):
    patterns = spark.range(5_000).select(F.format_string("(?i)skill%d\\b", "id").alias("pattern"))
    texts = table(spark, [f"Skill{i} and skill{i + 1}0" for i in range(0, 5000, 50)])
    got = textjoin.matching(texts, patterns)
    assert len(got._jdf.queryExecution().analyzed().toString()) < 20_000
    want = {(k, f"(?i)skill{j}\\b") for k, i in enumerate(range(0, 5000, 50)) for j in (i, 10 * (i + 1)) if j < 5000}
    assert {tuple(r) for r in got.collect()} == want


def test_patterns_without_case_are_the_same(spark):
    texts = ["Skills. SKILLED, skill", "ſkill,", "sKıll.", "\u212aind.", "SKİLL,", "kind", "Kind!", "colour, Color.", "ÇKILL. skille."]
    patterns = ["(?i)skill(s|ed)?[.,]", "(?i)kind[.!]", "(?i)colou?r[,]", "(?i)skill", "skill(s|ed)?[.,]", "(?i)(kind|z)?"]
    assert textjoin.spelled(patterns[0]) == ["skills.", "skills,", "skilled.", "skilled,", "skill.", "skill,"]
    assert textjoin.spelled(patterns[2]) == ["colour,", "color,"] and textjoin.spelled("(?i)a?") == ["a", ""]
    assert [textjoin.spelled(p) for p in (patterns[4], r"(?i)\bskill", "(?i)S", "(?i)a.b", "(?i)" + "[ab]" * 7)] == [None] * 5
    rows = table(spark, texts)
    got = textjoin.matching(rows, spark.createDataFrame([(p,) for p in patterns], "pattern string"))
    each = [rows.where(F.col("text").rlike(textjoin.FLAGS + p)).select("row", F.lit(p).alias("pattern")) for p in patterns]
    want = {tuple(r) for part in each for r in part.collect()}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 10


def test_strings_of_long_texts_come_once(monkeypatch):
    """A string across the border of two blocks is found, and one in several pieces of a text comes once."""
    import pyarrow as pa

    monkeypatch.setattr(textjoin, "BLOCK", 16)
    texts = ["x" * 14 + "needle12" + "y" * 30 + "needle12", None, "", "needle1", "needle12", "needle12" * 9]
    column = pa.array([t if t is None else t.encode() for t in texts], pa.binary())
    got = sorted((int(i), g) for places, grams in textjoin._found(column, [0, 1, 8], None) for i, g in zip(places, grams))
    want = {(i, t[k : k + n]) for i, t in enumerate(texts) if t is not None for n in (0, 1, 8) for k in range(len(t) - n + 1)}
    assert got == sorted(want)


def test_long_words_and_repeated_rows(spark):
    long = "a word of more than sixteen letters"
    rows = spark.createDataFrame([(1, f"here is {long}."), (1, "here"), (2, "a word of more than"), (3, long[1:]), (None, long), (4, None)], "row long, text string")
    words = spark.createDataFrame([(w,) for w in (long, "here", "word of more tha")], "word string")
    got = sorted(tuple(r) for r in textjoin.containing(cut(rows), words).collect())
    assert got == sorted([(1, long), (1, "here"), (1, "word of more tha"), (1, "here"), (2, "word of more tha"), (3, "word of more tha")])
