import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlark.llm import language, lm_scores, toxicity
from postlark.llm.queries import op2_language_id, op6_toxicity, remainder

from .fixtures import corpus, frame


def test_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    got = op2_language_id(spark, sf).join(docs, "doc_id").where("held_out and lang is not null").select("lang", "lang_pred", "score").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_language_cases(spark):
    model = language.fit(["the cat sat on the mat", "le chat est sur le tapis"] * 10, ["en", "fr"] * 10)
    texts = ["the mat", None, "", "12 34 !!", "le tapis " * 200_000, "x"]
    docs = spark.createDataFrame([(i, t, "de") for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string")
    got = {r.id: (r.lang_pred, r.score) for r in language.identify(docs, model).collect()}
    assert got[0][0] == "en" and got[4][0] == "fr" and got[1] == got[2] == got[3] == ("und", 0.0) and got[5][1] > 0
    (whole,), _ = model.predict(["le tapis " * 50])
    assert whole == "fr"
    empty = language.train(docs.where("false"), F.lit(True), lang_col="lang_pred")
    assert [r.lang_pred for r in language.identify(docs, empty).collect()] == ["und"] * 6
    assert language.identify(docs.where("false"), model).collect() == []


def test_slabs_add_up(monkeypatch):
    model = language.fit(["the cat sat on the mat", "le chat est sur le tapis"] * 10, ["en", "fr"] * 10)
    text = "le chat et the cat " * 40
    whole, _ = model.logits([text])
    monkeypatch.setattr(language, "SLAB", 97)
    parts, _ = model.logits([text])
    assert np.abs(whole - parts).max() < 0.2


def invented(toxic, seed, n=600):
    language = random.Random(0)
    pool = ["".join(language.choice(["th", "er", "on", "an", "re", "he"]) for _ in range(language.randint(1, 4))) for _ in range(300)]
    rnd = random.Random(seed)
    texts = []
    for _ in range(n):
        words = [rnd.choice(pool) for _ in range(rnd.randint(20, 200))]
        if toxic:
            words[::25] = [rnd.choice(["vejuq", "loweip"]) + rnd.choice(["s", "ed", "er", "on"]) for _ in words[::25]]
        texts.append(" ".join(words))
    return texts


def test_toxicity_learns_inflected_expressions():
    model = toxicity.fit(invented(True, 1, 150) + invented(False, 2, 450), [1] * 150 + [0] * 450, 0.25)
    bad, good = model.score(invented(True, 3, 200)), model.score(invented(False, 4, 200))
    assert (bad >= 0.5).mean() > 0.95 and (good < 0.5).mean() > 0.99


def test_toxicity_classes_are_distributions(monkeypatch):
    """The differences come from two normalised models: expected ratios of one under the other add up to one."""
    model = toxicity.fit_models(["bad bad worse"], ["good words here", "more good words"])
    assert set(model.grams) == set(range(toxicity.SHARED + 1, toxicity.ORDER + 1))
    long = " ".join(invented(False, 5, 30))
    whole = model.inputs([long])
    monkeypatch.setattr(toxicity, "SLAB", 500)
    parts = model.inputs([long])
    assert whole[1] == parts[1] and abs(whole[0] - parts[0])[0] < 1e-9


def test_toxicity_cases(spark):
    texts = [None, "", "  ", "12 ,.", "vejuqs vejuqed", "there"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    model = toxicity.fit(invented(True, 1, 60) + invented(False, 2, 60), [1] * 60 + [0] * 60, 0.2)
    got = {r.id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert len({got[i].score for i in range(4)}) == 1 and got[0].predicted == 0 and got[4].predicted == 1
    assert {r.doc_id for r in toxicity.drop_toxic(docs, model).collect()} == {0, 1, 2, 3, 5}
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, toxic int")
    empty = toxicity.train(docs, labels, F.lit(True))
    assert {r.score for r in toxicity.score_toxicity(docs, empty).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.where("false"), model).collect() == []


def held_out_toxicity(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").where("text is not null")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    learnt = docs.join(labels, "doc_id").where(~remainder("doc_id", 5, 0)).select("text").distinct()
    rows = docs.join(labels, "doc_id").where(remainder("doc_id", 5, 0)).join(learnt, "text", "left_anti").toPandas()
    model = toxicity.train(docs, labels, ~remainder("doc_id", 5, 0))
    rows["predicted"] = model.score(list(rows.text)) >= 0.5
    return rows


def test_toxicity_finds_held_out_texts_of_every_language(spark):
    rows = held_out_toxicity(spark, "/root/testdata/sf0.1")
    toxic, ordinary = rows[rows.toxic == 1], rows[rows.toxic == 0]
    assert ordinary.predicted.mean() < 0.02
    assert all(found > 0.75 for found in toxic.groupby("lang").predicted.mean()), toxic.groupby("lang").predicted.agg(["sum", "count"])


def test_toxicity_measures_do_not_depend_on_slabs(monkeypatch):
    model = toxicity.fit(invented(True, 1, 60) + invented(False, 2, 60), [1] * 60 + [0] * 60, 0.2)
    texts = ["", "one", " ".join(invented(True, 6, 12)), "two words", " ".join(invented(False, 7, 12)), "  "]
    whole, _ = model.measures(texts)
    for slab in (40, 97, 3000):
        monkeypatch.setattr(toxicity, "SLAB", slab)
        assert np.allclose(model.measures(texts)[0], whole)


def test_toxicity_query_on_the_tables(spark):
    got = op6_toxicity(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 200 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


@pytest.mark.parametrize("seed", [0])
def test_base_scores_equal_brute_force(spark, seed):
    rows = [(i, t) for i, t in corpus(seed=seed)]
    got = lm_scores.lm_scores(frame(spark, rows), ~remainder("doc_id", 7, 2)).collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) + ["\n"]
    counts = Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(split(t))
    total, kinds = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        w = split(t)
        want.append((i, len(w), sum(counts[x] > 0 for x in w), total, sum(math.log10((counts[x] + 1) / (total + kinds + 1)) for x in w)))
    key = lambda r: (repr(r[0]), *r[1:4], round(r[4], 6))
    have = sorted(key((r.id, r.n_tokens, r.n_known, r.train_tokens, r.base_score)) for r in got)
    assert [h[:4] for h in have] == [w[:4] for w in sorted(map(key, want))]
    assert np.allclose([h[4] for h in have], [w[4] for w in sorted(map(key, want))], atol=1e-5)
    copies = [r for r in got if r.n_tokens > 40 and r.id and r.id >= 300 and r.id < 308]
    assert all(r.score > r.base_score for r in copies)


@pytest.mark.parametrize("seed", [1])
def test_scores_hold_every_bigram(spark, seed):
    """Levels of bigrams seen once count too; false positives raise a score, nothing lowers it."""
    rows = [(i, t) for i, t in corpus(seed=seed)] + [(7001, "solus unicus semel"), (7000, "unicus semel alius")]
    got = lm_scores.lm_scores(frame(spark, rows), ~remainder("doc_id", 7, 2)).collect()
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "") + ["\n"]
    trains = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 != 2
    counts, pairs = Counter(), Counter()
    for i, t in rows:
        if trains(i):
            counts.update(split(t))
            pairs.update(zip(split(t), split(t)[1:]))
    total, kinds = sum(counts.values()), len(counts)
    base = lambda w: (counts[w] + 1) / (total + kinds + 1)
    level = lambda n: 2 ** (n.bit_length() - 1) if n else 0
    want = {}
    for i, t in rows:
        w = split(t)
        p = [base(w[0])] + [0.5 * min(level(pairs[a, b]) / counts[a], 1) + 0.5 * base(b) if counts[a] else base(b) for a, b in zip(w, w[1:])]
        want.setdefault((i, len(w), round(sum(math.log10(base(x)) for x in w), 4)), sum(map(math.log10, p)))
    gaps = [r.score - want[r.id, r.n_tokens, round(r.base_score, 4)] for r in got]
    assert min(gaps) > -1e-6 and np.mean(np.array(gaps) < 1e-6) > 0.7
    assert sum(n == 1 for n in pairs.values()) > 100


def test_lm_cases(spark):
    assert lm_scores.lm_scores(frame(spark, []), F.lit(True)).collect() == []
    got = lm_scores.lm_scores(frame(spark, [(1, "a b"), (2, None)]), F.lit(False)).orderBy("id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)]


def test_filter_reads_levels_back():
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)
    counts = rng.integers(2, 1000, 5000)
    buckets = 64
    bucket = lm_scores.C.bucket_of(hashes, buckets)
    keys, level = hashes & np.uint64((1 << 48) - 1), lm_scores.levels(counts)
    bits = -(-int((level - 1).sum()) * lm_scores.BITS // lm_scores.SEGMENTS // 8) * 8
    segment = lm_scores.segment_of(bucket, buckets)
    fields = {int(s): lm_scores.segment_bits(bits, 2, keys[segment == s], bucket[segment == s], level[segment == s]) for s in np.unique(segment)}
    built = lm_scores.LogFrequencyFilter(bits, 2, buckets, fields)
    read = built.counts(hashes)
    assert (read >= 2.0 ** (level - 1)).all() and (read == 2.0 ** (level - 1)).mean() > 0.98
    assert (built.counts(rng.integers(0, 1 << 63, 20000, dtype=np.uint64)) > 0).mean() < 0.01
    assert (built.counts(hashes[:0]) == 0).all()
