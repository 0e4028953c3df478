import corpus_pipeline
from postlark.llm import decontamination, simhash, substring
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_apply_their_operators(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        path = str(tmp_path / name)
        out.write.parquet(path)
        out = spark.read.parquet(path)
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "simhash_near_dedup":
            groups = simhash.simhash_groups(docs).collect()
            assert {r.doc_id for r in out.collect()} == {g.component_id for g in groups}
        if name == "substring_dedup":
            removed = {r.id: r.n_removed for r in substring.dedup_substrings(docs).collect()}
            before = {r.doc_id: r.text for r in docs.collect()}
            for r in out.collect():
                assert removed[r.doc_id] or r.text == before[r.doc_id]
                assert not removed[r.doc_id] or r.n_chars == len(r.text)
        if name == "benchmark_decontamination":
            leaked = {r.doc_id for r in decontamination.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert {r.doc_id for r in out.collect()} == ids - leaked
        if name != "packing":
            assert out.columns == columns
            kept[name] = out.count()
            docs = out
        else:
            assert {r.doc_id for r in out.select("doc_id").collect()} == ids
    assert 0 < kept["benchmark_decontamination"] <= kept["simhash_near_dedup"] <= kept["toxicity"] <= 200
    assert corpus_pipeline.run(spark, SF).agg(F.sum("length")).first()[0] == out.agg(F.sum("length")).first()[0]


def test_stages_keep_awkward_columns_nulls_and_empty_tables(spark):
    schema = "doc_id long, text string, n_chars int, n_words string, id string, kept_text string, _gone int, leaked_id int, score string, held0 int"
    long = "alpha beta gamma delta " * 30 + "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(1, long, 5, "a", "b", "c", 1, 2, "s", 9), (2, "x " + long + " unlike ending", None, None, None, None, None, None, None, None),
            (3, None, None, "q", None, None, None, 3, "t", 1), (4, "", 0, None, "z", None, 4, None, None, 2), (None, "lonely words", 3, "n", "n", "n", 0, 0, "n", 0)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.where("false"), SF)
        assert empty.count() == 0
        out = stage(spark, docs, SF)
        if name == "packing":
            assert out.where("doc_id is null").count() > 0
            continue
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        kept = {r.doc_id: r for r in out.collect()}
        before = {r.doc_id: r for r in docs.collect()}
        assert set(kept) >= {1, None}
        for key, r in kept.items():
            assert [r[c] for c in docs.columns[3:]] == [before[key][c] for c in docs.columns[3:]]
        if name == "simhash_near_dedup":
            assert set(kept) >= {1, 3, None} and 4 not in kept
        if name == "substring_dedup":
            assert kept[1].text == long and kept[2].text == "x unlike ending" and kept[2].n_chars == len(kept[2].text) and kept[3].text is None
