"""The registered queries of this subpackage: each applies one operator, whole, and derives its digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlark.llm import decontamination, language, lm_scores, manifest, packing, quality, simhash, toxicity, urls, vectors
from postlark.llm.cover_tree import near_vectors
from postlark.llm.hard_negatives import hard_negatives
from postlark.llm.run_index import dedup_byte_runs
from postlark.llm.substring import dedup_substrings

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select("doc_id", "text")


def op1_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Words of repeated 13-word windows removed."""
    done = dedup_substrings(_documents(spark, sf))
    return done.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Predicted languages, learned from three quarters of the ids."""
    docs = _table(spark, sf, "documents")
    model = language.train(docs, ~remainder("doc_id", 4, 2))
    done = language.identify(docs, model)
    return done.select(F.col("id").alias("doc_id"), remainder("id", 4, 2).alias("held_out"), "lang_pred", "score")


def op3_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Power-of-two pieces of every document."""
    pieces = packing.pack(_documents(spark, sf), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


URL_RULES = """
VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
       ('com', '/fr/', 'allow'), ('com', '/de/', 'block') AS rules(host, path, verdict)
"""


def op4_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    """The rule and verdict of every page."""
    return urls.filter_urls(_table(spark, sf, "pages").select("page_id", "url"), spark.sql(URL_RULES)).drop("url")


def op5_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and the benchmark items they leak."""
    return decontamination.leaks(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity scores, learned from four fifths of the ids."""
    docs = _table(spark, sf, "documents")
    model = toxicity.train(docs, _table(spark, sf, "labels"), ~remainder("doc_id", 5, 0))
    done = toxicity.score_toxicity(docs, model)
    return done.select(F.col("id").alias("doc_id"), remainder("id", 5, 0).alias("held_out"), "score", "predicted")


def op7_lm_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Language-model scores, learned from six sevenths of the ids."""
    done = lm_scores.lm_scores(_documents(spark, sf), ~remainder("doc_id", 7, 2))
    columns = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return done.select(F.col("id").alias("doc_id"), remainder("id", 7, 2).alias("held_out"), *columns)


def op8_run_length_index(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of repeated 50-byte strings removed."""
    done = dedup_byte_runs(_documents(spark, sf))
    return done.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and verdict of every document."""
    done = quality.judge_quality(_documents(spark, sf), _table(spark, sf, "labels"))
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return done.select("doc_id", *columns, "n_lines", "n_upper", "rejected_by")


def op10_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint and component of every document."""
    done = simhash.simhash_groups(_documents(spark, sf))
    return done.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def documents_manifest(docs: DataFrame, depth: int = manifest.DEPTH) -> DataFrame:
    """The manifest of documents by language; where 3 divides the id's crc32 the text given for checking has no capitals."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = manifest.digest([*fields[:4], F.translate("text", capitals, capitals.lower())])
    return manifest.manifest(docs, "lang", "doc_id", manifest.digest(fields), F.when(remainder("doc_id", 3, 0), tampered), depth)


def op11_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Leaf, subroot, root, proof and verification of every document."""
    return documents_manifest(_table(spark, sf, "documents")).drop("grp")


def op12_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Hard negatives of every fiftieth vector."""
    rows = _table(spark, sf, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    counted = F.when(vectors.whole("embedding"), F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * 256)))
    return hard_negatives(rows.withColumns({"label": shifted, "embedding": counted}), F.col("vec_id") % 50 == 0)


def op13_near_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Links and component of every vector."""
    done = near_vectors(_table(spark, sf, "embeddings"))
    kept = F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    return done.select(F.col("id").alias("vec_id"), "n_links", "component_id", kept)


def remainder(id_col: str, modulus: int, value: int) -> Column:
    """Whether the crc32 of the id as text has this remainder; a null id has none."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == value, F.lit(False))


def queries() -> dict[str, Query]:
    listed = (
        op1_substring_dedup, op2_language_id, op3_packing, op4_url_filters, op5_decontamination, op6_toxicity,
        op7_lm_scores, op8_run_length_index, op9_quality_rules, op10_simhash, op11_merkle_manifest,
        op12_hard_negatives, op13_near_embeddings,
    )
    return {f.__name__: f for f in listed}
