"""From raw documents to training sequences: five operators, each over all that the one before kept.

1. toxicity: documents predicted toxic go.
2. SimHash near-dedup: of each group of near copies the document with the least id stays.
3. substring dedup: repeated 13-word windows are cut out of the texts; untouched texts stay as they are.
4. benchmark decontamination: documents that leak a benchmark item go.
5. packing: the rest become sequences whose lengths are powers of two.

The first four return the columns of their input, with ``text`` and ``n_chars`` as changed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlark.llm import decontamination, packing, simhash, substring, toxicity
from postlark.llm.queries import remainder
from postlark.operators.spread import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~remainder("doc_id", 5, 0))
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_per_group(docs, shingle=3, distance=2)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Other columns travel under names that no operator uses.
    held = {c: f"held{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    done = substring.dedup_substrings(docs.withColumnsRenamed(held), carry=list(held.values()), keep_untouched=True)
    out = {c: F.col(name) for c, name in held.items()} | {"doc_id": F.col("id"), "text": F.col("kept_text")}
    if "n_chars" in held:
        changed = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(out["n_chars"])
        out["n_chars"] = changed.cast(docs.schema["n_chars"].dataType)
    return done.select(*[out[c].alias(c) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), whole=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_leaks),
    ("packing", pack),
]

ORACLE_SQL = None  # SQL expresses neither the model of the first stage nor the tokenizer of the last


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table of documents; each result is written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = cut(docs)
    return docs
