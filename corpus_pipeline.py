"""A corpus pipeline: each stage takes the documents its predecessor kept and returns documents, the last one packs them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.llm import shared
from timeloom.llm.decontamination import contaminated
from timeloom.llm.ngram_join import ngram_join
from timeloom.llm.packing import pack
from timeloom.llm.queries import byte_bpe, learnable
from timeloom.llm.suffix_dedup import suffix_dedup
from timeloom.llm.toxicity import toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.5 or more go; the labels to learn from are those of op7."""
    labels = learnable(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity(docs, labels, docs.columns).where("score < 0.5").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays: that with the smallest id. Rows without id are linked with nothing, so they stay."""
    kept = ngram_join(docs, width=5, percent=80).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that an earlier document has go; documents of which nothing is left go."""
    cut = suffix_dedup(docs, length=50)
    kept = cut.where("n_removed = 0 or length(kept_text) > 0").withColumnRenamed("kept_text", "text")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a test item go."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens, as op3 returns them."""
    return pack(docs, byte_bpe(), capacity=1024, end=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_documents),
]

#: no stage but decontamination can be written in SQL; tests/llm compares ngram_jaccard_join, suffix_array_dedup, decontamination and packing with
#: brute force on documents given to them; toxicity only as an operator, on held-out documents
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each one's result is written to the shared folder and read again, and what it and its predecessor left there goes."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared.table_path(spark, name)
        with shared.scope(spark):
            docs = shared.stored(stage(spark, docs, sf_dir), name, path=path)
        if before is not None:
            shared.discard(before)
        before = docs
    return docs
