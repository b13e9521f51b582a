"""Cleaning a corpus: quality, toxicity, near-duplicates, benchmark passages, then packing into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioframe.llm import decontaminate, packing, quality, simhash, tokens, toxicity
from folioframe.llm.common import SCRATCH, delete_scratch, materialize, release, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # smaller than packing's own: the executor's heap has grown in the stages before
    return packing.pack_documents(docs, tokens.tokenizer_file("byte_bpe_50k.json"), 1, chunk=1_000_000, words=200_000)


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("simhash_dedup", dedup_stage), ("decontamination", decontamination_stage), ("packing", packing_stage)]

#: Language models, tokenizers and codes are no SQL: tests/llm holds each stage of a run against its definition.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the sequences that the kept documents make: each stage works on all that the one before it kept,
    written and read again. What a stage wrote for itself goes once its result stands, and so does its input."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        before = len(SCRATCH)
        out = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        delete_scratch(spark, [out], before)
        if last is not None:
            release(last)
        docs = last = out
    return docs
