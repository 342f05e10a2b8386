"""Corpus pipeline: documents -> toxicity -> near-duplicates -> decontamination -> secrets ->
token ids. Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and
returns a DataFrame; :func:`run` writes each as Parquet and reads it again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trailcast.llm import bpe, decontaminate, secret_scan, simhash, toxicity
from trailcast.llm.queries import table
from trailcast.llm.scratch import Scratch


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon doesn't reject (learned from the labels of
    documents that aren't held out)."""
    return toxicity.remove_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints that differ in at most 3 bits."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secret_scan.redact(docs, secret_scan.fit(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of ids and decoded text."""
    return bpe.round_trip(docs, bpe.tokenizer_file("word_bpe_49k.json"), with_ids=True)


STAGES = [("toxicity", toxicity_filter), ("simhash_near_dedup", near_duplicates), ("decontamination", decontamination), ("secret_scan", secrets), ("bpe", tokens)]

#: SQL can't express the stages (learned lexicon, fingerprints, forest, BPE); tests/llm compares
#: them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
