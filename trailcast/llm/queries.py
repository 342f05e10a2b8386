"""The dealt operators' queries over the given tables, with their contract columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailcast.llm import bpe, decontaminate, embeddings, lexical_search, licenses, quality, quality_rules, secret_scan, simhash, suffix_dedup, token_files, toxicity, whitening


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.fit(docs))


def op3_benchmark_decontamination(spark, sf_dir):
    hits = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_quality_classifier(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bpe_round_trip(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), bpe.tokenizer_file("word_bpe_49k.json"))


def op6_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_token_files(spark, sf_dir):
    return token_files.index_of_documents(table(spark, sf_dir, "documents"), bpe.tokenizer_file("byte_bpe_50k.json"))


def op8_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_toxicity(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_suffix_dedup(spark, sf_dir):
    rows = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_bytes=False)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("repeats"))


def op11_embedding_whitening(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors)).withColumn("deviation", F.col("deviation").cast("long"))


def op12_lexical_search(spark, sf_dir):
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_quality_rules(spark, sf_dir):
    rows = quality_rules.rules(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {f.__name__: f for f in (op1_embedding_near_dedup, op2_secret_scan, op3_benchmark_decontamination, op4_quality_classifier, op5_bpe_round_trip, op6_license_scan, op7_token_files, op8_simhash_near_dedup, op9_toxicity, op10_suffix_dedup, op11_embedding_whitening, op12_lexical_search, op13_quality_rules)}
ORACLE: dict[str, str] = {"op6_license_scan": licenses.oracle_sql(), "op12_lexical_search": lexical_search.oracle_sql(), "op13_quality_rules": quality_rules.oracle_sql()}
