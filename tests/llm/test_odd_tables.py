"""All queries and the pipeline over tables with nulls in every column, repeated rows,
clashing extra columns, or no rows at all."""
import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trailcast.llm import decontaminate, queries, simhash, toxicity

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "embeddings", "labels")
CLASH = ("score", "fingerprint", "component_id", "row", "kept", "n_tokens", "ids", "words", "key", "fp", "secret", "start", "length", "n_words", "bad_id__", "rank", "item", "n", "component", "measure", "bin", "failed", "doc", "m", "by_word", "id", "v")
ALL = {**queries.QUERIES, "pipeline": corpus_pipeline.run}
PER_ROW = [k for k in queries.QUERIES if k.split("_")[0] not in ("op1", "op2", "op6", "op11", "op12")]


def odd(df):
    some = df.limit(30).cache()
    out = some.unionByName(some.limit(3))
    for c, t in df.dtypes:
        out = out.unionByName(some.limit(3).withColumn(c, F.lit(None).cast(t)))
    out = out.unionByName(some.limit(2).select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes]))
    for c in CLASH:
        out = out.withColumn(c, F.lit("x"))
    return out


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("odd")
    for name, change in (("odd", odd), ("empty", lambda df: df.limit(0))):
        for t in TABLES:
            change(spark.read.parquet(f"{SF}/{t}.parquet")).write.parquet(os.path.join(root, name, f"{t}.parquet"))
    return str(root)


@pytest.mark.parametrize("query", ALL)
def test_empty_tables(spark, folders, query):
    assert ALL[query](spark, f"{folders}/empty").count() == 0


@pytest.mark.parametrize("query", ALL)
def test_nulls_repeats_and_clashing_columns(spark, folders, query):
    rows = ALL[query](spark, f"{folders}/odd").collect()
    docs = spark.read.parquet(f"{folders}/odd/documents.parquet").count()
    if query in PER_ROW:
        assert len(rows) == docs
    elif query.startswith("op1_"):
        assert len(rows) == spark.read.parquet(f"{folders}/odd/embeddings.parquet").count()
        assert all((r.n_links, r.component_id) == (0, None) for r in rows if r.vec_id is None)
    elif query.startswith("op11_"):
        vectors = spark.read.parquet(f"{folders}/odd/embeddings.parquet").where("embedding is not null").count()
        assert len(rows) == 8 * vectors and {r.n for r in rows} == {vectors}
    elif query.startswith("op12_"):
        assert rows and all(r.score > 0 and 1 <= r["rank"] <= 20 for r in rows)
    else:
        assert len(rows) <= docs


def test_rows_without_ids_stay(spark):
    """A document without an id is one of its own: it goes only for what its text is."""
    docs = spark.createDataFrame([(None, "alone and quite unlike the others"), (None, "also alone, about something else"),
                                  (None, "one and the same text here"), (4, "one and the same text here"), (5, None)], "doc_id long, text string")
    kept = sorted((r.doc_id or 0, r.text or "") for r in simhash.keep_one(docs).collect())
    assert kept == [(0, "alone and quite unlike the others"), (0, "also alone, about something else"), (4, "one and the same text here"), (5, "")]
    bench = spark.createDataFrame([(None, "alone and quite unlike the others"), (7, None)], "item_id long, text string")
    left = decontaminate.remove_contaminated(docs, bench)
    assert left.count() == 4 and left.where("text like 'alone%'").count() == 0
    hit = decontaminate.contamination(docs, bench).where("contaminated").collect()
    assert [(r.n_hit, r.n_items, r.n_words) for r in hit] == [(6, 0, 6)]
    assert toxicity.remove_toxic(docs, toxicity.learn([], [], [])).count() == 5
