"""Table sources: prefix tables (A3), run history JSON (A4), attribute labels (A5).

Every reader declares its schema; nothing is inferred (labels such as ``NA`` or
``null`` stay text)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX_SCHEMA = "prefix string, prediction string"

REPORT_TYPE = T.StructType([
    T.StructField("dataset", T.StringType()), T.StructField("model_id", T.StringType()),
    T.StructField("llm", T.StringType()), T.StructField("prompt_variant", T.StringType()),
    T.StructField("top_k", T.LongType()), T.StructField("reranker_model", T.StringType()),
    T.StructField("rerank_pool_k", T.LongType()), T.StructField("total_samples", T.LongType()),
    T.StructField("correct_predictions", T.LongType()), T.StructField("accuracy", T.DoubleType()),
    T.StructField("precision_macro", T.DoubleType()), T.StructField("recall_macro", T.DoubleType()),
    T.StructField("f1_macro", T.DoubleType()),
    T.StructField("skipped_invalid_predictions", T.LongType()),
])
RUN_TYPE = T.StructType([
    T.StructField("timestamp", T.StringType()), T.StructField("run_label", T.StringType()),
    T.StructField("top_k", T.LongType()), T.StructField("max_rows", T.LongType()),
    T.StructField("reranker_model", T.StringType()), T.StructField("rerank_pool_k", T.LongType()),
    T.StructField("reports", T.ArrayType(REPORT_TYPE)),
])
ENTRY_TYPE = T.StructType([T.StructField("timestamp", T.StringType()),
                           T.StructField("run_label", T.StringType()),
                           T.StructField("metrics", REPORT_TYPE)])
KEYED_TYPE = T.MapType(T.StringType(), T.StructType([
    T.StructField("config", T.MapType(T.StringType(), T.StringType())),
    T.StructField("runs", T.ArrayType(ENTRY_TYPE))]))


def read_prefix_table(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A3: ``prefix,prediction`` rows; CSV with header, quoted multi-line fields."""
    if fmt == "csv":
        return (spark.read.schema(PREFIX_SCHEMA).option("header", "true").option("multiLine", "true")
                .option("quote", '"').option("escape", '"').option("nullValue", None)
                .option("emptyValue", "").csv(path))
    return spark.read.schema(PREFIX_SCHEMA).format(fmt).load(path)


def _strip_bom(c):
    return F.regexp_replace(c, "^﻿", "")


def read_run_history(spark: SparkSession, path: str) -> DataFrame:
    """A4: history file in either layout -> one row per (config key, run entry).

    Legacy layout (a JSON list of runs) is exploded run -> report with run-level settings
    overriding report-level ones; the keyed layout (object config_key -> {config, runs}) is
    exploded as stored. Output: config_key (null for legacy rows, derived later by
    :func:`trailcast.operators.runs.history_entries`), timestamp, run_label, report fields."""
    raw = spark.read.text(path, wholetext=True).select(F.trim(_strip_bom(F.col("value"))).alias("doc"))
    legacy = raw.filter(F.col("doc").startswith("[")).select(
        F.explode(F.from_json("doc", T.ArrayType(RUN_TYPE))).alias("run"))
    legacy = legacy.select(F.col("run.timestamp").alias("timestamp"), F.col("run.run_label").alias("run_label"),
                           F.col("run.top_k").alias("run_top_k"), F.col("run.max_rows").alias("max_rows"),
                           F.col("run.reranker_model").alias("run_reranker_model"),
                           F.col("run.rerank_pool_k").alias("run_rerank_pool_k"),
                           F.explode("run.reports").alias("rep")).select("*", "rep.*").drop("rep") \
        .withColumn("config_key", F.lit(None).cast("string"))
    keyed = raw.filter(F.col("doc").startswith("{")).select(
        F.explode(F.from_json("doc", KEYED_TYPE)).alias("config_key", "entry"))
    keyed = keyed.select("config_key", F.col("entry.config").alias("config_map"),
                         F.explode("entry.runs").alias("run")).select(
        "config_key", F.col("run.timestamp").alias("timestamp"), F.col("run.run_label").alias("run_label"),
        F.col("config_map")["top_k"].cast("long").alias("run_top_k"),
        F.col("config_map")["max_rows"].cast("long").alias("max_rows"),
        F.col("config_map")["reranker_model"].alias("run_reranker_model"),
        F.col("config_map")["rerank_pool_k"].cast("long").alias("run_rerank_pool_k"),
        "run.metrics.*")
    return legacy.unionByName(keyed)


def read_attribute_labels(spark: SparkSession, path: str) -> DataFrame:
    """A5: JSON object abbr -> label as rows (abbr, label); a missing file or an empty
    object gives no rows (no legend)."""
    empty = spark.createDataFrame([], "abbr string, label string")
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty                            # missing file: no legend
    parsed = raw.select(F.from_json(_strip_bom(F.col("value")),
                                    T.MapType(T.StringType(), T.StringType())).alias("m"))
    return parsed.select(F.explode("m").alias("abbr", "label"))
