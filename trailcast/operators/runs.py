"""Run bookkeeping: history entries and grouping (E11), latest report per variant (B8),
run grid (D5), table equality (H2), per-dataset run report (E12)."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailcast.functions.naming import eval_config, eval_config_key
from trailcast.functions.text import format_duration
from trailcast.operators.ranking import row_number_within

RUN_FIELDS = ["timestamp", "run_label", "top_k", "max_rows", "reranker_model", "rerank_pool_k"]


def history_entries(reports: DataFrame) -> DataFrame:
    """One row per (run, report): config struct, config key and the entry. Run-level
    top_k / reranker / pool override report-level ones; max_rows comes from the run.

    Input columns: timestamp, run_label, run_top_k, max_rows, run_reranker_model,
    run_rerank_pool_k, dataset, model_id, llm, prompt_variant, top_k, reranker_model,
    rerank_pool_k, plus any metric columns."""
    cfg = eval_config(
        F.col("dataset"), F.col("model_id"), F.col("llm"), F.col("prompt_variant"),
        F.coalesce("run_top_k", "top_k"), F.col("max_rows"),
        F.coalesce("run_reranker_model", "reranker_model"),
        F.coalesce("run_rerank_pool_k", "rerank_pool_k"))
    return reports.withColumn("config", cfg).withColumn("config_key", eval_config_key(F.col("config")))


def explode_runs(runs: DataFrame) -> DataFrame:
    """Legacy / appended run records (one row per run with a ``reports`` array) -> one row
    per report, run-level fields kept beside the report fields."""
    r = runs.select(*[F.col(c).alias(f"run_{c}" if c in ("top_k", "reranker_model", "rerank_pool_k") else c)
                      for c in RUN_FIELDS], F.explode("reports").alias("_rep"))
    return r.select("*", "_rep.*").drop("_rep")


def group_history(entries: DataFrame) -> DataFrame:
    """Per config key the number of runs, first / last timestamp and the latest
    entry (bounded aggregates, map-side combined; the full entry list stays in the
    append-only run table)."""
    return entries.groupBy("config_key").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"),
        F.max(F.struct("timestamp", "run_label"))["run_label"].alias("last_run_label"),
        F.first("config.split_type", ignorenulls=True).alias("split_type"))


def latest_per_key(reports: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Keep only the newest report per key (arg-max aggregation on ``order``)."""
    payload = [c for c in reports.columns if c != key]
    best = F.max(F.struct(*[F.col(c) for c in order], *[F.col(c).alias(f"_p_{c}") for c in payload]))
    return reports.groupBy(key).agg(best.alias("_b")).select(
        key, *[F.col(f"_b._p_{c}").alias(c) for c in payload])


def run_grid(datasets: DataFrame, models: list[str], dataset: str = "dataset") -> DataFrame:
    """Every dataset x every model, dataset-major order, as ``grid_pos`` (0-based).
    Models are a short configuration list, expanded with ``posexplode`` (no cross join)."""
    d = datasets.select(dataset).distinct()
    ranked = row_number_within(d, [dataset], name="_dr")
    g = ranked.select(dataset, "_dr", F.posexplode(F.array(*[F.lit(m) for m in models]))
                      .alias("_mi", "model_id"))
    return g.select(((F.col("_dr") - 1) * len(models) + F.col("_mi")).cast("long").alias("grid_pos"),
                    dataset, "model_id")


def table_equality(a: DataFrame, b: DataFrame) -> DataFrame:
    """H2: multiset equality on the first column and on whole rows (order ignored,
    duplicates count), as one row (same_first_column, same_rows).

    Each side is read once: rows are tagged +1 / -1 and summed per whole row, then per
    first column; the multisets are equal iff every sum is zero."""
    cols = [f"_c{i}" for i in range(len(a.columns))]
    tagged = a.toDF(*cols).withColumn("_t", F.lit(1)).unionByName(
        b.toDF(*cols).withColumn("_t", F.lit(-1)))
    if len(cols) == 1:
        per = tagged.groupBy(*cols).agg(F.sum("_t").alias("_s"))
        n = per.agg(F.count_if(F.col("_s") != 0).alias("n"))
        return n.select((F.col("n") == 0).alias("same_first_column"), (F.col("n") == 0).alias("same_rows"))
    # one aggregation for both groupings: GROUPING SETS ((all columns), (first column))
    sums = tagged.groupingSets([cols, [cols[0]]], *cols).agg(
        F.sum("_t").alias("_s"), F.grouping_id().alias("_g"))
    n = sums.agg(F.count_if((F.col("_g") != 0) & (F.col("_s") != 0)).alias("n1"),
                 F.count_if((F.col("_g") == 0) & (F.col("_s") != 0)).alias("n2"))
    return n.select((F.col("n1") == 0).alias("same_first_column"), (F.col("n2") == 0).alias("same_rows"))


def execution_report(spark: SparkSession, datasets: dict[str, Callable[[], DataFrame]],
                     writer: Callable[[str, DataFrame], str | None] | None = None) -> DataFrame:
    """Run one job per dataset (a failure is recorded, the others go on); rows out,
    elapsed time and error per dataset. ``writer(name, df)`` may persist the output and
    return its path, whose size is then reported."""
    rows = []
    for name, job in datasets.items():
        t0 = time.perf_counter()
        out_rows, size, error = None, None, None
        try:
            df = job()
            if writer is not None:
                path = writer(name, df)
                out = spark.read.parquet(path)
                out_rows = out.count()
                files = out.select(F.col("_metadata.file_path").alias("f"),
                                   F.col("_metadata.file_size").alias("s")).distinct()
                size = files.agg(F.sum("s")).first()[0]     # each file once
            else:
                out_rows = df.count()
        except Exception as e:  # one bad dataset must not stop the others
            error = f"{type(e).__name__}: {e}"
        rows.append((name, out_rows, size, time.perf_counter() - t0, error))
    df = spark.createDataFrame(rows, "dataset string, output_rows long, output_bytes long, "
                                     "elapsed_sec double, error string")
    from trailcast.functions.text import bytes_to_mb
    return df.withColumn("elapsed", format_duration(F.col("elapsed_sec"))) \
        .withColumn("output_size_mb", bytes_to_mb(F.col("output_bytes")))
