"""Splits: temporal trace split (G1), exact-size seeded row split (G2), complement (H3).

Sizes are ``int(N * p)`` with a DOUBLE product truncated, as in the reference. Ranking
runs on the narrow key table only (one row per trace / per prefix row) through the
skew-safe :func:`row_number_within`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailcast.operators.ranking import row_number_within
from trailcast.operators.traces import end_key


def test_size(n: int, share: float) -> int:
    return min(int(float(n) * float(share)), n)


def temporal_split(traces: DataFrame, test_share: float, zero_test_means_all: bool = False,
                   n_traces: int | None = None, **rank_opts) -> DataFrame:
    """G1: order traces by (end time, first position in the whole log); the last int(N*p)
    are test.

    Adds ``split`` ('retrieval' | 'test') and ``split_rank`` (1-based order)."""
    if n_traces is None:
        n_traces = traces.count()
    t = test_size(n_traces, test_share)
    if t == 0 and zero_test_means_all:
        t = n_traces  # reference slice quirk: [-0:] takes every trace
    keyed = traces.withColumn("_ek", end_key(F.col("end_ts")))
    place = "first_pos" if "first_pos" in traces.columns else "trace_pos"
    ranked = row_number_within(keyed, ["_ek", place], name="split_rank",
                               n_rows=n_traces, **rank_opts).drop("_ek")
    return ranked.withColumn(
        "split", F.when(F.col("split_rank") > F.lit(n_traces - t), F.lit("test"))
        .otherwise(F.lit("retrieval")))


def seeded_order_key(key: Column, seed: int) -> Column:
    """Deterministic pseudo-random order: md5 of the row key and the seed."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def row_split(rows: DataFrame, test_share: float, seed: int = 42, key: str = "dedup_key",
              n_rows: int | None = None, **rank_opts) -> DataFrame:
    """G2 + H3: exactly int(n*p) rows become test (seeded md5 order, ``_h`` where the rows
    have it already), the rest retrieval."""
    if n_rows is None:
        n_rows = rows.count()
    t = test_size(n_rows, test_share)
    keyed = rows if "_h" in rows.columns else rows.withColumn("_h", seeded_order_key(F.col(key), seed))
    ranked = row_number_within(keyed, ["_h", key], name="_srank", n_rows=n_rows,
                               materialize_input=True, **rank_opts)
    return ranked.withColumn("split", F.when(F.col("_srank") <= t, F.lit("test"))
                             .otherwise(F.lit("retrieval"))).drop("_h", "_srank")
