"""Trace-level operators: trace table (E2, E3), event positions (F1), short-trace
filter (C4), trace assembly (E1).

No operator here gathers a whole trace into one task: per-trace numbers come from
partial aggregation, positions from the skew-safe ranking in :mod:`ranking`, and trace
text from bounded blocks joined by a distributed prefix scan (:mod:`prefixes`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailcast.operators.clean import is_complete
from trailcast.operators.ranking import row_number_within

LONG_MIN = -(1 << 63)
LONG_MAX = (1 << 63) - 1


def ts_key(ts: Column, missing_last: bool = True) -> Column:
    """Sortable long for a timestamp; missing timestamps sort last (pandas NaT) or first."""
    fill = LONG_MAX if missing_last else LONG_MIN
    return F.coalesce(F.unix_micros(ts.cast("timestamp")), F.lit(fill))


def trace_table(log: DataFrame, lifecycle_filter: bool = False) -> DataFrame:
    """One row per trace (E2, E3): end time and first position (``first_pos``, ties of the
    temporal split) over *all* events; number and first position (``trace_pos``, order of
    the prefix rows and of the dedup) of the events the cleaned log keeps.

    A single hash aggregation with map-side combine: a hot trace costs one partial row
    per input partition, never a whole task."""
    keep = is_complete(F.col("lifecycle")) if (lifecycle_filter and "lifecycle" in log.columns) \
        else F.lit(True)
    return (log.filter(F.col("case_id").isNotNull())
            .groupBy("case_id")
            .agg(F.coalesce(F.min(F.when(keep, F.col("event_pos"))), F.min("event_pos")).alias("trace_pos"),
                 F.min("event_pos").alias("first_pos"),
                 F.max("ts").alias("end_ts"),
                 F.count(F.lit(1)).alias("n_all"),
                 F.count_if(keep).alias("n")))


def end_key(end_ts: Column) -> Column:
    """End time as a sortable long; traces without timestamps take the minimum."""
    return F.coalesce(F.unix_micros(end_ts.cast("timestamp")), F.lit(LONG_MIN))


def event_positions(log: DataFrame, n_rows: int | None = None, **rank_opts) -> DataFrame:
    """0-based position ``idx`` in the trace, stable order (ts, event_pos); events
    without a timestamp go last."""
    keyed = log.withColumn("_tsk", ts_key(F.col("ts")))
    ranked = row_number_within(keyed, ["_tsk", "event_pos"], ["case_id"], name="_rn",
                               n_rows=n_rows, **rank_opts)
    return ranked.withColumn("idx", (F.col("_rn") - 1).cast("long")).drop("_rn", "_tsk")


def short_trace_filter(traces: DataFrame, min_events: int = 3) -> DataFrame:
    """C4: traces with two or fewer kept events yield no prefix."""
    return traces.filter(F.col("n") >= min_events)
