"""Cleaning operators (C1, C2, C5). Plain filters/projections: Catalyst pushes them
into the Parquet scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPLETE_VALUES = ["complete", "completed"]


def is_complete(lifecycle: Column) -> Column:
    """Trimmed, lower-cased lifecycle is complete/completed; missing never is."""
    v = F.lower(F.regexp_replace(lifecycle, "(?U)^\\s+|\\s+$", ""))
    return F.coalesce(v.isin(COMPLETE_VALUES), F.lit(False))


def lifecycle_filter(log: DataFrame, column: str = "lifecycle", enabled: bool = True) -> DataFrame:
    """Keep completed events when the log has a lifecycle column and the filter is on."""
    if not enabled or column not in log.columns:
        return log
    return log.filter(is_complete(F.col(column)))


def drop_trace_attributes(df: DataFrame, trace_identifier: str = "case:concept:name",
                          prefix: str = "case:") -> DataFrame:
    """Drop trace-level (``case:``) columns except the trace id."""
    keep = [c for c in df.columns if not c.startswith(prefix) or c == trace_identifier]
    return df.select(*[F.col(f"`{c}`") for c in keep])


def drop_null_cases(log: DataFrame) -> DataFrame:
    """Events without a trace id belong to no trace."""
    return log.filter(F.col("case_id").isNotNull())
