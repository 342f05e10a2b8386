"""Skew-safe, deterministic row numbering.

``row_number() over (partition by g order by k)`` puts every group into one task and an
unpartitioned window puts the whole table into one task. :func:`row_number_within` gives
the same numbers without either:

* small inputs (row count checked against ``small_rows``) use the plain window - the whole
  input is proven small, so one task can hold any group of it;
* larger inputs are range-partitioned and sorted by the full key (group + order columns)
  and written once with their place, so a hot group spans many buckets. Spark picks the
  range bounds, no key reaches this library's driver code or the plan. Within a bucket
  only its first group can have begun in an earlier one, so the offsets are at most one
  row per bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SMALL_ROWS = 2_000_000         # plain window below this many rows
ROWS_PER_BUCKET = 250_000      # target rows per range bucket, and per task of what follows, above it
MAX_BUCKETS = 10_000           # tasks of the sort; larger buckets spill, nothing is held in memory
PLACE_BITS = 33                # monotonically_increasing_id(): partition, then place in it


def tasks_for(spark: SparkSession, n_rows: int, small_rows: int = SMALL_ROWS,
              rows_per_bucket: int = ROWS_PER_BUCKET) -> int | None:
    """Tasks that share ``n_rows`` out so that each takes about ``rows_per_bucket`` of them however
    many there are; None for a small input, which takes the session's shuffle partitions."""
    if n_rows <= small_rows:
        return None
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MAX_BUCKETS, math.ceil(n_rows / rows_per_bucket)))


def row_number_within(df: DataFrame, order_cols: list[str], partition_cols: list[str] = (),
                      name: str = "rn", n_rows: int | None = None,
                      small_rows: int = SMALL_ROWS, rows_per_bucket: int = ROWS_PER_BUCKET,
                      materialize_input: bool = False) -> DataFrame:
    """Append ``name`` = 1-based row number within ``partition_cols`` ordered by
    ``order_cols`` ascending. ``order_cols`` must be unique within a group.

    On the range path the input is read twice (Spark's bounds sample, then the sort). Pass
    ``materialize_input=True`` when it is an expensive derived table: it is then written
    once to the checkpoint folder instead of being computed twice."""
    from trailcast.session import materialize
    partition_cols, order_cols = list(partition_cols), list(order_cols)
    if n_rows is None:
        n_rows = df.count()
    if n_rows <= small_rows:
        w = Window.partitionBy(*partition_cols) if partition_cols else Window.partitionBy()
        return df.withColumn(name, F.row_number().over(w.orderBy(*order_cols)).cast("long"))

    if materialize_input:
        df = materialize(df)
    keys = partition_cols + order_cols
    n_buckets = min(MAX_BUCKETS, max(2, math.ceil(n_rows / rows_per_bucket)))
    placed = materialize(df.repartitionByRange(n_buckets, *keys).sortWithinPartitions(*keys)
                         .withColumn("_at", F.monotonically_increasing_id())) \
        .withColumn("_bkt", F.shiftright("_at", PLACE_BITS))

    counts = placed.groupBy("_bkt", *partition_cols).agg(F.count(F.lit(1)).alias("_cnt"))
    run = Window.partitionBy(*partition_cols).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.sum("_cnt").over(run)).filter("_off > 0").select(
        F.col("_bkt").alias("_b"), "_off", *[F.col(c).alias(f"_g{i}") for i, c in enumerate(partition_cols)])
    if partition_cols:
        local = F.row_number().over(Window.partitionBy("_bkt", *partition_cols).orderBy("_at"))
        # a bucket's part of a group is the largest key: the window's tasks grow with the rows
        placed = placed.repartition(tasks_for(df.sparkSession, n_rows, small_rows, rows_per_bucket), "_bkt", *partition_cols)
    else:
        local = F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) + 1
    on = F.col("_bkt") == F.col("_b")
    for i, c in enumerate(partition_cols):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    # at most one row per bucket: bounded by MAX_BUCKETS
    return (placed.withColumn("_local", local).join(F.broadcast(offsets), on, "left")
            .withColumn(name, (F.coalesce("_off", F.lit(0)) + F.col("_local")).cast("long"))
            .drop("_at", "_bkt", "_b", "_off", "_local", *[f"_g{i}" for i in range(len(partition_cols))]))
