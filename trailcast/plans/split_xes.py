"""B3 as XES: one log split by the end times of its traces into two logs that keep the header
and the text of every trace as they are in the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailcast.operators.ranking import row_number_within
from trailcast.operators.split import temporal_split
from trailcast.session import materialize
from trailcast.sources.xes import xes_header, xes_records

LOG_CLOSE = "</log>"
DATES = "event array<struct<date array<struct<_key string, _value string>>>>"


def trace_ends(records: DataFrame) -> DataFrame:
    """(trace_pos, end_ts): the latest time:timestamp of a trace's events (an event's first one
    with a value counts); null without events or times."""
    events = F.from_xml("xml", DATES, {"rowTag": "trace", "attributePrefix": "_"})["event"]
    time = F.transform(events, lambda e: F.to_timestamp(F.get(F.filter(
        e["date"], lambda d: (d["_key"] == "time:timestamp") & d["_value"].isNotNull()), F.lit(0))["_value"]))
    return records.select("trace_pos", F.array_max(time).alias("end_ts"))


def split_xes(spark: SparkSession, path: str, out: str, test_share: float = 0.3,
              zero_test_means_all: bool = False, traces_per_file: int = 100_000, **rank_opts) -> DataFrame:
    """Write ``{out}/split=retrieval`` and ``{out}/split=test``: whole XES files of up to
    ``traces_per_file`` traces in the log's order, one folder ``part=i`` each. The last
    int(N * share) traces by end time are test; traces without events count and come first.
    Returns (trace_pos, split, place), place being the trace's number in its split. A log
    without traces is an error; a split without any is a file of header and end.

    Only narrow rows are ranked; the traces' text moves once, to its file."""
    records = xes_records(spark, path)
    ends = materialize(trace_ends(records))
    n = ends.count()
    if n == 0:
        raise ValueError(f"No <trace> elements found in: {path}")
    split = temporal_split(ends, test_share, zero_test_means_all, n_traces=n, **rank_opts)
    placed = materialize(row_number_within(split.select("trace_pos", "split"), ["trace_pos"], ["split"], name="place", n_rows=n, **rank_opts))
    sizes = dict(placed.groupBy("split").count().collect())          # two numbers
    head = F.lit(xes_header(spark, path).rstrip() + "\n")
    for name in ("retrieval", "test"):
        size = sizes.get(name, 0)
        at = F.col("place") - 1
        opens = at % traces_per_file == 0
        closes = ((at + 1) % traces_per_file == 0) | (F.col("place") == size)
        text = F.concat(F.when(opens, head).otherwise(""), F.col("xml"), F.when(closes, "\n" + LOG_CLOSE).otherwise(""))
        rows = (records.join(placed.where(F.col("split") == name), "trace_pos")
                .withColumn("part", F.floor(at / traces_per_file).cast("int"))
                .repartition("part").sortWithinPartitions("part", "place").select(text.alias("value"), "part"))
        if not size:
            rows = spark.range(1).select(F.concat(head, F.lit(LOG_CLOSE)).alias("value"), F.lit(0).alias("part"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("part").text(f"{out}/split={name}")
    return placed
