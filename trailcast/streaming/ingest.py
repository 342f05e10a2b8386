"""Structured Streaming ingestion: new event-log files landing in a folder are turned
into prefix tables as they arrive.

Each file is one complete log (one dataset variant, named after the file stem). A
micro-batch takes at most ``max_files`` files; ``foreachBatch`` runs the batch job (L1)
per file and overwrites that variant's partitions of the prefix table, so a replayed
micro-batch after a failure rewrites the same partitions (idempotent sink). Progress is
kept in the stream's checkpoint location."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from trailcast.config import EventLogSpec, PrefixConfig
from trailcast.plans.build import build_dataset, dataset_variant
from trailcast.sinks.writers import write_prefixes
from trailcast.sources.eventlog import from_table


def _stem(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[0]


def start_prefix_ingest(spark: SparkSession, source_dir: str, schema: T.StructType, spec: EventLogSpec,
                        out_path: str, checkpoint_location: str, cfg: PrefixConfig = PrefixConfig(),
                        max_files: int = 1, available_now: bool = True, fmt: str = "parquet") -> StreamingQuery:
    stream = (spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files)
              .load(source_dir).withColumn("_file", F.col("_metadata.file_path")))

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        files = [r._file for r in batch.select("_file").distinct().collect()]   # <= max_files
        for f in files:
            log = from_table(batch.filter(F.col("_file") == f).drop("_file"), spec)
            variant = dataset_variant(_stem(f), cfg)
            write_prefixes(build_dataset(log, cfg, variant=variant), out_path)

    writer = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
