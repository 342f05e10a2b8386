"""Intermediate tables that cut lineage, in the folder of ``spark.checkpoint.dir``.

A table written there is read by every executor and survives the loss of any of them. An
operator drops what its result no longer needs; the tables its lazy result reads stay in
one folder per application."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailcast.session import ensure_checkpoint_dir, ship_package

BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Session settings that the operators rely on: Arrow batches limited by bytes (long
    documents), adaptive execution with skew-join handling."""
    ship_package(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class Scratch:
    """A folder for one operator call's intermediate tables."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        prepare(spark)
        root = ensure_checkpoint_dir(spark).rstrip("/")
        self.folder = f"{root}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"

    def _path(self, label: str) -> str:
        return f"{self.folder}/{label}"

    def write(self, df: DataFrame, label: str, codec: str = "zstd",
              max_rows: int | None = None) -> DataFrame:
        """Write ``df`` once and return the table that reads it back."""
        writer = df.write.mode("error").option("compression", codec)
        if max_rows:
            writer = writer.option("maxRecordsPerFile", max_rows)
        writer.parquet(self._path(label))
        return self.spark.read.schema(df.schema).parquet(self._path(label))

    def drop(self, *labels: str) -> None:
        """Delete tables that nothing reads any more (on whatever file system they are)."""
        jvm = self.spark._jvm
        for label in labels:
            path = jvm.org.apache.hadoop.fs.Path(self._path(label))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def numbered(self, df: DataFrame, label: str = "numbered") -> DataFrame:
        """``df`` with a column row that numbers its rows, the same in every read. Rows of
        files keep their numbers; anything computed is written once, since a shuffle may
        deal its rows otherwise when other columns are asked for."""
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        heads = {line.lstrip(" :+-").split(" ")[0] for line in plan.strip().split("\n")}
        numbered = df.withColumn("row", F.monotonically_increasing_id())
        return numbered if heads <= {"Relation", "Project", "Filter"} else self.write(numbered, label)
