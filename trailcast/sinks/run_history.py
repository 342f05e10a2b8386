"""Run history grouped by configuration, kept up to date by merges.

Every configuration key has its configuration and the list of its runs in the order they came:
what one JSON document of all runs holds, as a table. A key's list is cut into rows of at most
``CHUNK`` entries (config_key, chunk, config, runs), so no row or group grows with the history,
and rows are in partitions by a hash of the key. A merge numbers the new entries of a
key behind those it has and rewrites the partitions it touches, from the last chunk of
each touched key on; whole chunks stay as they are. One writer at a time."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trailcast.operators.ranking import row_number_within
from trailcast.session import materialize

CHUNK, BUCKETS = 1000, 64


class RunHistory:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self) -> bool:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/entries")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def grouped(self) -> DataFrame:
        """config_key, chunk, config, runs (array of entries in order), bucket."""
        schema = StructType.fromJson(json.loads(self.spark.read.text(f"{self.path}/schema").first()[0]))
        return self.spark.read.schema(schema).parquet(f"{self.path}/entries")

    def entries(self) -> DataFrame:
        """A row per entry: config_key, position (from 1), config and the entry's columns."""
        rows = self.grouped().select("config_key", "chunk", "config", F.posexplode("runs").alias("_at", "_e"))
        return rows.select("config_key", (F.col("chunk") * CHUNK + F.col("_at") + 1).cast("long").alias("position"), "config", "_e.*")

    def merge(self, new: DataFrame, order: list[str]) -> None:
        """Append entries (config_key, config, and any columns of a run), the new ones of a key by
        ``order`` (unique within a key)."""
        columns = [c for c in new.columns if c not in ("config_key", "config")]
        new = materialize(new.withColumn("bucket", F.pmod(F.xxhash64("config_key"), F.lit(BUCKETS)).cast("int")))
        numbered = row_number_within(new, order, ["config_key"], name="_rn")
        entry = F.struct(*columns)
        if self._exists():
            touched = [r.bucket for r in new.select("bucket").distinct().collect()]     # at most BUCKETS
            old = self.grouped().where(F.col("bucket").isin(touched))
            size = old.groupBy("config_key").agg(F.max("chunk").alias("_last"), F.max(F.struct("chunk", F.size("runs").alias("n")))["n"].alias("_n"))
            size = size.select(F.col("config_key").alias("_key"), "_last", (F.col("_last") * CHUNK + F.col("_n")).alias("_have"))
            met = numbered.join(size, F.col("config_key").eqNullSafe(F.col("_key")), "left")
            fresh = met.withColumn("_at", F.coalesce("_have", F.lit(0)) + F.col("_rn") - 1)
            keys = new.groupBy("config_key").agg(F.lit(True).alias("_new")).select(F.col("config_key").alias("_k2"), "_new")
            open_ = old.join(keys, F.col("config_key").eqNullSafe(F.col("_k2")), "left") \
                .join(size.select("_key", "_last"), F.col("config_key").eqNullSafe(F.col("_key")), "left") \
                .withColumn("_open", F.coalesce(F.col("_new"), F.lit(False)) & (F.col("chunk") == F.col("_last")))
            whole = open_.where("not _open").select("config_key", "chunk", "config", "runs", "bucket")
            opened = open_.where("_open").select("config_key", "config", "bucket", "chunk", F.posexplode("runs").alias("_p", "_e")) \
                .select("config_key", "config", "bucket", (F.col("chunk") * CHUNK + F.col("_p")).alias("_at"), "_e")
        else:
            fresh, whole, opened = numbered.withColumn("_at", F.col("_rn") - 1), None, None
        rows = fresh.select("config_key", "config", "bucket", F.col("_at").cast("long").alias("_at"), entry.alias("_e"))
        if opened is not None:
            rows = rows.unionByName(opened)
        chunks = rows.groupBy("config_key", "bucket", F.floor(F.col("_at") / CHUNK).cast("long").alias("chunk")).agg(
            F.min_by("config", "_at").alias("config"), F.sort_array(F.collect_list(F.struct("_at", "_e"))).alias("_runs"))
        chunks = chunks.select("config_key", "chunk", "config", F.col("_runs._e").alias("runs"), "bucket")
        out = materialize(chunks if whole is None else chunks.unionByName(whole))      # read before its partitions are replaced
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/entries")
        self.spark.range(1).select(F.lit(out.schema.json()).alias("value")).write.mode("overwrite").text(f"{self.path}/schema")
