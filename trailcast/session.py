"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "trailcast") -> SparkSession:
    """Local/dev session. On a cluster, build the session from the cluster's own defaults
    and only call :func:`configure` on it."""
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    master = master or f"local[{cpus}]"
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TRAILCAST_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus * 2))
    )
    spark = builder.getOrCreate()
    configure(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Spark send this package to its Python workers, unless they find it already."""
    import trailcast
    home = os.path.dirname(os.path.dirname(os.path.abspath(trailcast.__file__)))
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if home in known or app in _shipped or not os.path.isdir(os.path.join(home, "trailcast")):
        return
    stage = tempfile.mkdtemp(prefix="trailcast-package-")     # Spark copies it from here
    name = shutil.make_archive(os.path.join(stage, "trailcast"), "zip", home, "trailcast")
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)


def configure(spark: SparkSession) -> SparkSession:
    """Settings the operators assume (idempotent, safe on a shared cluster session)."""
    conf = spark.conf
    conf.set("spark.sql.session.timeZone", "UTC")
    conf.set("spark.sql.adaptive.enabled", "true")
    conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    # Partitions are overwritten per variant / model, never the whole table.
    conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared checkpoint folder; only pick a scratch one when unset
    (local tests)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: point it to a folder shared by "
                               "the driver and all executors (e.g. on the cluster file system)")
        configured = tempfile.mkdtemp(prefix="trailcast-ckpt-")   # single-machine runs only
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_ending: set[str] = set()


def _delete_at_end(spark: SparkSession, folder: str) -> None:
    """Have the folder's file system delete it when the driver's JVM ends."""
    if folder not in _ending:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _ending.add(folder)


def materialize(df, partition_by: list[str] | None = None):
    """Cut lineage of an intermediate that several actions read: write it as a Parquet
    table under the cluster's shared checkpoint folder and read it back (survives
    executor loss; later reads get column pruning and filter / partition pushdown)."""
    import uuid
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    # one folder per application, deleted when the application ends
    folder = f"{root}/trailcast-tables/{spark.sparkContext.applicationId}"
    _delete_at_end(spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    writer = df.write.mode("error").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)      # also when it has no rows or files
