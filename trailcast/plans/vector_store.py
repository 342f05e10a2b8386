"""Vector collections that are updated in place of being rebuilt.

A collection is a folder of numbered batches of Parquet rows: point_id, text_digest, row_digest,
embedding, prefix, prediction, deleted. An upsert compares the digests of the incoming rows with
the collection's newest ones and writes one more batch: rows with a new or changed prefix are
encoded, rows of which only the payload changed keep their vector, unchanged rows are not
touched. Reading takes each point's row of the highest batch (an aggregation with partial
results; a point has at most a row per batch). :meth:`VectorStore.compact` writes the current
rows as a batch of its own that replaces all earlier ones, then deletes those. A batch counts
once its write has committed, so a lost job leaves the collection as it was. One writer at a time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailcast.operators.encoders import encode
from trailcast.session import materialize

COLUMNS = ["point_id", "text_digest", "row_digest", "embedding", "prefix", "prediction", "deleted"]
SCHEMA = "point_id long, text_digest binary, row_digest binary, embedding array<float>, prefix string, prediction string, deleted boolean"


def _digest(*columns: str):
    """128 bits of the columns' values (a null has no field, so it differs from any text)."""
    return F.unhex(F.md5(F.to_json(F.struct(*columns))))


@dataclass
class Upsert:
    """What one upsert wrote: rows encoded, rows with a new payload alone, rows deleted."""
    batch: int
    encoded: int
    payload: int
    deleted: int


class VectorStore:
    def __init__(self, spark: SparkSession, path: str, model_id: str = "hashing", variant: str = "default", **enc_opts):
        self.spark, self.model_id, self.variant, self.enc_opts = spark, model_id, variant, enc_opts
        self.path = f"{path.rstrip('/')}/model_id={model_id}/variant={variant}"

    # ---- files ----
    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def batches(self) -> list[tuple[int, str]]:
        """(number, folder) of the batches in use: from the last compacted one on."""
        fs, root = self._fs()
        if not fs.exists(root):
            return []
        jvm, found = self.spark._jvm, []
        for status in fs.listStatus(root):
            kind, _, number = status.getPath().getName().partition("-")
            if kind in ("base", "batch") and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                found.append((int(number), kind))
        start = max((n for n, kind in found if kind == "base"), default=0)
        return [(n, f"{self.path}/{kind}-{n:06d}") for n, kind in sorted(found) if n >= start]

    def _next(self) -> int:
        return max((n for n, _ in self.batches()), default=0) + 1

    # ---- reading ----
    def rows(self) -> DataFrame:
        """Newest row of each point, deleted ones included, with its batch."""
        out = None
        for n, folder in self.batches():
            part = self.spark.read.schema(SCHEMA).parquet(folder).withColumn("batch", F.lit(n))
            out = part if out is None else out.unionByName(part)
        if out is None:
            return self.spark.createDataFrame([], SCHEMA + ", batch int")
        newest = F.max_by(F.struct(*[c for c in out.columns if c != "point_id"]), "batch").alias("r")
        return out.groupBy("point_id").agg(newest).select("point_id", "r.*").select(*COLUMNS, "batch")

    def vectors(self) -> DataFrame:
        """The collection as a table of points (what :func:`build_vectors` gives), and each
        point's batch."""
        return self.rows().where("not deleted").select(F.lit(self.model_id).alias("model_id"), F.lit(self.variant).alias("variant"),
                                                       "point_id", "embedding", "prefix", "prediction", "batch")

    # ---- writing ----
    def upsert(self, points: DataFrame, mirror: bool = False) -> Upsert:
        """Merge points (point_id, prefix, prediction; of a repeated id the least row) into
        the collection. With ``mirror`` points that aren't among them are deleted."""
        rows = points.groupBy("point_id").agg(F.min(F.struct("prefix", "prediction")).alias("p")).select("point_id", "p.*")
        rows = rows.where("point_id is not null").withColumns({"text_digest": _digest("prefix"), "row_digest": _digest("prefix", "prediction")})
        old = self.rows().select("point_id", F.col("text_digest").alias("_t"), F.col("row_digest").alias("_r"), F.col("embedding").alias("_e"), F.col("deleted").alias("_d"))
        live = ~F.coalesce("_d", F.lit(True))
        met = rows.join(old, "point_id", "left").where(~(live & (F.col("_r") == F.col("row_digest"))))
        keep = live & (F.col("_t") == F.col("text_digest"))
        changed = materialize(met.withColumn("_keep", F.coalesce(keep, F.lit(False))).drop("_t", "_r", "_d"))
        fresh = encode(changed.where("not _keep").drop("_e"), "prefix", self.model_id, "embedding", **self.enc_opts)
        moved = changed.where("_keep").withColumnRenamed("_e", "embedding")
        out = fresh.unionByName(moved, allowMissingColumns=True).withColumn("deleted", F.lit(False)).select(*COLUMNS)
        if mirror:
            gone = old.where("not _d").join(rows.select("point_id"), "point_id", "left_anti").select("point_id", F.lit(True).alias("deleted"))
            out = out.unionByName(gone, allowMissingColumns=True).select(*COLUMNS)
        n = self._next()
        # an unfinished batch of a lost job has this number too: it is replaced
        out.write.mode("overwrite").parquet(f"{self.path}/batch-{n:06d}")
        counts = changed.agg(F.count_if(~F.col("_keep")), F.count_if("_keep")).first()
        deleted = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/batch-{n:06d}").where("deleted").count()
        return Upsert(n, counts[0], counts[1], deleted)

    def compact(self) -> int:
        """Rewrite the current rows as one batch that replaces all others; its number."""
        old, n = self.batches(), self._next()
        if not old:
            return 0
        self.rows().where("not deleted").select(*COLUMNS).write.mode("overwrite").parquet(f"{self.path}/base-{n:06d}")
        fs, _ = self._fs()
        for _, folder in old:                             # the base counts already
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(folder), True)
        return n
