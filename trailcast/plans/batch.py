"""Preprocess several logs with one setting (build prefixes, attribute labels and
vectors per log), with a per-dataset run report (E12) - one bad log does not stop the
others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailcast.config import PrefixConfig
from trailcast.operators.labels import attribute_keys, label_table, lookup_labels
from trailcast.operators.runs import execution_report
from trailcast.plans.build import build_dataset, dataset_variant
from trailcast.plans.evaluate import build_vectors
from trailcast.session import materialize
from trailcast.sinks.writers import write_labels, write_prefixes, write_vectors


def preprocess_many(spark: SparkSession, logs: dict[str, DataFrame], out_root: str,
                    cfg: PrefixConfig = PrefixConfig(base=1, gap=3, m=3),
                    encoders: tuple[str, ...] = ("hashing",), labels: bool = True) -> DataFrame:
    """Writes ``{out_root}/prefixes`` (variant, split), ``{out_root}/labels`` (variant)
    and ``{out_root}/vectors`` (model_id, variant); returns the run report."""
    root = out_root.rstrip("/")

    def job(stem: str, log: DataFrame):
        def run():
            variant = dataset_variant(stem, cfg)
            ds = materialize(build_dataset(log, cfg, variant=variant), ["split"])
            write_prefixes(ds, f"{root}/prefixes")
            if labels:
                kl = lookup_labels(attribute_keys(ds), label_table(spark)).withColumn("variant", F.lit(variant))
                write_labels(kl, f"{root}/labels")
            for enc in encoders:
                write_vectors(build_vectors(ds, enc, variant), f"{root}/vectors")
            return ds
        return run

    return execution_report(spark, {stem: job(stem, log) for stem, log in logs.items()})
