"""Writers (B1-B8, B10). Outputs are partitioned tables; a rerun replaces only its own
partitions (dynamic partition overwrite), appends go to append-only tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _dynamic(df: DataFrame) -> None:
    df.sparkSession.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")


def write_prefixes(prefixes: DataFrame, path: str, fmt: str = "parquet") -> str:
    """B1 + B2: one table partitioned by (variant, split); a rerun of a variant replaces
    its retrieval and test partitions only."""
    _dynamic(prefixes)
    cols = [c for c in ("variant", "split") if c in prefixes.columns]
    prefixes.write.mode("overwrite").partitionBy(*cols).format(fmt).save(path)
    return path


def write_prefix_csv(prefixes: DataFrame, path: str) -> str:
    """B1 in the reference layout: ``prefix,prediction`` CSV with a header, one folder
    per split (``split=retrieval`` / ``split=test``)."""
    _dynamic(prefixes)
    (prefixes.select("prefix", "prediction", "split").write.mode("overwrite").partitionBy("split")
     .option("header", "true").option("quote", '"').option("escape", '"').csv(path))
    return path


def write_split_log(log: DataFrame, split: DataFrame, path: str, fmt: str = "parquet") -> str:
    """The event log with each trace's split, partitioned by split."""
    _dynamic(log)
    out = log.join(split.select("case_id", "split"), "case_id")
    out.write.mode("overwrite").partitionBy("split").format(fmt).save(path)
    return path


def write_xes(traces: DataFrame, path: str) -> str:
    """B3 as XES: trace rows (XML source layout, plus ``split``) written as
    ``<log><trace>...</trace></log>`` files, one folder per split."""
    _dynamic(traces)
    (traces.write.mode("overwrite").partitionBy("split").format("xml")
     .option("rootTag", "log").option("rowTag", "trace").option("attributePrefix", "_").save(path))
    return path


def write_vectors(vectors: DataFrame, path: str) -> str:
    """B4 + B5 (+ B10 naming): points partitioned by (model_id, variant); writing a
    collection replaces that collection only."""
    _dynamic(vectors)
    vectors.write.mode("overwrite").partitionBy("model_id", "variant").parquet(path)
    return path


def write_labels(key_labels: DataFrame, path: str, group: str = "variant") -> str:
    """Attribute labels per variant as one JSON object key -> label, keys sorted (what
    ``read_attribute_labels`` reads)."""
    _dynamic(key_labels)
    pairs = F.array_sort(F.collect_set(F.struct("key", "label")))
    objects = key_labels.groupBy(group).agg(F.to_json(F.map_from_entries(pairs)).alias("value"))
    objects.write.mode("overwrite").partitionBy(group).text(path)
    return path


def append_runs(entries: DataFrame, path: str) -> str:
    """Append run entries (timestamp, run_label, config, config_key, metrics)."""
    entries.write.mode("append").parquet(path)
    return path


def replace_report(report: DataFrame, path: str, key: str = "variant_key") -> str:
    """Keep only the newest report per variant key - the key is the partition, and a
    write replaces the partitions it touches."""
    _dynamic(report)
    report.write.mode("overwrite").partitionBy(key).parquet(path)
    return path
