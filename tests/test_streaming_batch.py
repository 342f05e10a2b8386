"""Streaming ingestion and the multi-log batch job produce what the batch job does."""
import os

from pyspark.sql import functions as F

from trailcast.config import PrefixConfig
from trailcast.plans.batch import preprocess_many
from trailcast.plans.build import build_dataset
from trailcast.sources.eventlog import EVENTS_SPEC, from_table
from trailcast.sources.tables import read_attribute_labels
from trailcast.streaming.ingest import start_prefix_ingest

SF = "/root/testdata/sf0.001"


def _cols(df):
    return sorted(tuple(r) for r in df.select("split", "row_id", "prefix", "prediction").collect())


def test_stream_ingest_matches_batch(spark, tmp_dir):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    src = os.path.join(tmp_dir, "incoming")
    even, odd = ev.filter(F.col("user_id") % 2 == 0), ev.filter(F.col("user_id") % 2 == 1)
    even.coalesce(1).write.parquet(os.path.join(src, "tmp_even"))
    odd.coalesce(1).write.parquet(os.path.join(src, "tmp_odd"))
    for name in ("even", "odd"):  # one file per log, named after the dataset
        part = [p for p in os.listdir(os.path.join(src, f"tmp_{name}")) if p.endswith(".parquet")][0]
        os.link(os.path.join(src, f"tmp_{name}", part), os.path.join(src, f"{name}.parquet"))
    cfg = PrefixConfig(base=1, gap=3, m=1)
    out = os.path.join(tmp_dir, "prefixes")
    q = start_prefix_ingest(spark, os.path.join(src, "*.parquet"), ev.schema, EVENTS_SPEC, out,
                            os.path.join(tmp_dir, "ckpt"), cfg)
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    assert {r.variant for r in got.select("variant").distinct().collect()} == {"b1_g3_even", "b1_g3_odd"}
    assert _cols(got.filter("variant = 'b1_g3_even'")) == _cols(build_dataset(from_table(even, EVENTS_SPEC), cfg))


def test_preprocess_many(spark, tmp_dir):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    rep = preprocess_many(spark, {"events": from_table(ev, EVENTS_SPEC)}, tmp_dir,
                          PrefixConfig(base=1, gap=3, m=3)).collect()
    assert rep[0].error is None and rep[0].output_rows > 0
    vec = spark.read.parquet(os.path.join(tmp_dir, "vectors"))
    assert vec.filter("variant = 'last_3_b1_g3_events'").count() == \
        spark.read.parquet(os.path.join(tmp_dir, "prefixes")).filter("split = 'retrieval'").count()
    labels = read_attribute_labels(spark, os.path.join(tmp_dir, "labels", "variant=last_3_b1_g3_events"))
    assert sorted(r.abbr for r in labels.collect()) == ["ev", "pr", "ts", "va"]


def test_stream_restart_processes_only_new_logs(spark, tmp_dir):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    src = os.path.join(tmp_dir, "incoming")
    os.makedirs(src)
    parts = {"first": ev.filter(F.col("user_id") % 3 == 0), "second": ev.filter(F.col("user_id") % 3 == 1)}
    cfg = PrefixConfig(base=1, gap=3, m=0)
    out, ckpt = os.path.join(tmp_dir, "prefixes"), os.path.join(tmp_dir, "ckpt")

    def land(name):
        tmp = os.path.join(tmp_dir, f"tmp_{name}")
        parts[name].coalesce(1).write.parquet(tmp)
        f = [p for p in os.listdir(tmp) if p.endswith(".parquet")][0]
        os.link(os.path.join(tmp, f), os.path.join(src, f"{name}.parquet"))

    def run():
        start_prefix_ingest(spark, src, ev.schema, EVENTS_SPEC, out, ckpt, cfg).awaitTermination(300)
        return {r.variant: r["count"] for r in spark.read.parquet(out).groupBy("variant").count().collect()}

    land("first")
    first = run()
    assert set(first) == {"b1_g3_first"}
    assert run() == first                      # restart: nothing new, nothing rewritten
    land("second")
    both = run()
    assert set(both) == {"b1_g3_first", "b1_g3_second"} and both["b1_g3_first"] == first["b1_g3_first"]
