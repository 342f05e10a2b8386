"""The compact prefix table and the vector collection that is updated in place."""
import random

import pytest
from pyspark.sql import functions as F

from trailcast.config import PrefixConfig
from trailcast.plans.build import build_dataset
from trailcast.plans.compact import compact_dataset, read_compact, write_compact
from trailcast.plans.evaluate import build_vectors
from trailcast.plans.vector_store import VectorStore
from trailcast.sources.eventlog import EVENTS_SPEC, from_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def log(spark):
    return from_table(spark.read.parquet(f"{SF}/events.parquet"), EVENTS_SPEC)


def rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


COLUMNS = ("split", "row_id", "case_id", "anchor", "prefix", "prediction", "dedup_key", "prefix_len")


@pytest.mark.parametrize("cfg", [PrefixConfig(base=1, gap=1, m=3), PrefixConfig(base=0, gap=2, m=2, block_size=3), PrefixConfig(base=1, gap=3, m=0, block_size=4, split_mode="row")])
def test_view_equals_the_rendered_table(spark, log, tmp_dir, cfg):
    write_compact(compact_dataset(log, cfg), f"{tmp_dir}/c")
    back = read_compact(spark, f"{tmp_dir}/c")
    want = build_dataset(log, cfg)
    assert back.cfg == cfg and rows(back.view(), *COLUMNS) == rows(want, *COLUMNS)
    some = "split = 'test' and row_id % 4 = 1"
    assert rows(back.view(some), *COLUMNS) == rows(want.where(some), *COLUMNS)
    assert back.view("false").count() == 0


def test_compact_size_is_linear(spark, tmp_dir):
    """One trace of n events, every one an anchor: twice the events, about twice the bytes."""
    def size(n):
        rng = random.Random(1)
        events = spark.createDataFrame([(1, i, i, rng.choice("abcdefgh") * 5) for i in range(n)], "user_id long, event_id long, t long, event_type string") \
            .selectExpr("user_id", "event_id", "timestamp_seconds(t) as ts", "event_type", "double(1) as value", "'{}' as props")
        path = write_compact(compact_dataset(from_table(events, EVENTS_SPEC), PrefixConfig(base=0, gap=1, m=1, test_share=0.0)), f"{tmp_dir}/n{n}")
        text = read_compact(spark, path)
        assert text.places.count() == n - 1
        jvm = spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    small, large = size(4000), size(16000)
    assert large < 6 * small


def test_empty_log(spark, log, tmp_dir):
    path = write_compact(compact_dataset(log.limit(0), PrefixConfig()), f"{tmp_dir}/e")
    assert read_compact(spark, path).view().count() == 0


def points(spark, *rows):
    return spark.createDataFrame(list(rows), "point_id long, prefix string, prediction string")


def state(store):
    return {r.point_id: (r.prefix, r.prediction, r.batch) for r in store.vectors().collect()}


def test_upsert_encodes_only_what_changed(spark, tmp_dir):
    store = VectorStore(spark, tmp_dir)
    assert store.vectors().count() == 0 and store.compact() == 0
    first = store.upsert(points(spark, (1, "a,b", "c"), (2, "a", "b"), (3, "x", "y"), (4, None, "n"), (1, "a,b", "c"), (None, "z", "z")))
    assert (first.batch, first.encoded, first.payload, first.deleted) == (1, 4, 0, 0)
    again = store.upsert(points(spark, (1, "a,b", "c"), (2, "a", "b"), (3, "x", "y"), (4, None, "n")))
    assert (again.encoded, again.payload, again.deleted) == (0, 0, 0)
    third = store.upsert(points(spark, (1, "a,b", "d"), (2, "a,a", "b"), (5, "q", "r")), mirror=True)
    assert (third.encoded, third.payload, third.deleted) == (2, 1, 2)
    assert state(store) == {1: ("a,b", "d", 3), 2: ("a,a", "b", 3), 5: ("q", "r", 3)}
    back = store.upsert(points(spark, (3, "x", "y")))
    assert back.encoded == 1 and state(store)[3] == ("x", "y", 4)
    want = build_vectors(points(spark, (1, "a,b", "d"), (2, "a,a", "b"), (5, "q", "r"), (3, "x", "y")).withColumnRenamed("point_id", "row_id").withColumn("split", F.lit("retrieval")))
    vectors = lambda df: rows(df, "point_id", "embedding", "prefix", "prediction")
    assert vectors(store.vectors()) == vectors(want)
    assert store.compact() == 5 and vectors(store.vectors()) == vectors(want)
    assert [n for n, _ in store.batches()] == [5]
    assert store.upsert(points(spark, (5, "q", "r"))).encoded == 0


def test_unfinished_batches_do_not_count(spark, tmp_dir):
    store = VectorStore(spark, tmp_dir, "hashing", "v")
    store.upsert(points(spark, (1, "a", "b")))
    fs, root = store._fs()
    fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(root, "batch-000002"))          # a job that never committed
    assert state(store) == {1: ("a", "b", 1)}
    store.upsert(points(spark, (1, "a", "c")))
    assert state(store) == {1: ("a", "c", 2)}
    assert state(VectorStore(spark, tmp_dir, "hashing", "w")) == {}
