"""The distributed paths (bucketed ranking, multi-block prefix assembly, partition counts)
must give exactly the results of the simple paths."""
import random

import pytest
from pyspark.sql import functions as F

from trailcast.catalog.prefix_q import events_log, orders_log
from trailcast.config import PrefixConfig
from trailcast.operators.ranking import row_number_within
from trailcast.operators.prefixes import render_events, trace_text
from trailcast.operators.traces import event_positions, trace_table
from trailcast.plans.build import all_prefixes, build_dataset

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_bucketed_ranking_matches_window_with_hot_group(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.4 else f"g{rnd.randint(0, 50)}", i, rnd.randint(0, 30))
            for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, id long, k long")
    plain = row_number_within(df, ["k", "id"], ["g"])
    bucketed = row_number_within(df, ["k", "id"], ["g"], small_rows=0, rows_per_bucket=300)
    assert _rows(plain) == _rows(bucketed)
    g_plain = row_number_within(df, ["k", "id"])
    g_buck = row_number_within(df, ["k", "id"], small_rows=0, rows_per_bucket=250)
    assert _rows(g_plain) == _rows(g_buck)


def test_bucketed_ranking_timestamps_and_strings(spark):
    df = spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey", "o_orderdate", "o_orderkey",
                                                            "o_orderpriority")
    a = row_number_within(df, ["o_orderdate", "o_orderpriority", "o_orderkey"], ["o_custkey"])
    b = row_number_within(df, ["o_orderdate", "o_orderpriority", "o_orderkey"], ["o_custkey"],
                          small_rows=0, rows_per_bucket=100)
    assert _rows(a) == _rows(b)


@pytest.mark.parametrize("m,block", [(0, 4), (1, 5), (3, 7), (3, 2)])
def test_block_size_invariance(spark, m, block):
    log = events_log(spark, SF)
    ref = all_prefixes(log, PrefixConfig(base=1, gap=3, m=m))
    small = all_prefixes(log, PrefixConfig(base=1, gap=3, m=m, block_size=block))
    assert _rows(ref) == _rows(small)


def test_block_size_invariance_gap1_base0(spark):
    log = orders_log(spark, SF)
    ref = all_prefixes(log, PrefixConfig(base=0, gap=1, m=2))
    small = all_prefixes(log, PrefixConfig(base=0, gap=1, m=2, block_size=3))
    assert _rows(ref) == _rows(small)


def test_trace_text_blocks(spark):
    log = events_log(spark, SF)
    ev = render_events(event_positions(log), PrefixConfig(m=0))
    tr = trace_table(log)
    assert _rows(trace_text(ev, tr)) == _rows(trace_text(ev, tr, block_size=5))


def test_build_dataset_big_paths(spark):
    log = events_log(spark, SF)
    cfg = PrefixConfig(base=1, gap=3, m=1, cross_dedup=True, block_size=8)
    a = build_dataset(log, PrefixConfig(base=1, gap=3, m=1, cross_dedup=True))
    b = build_dataset(log, cfg, small_rows=0, rows_per_bucket=200)
    assert _rows(a) == _rows(b)


def test_partition_invariance(spark):
    log = events_log(spark, SF)
    cfg = PrefixConfig(base=1, gap=3, m=1)
    base = _rows(build_dataset(log, cfg))
    try:
        for n in ("1", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert _rows(build_dataset(events_log(spark, SF).repartition(5), cfg)) == base
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_invariants(spark):
    log = events_log(spark, SF)
    cfg = PrefixConfig(base=1, gap=3, m=1, cross_dedup=True)
    pre = all_prefixes(log, cfg)
    assert pre.filter(F.col("prefix_len") != F.col("anchor") + 1).count() == 0
    tr = trace_table(log).collect()
    expected = sum(max(0, -(-(r.n - 1 - cfg.base) // cfg.gap)) for r in tr if r.n > 2)
    assert pre.count() == expected
    ds = build_dataset(log, cfg)
    ret = {r.dedup_key for r in ds.filter("split = 'retrieval'").collect()}
    assert not any(r.dedup_key in ret for r in ds.filter("split = 'test'").collect())
