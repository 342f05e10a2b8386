"""A task of the ranked events' steps takes as many rows however large the log: the tasks grow with
it, not with the session's shuffle partitions, and the results stay the same."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from trailcast.config import EventLogSpec, PrefixConfig
from trailcast.operators import prefixes
from trailcast.operators.ranking import row_number_within
from trailcast.plans.build import all_prefixes, transitions
from trailcast.sources.eventlog import from_table

SPEC = EventLogSpec(case_col="c", activity_col="a", ts_col="t", pos_col="p", attr_cols=("v",))
START = dt.datetime(2024, 1, 1)
ROWS = [(i % 97, f"a{i % 5}", START + dt.timedelta(minutes=-(i % 50)), i, float(i)) for i in range(1500)] + \
       [(200, f"a{i % 7}", START, i, None) for i in range(1500, 2000)]        # a long trace
LARGE = dict(small_rows=0, rows_per_bucket=100)                                # 20 tasks


@pytest.fixture()
def two_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def log_of(spark):
    return from_table(spark.createDataFrame(ROWS, "c long, a string, t timestamp, p long, v double"), SPEC)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def largest(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_ranking_tasks_grow_with_the_rows(two_partitions):
    df = two_partitions.createDataFrame([(i % 40, i) for i in range(4000)], "g long, k long")
    ranked = row_number_within(df, ["k"], ["g"], **LARGE)
    assert ranked.rdd.getNumPartitions() >= 40
    assert largest(ranked) <= 500                  # 2 tasks took 2,000 and more
    assert rows(ranked) == rows(row_number_within(df, ["k"], ["g"]))


@pytest.mark.parametrize("broadcast, block", [(1_000_000, 4096), (0, 150)])
def test_block_tasks_grow_with_the_events(two_partitions, monkeypatch, broadcast, block):
    monkeypatch.setattr(prefixes, "BROADCAST_TRACES", broadcast)
    log = log_of(two_partitions)
    cfg = PrefixConfig(base=0, gap=1, m=2, block_size=block)
    large, steps = all_prefixes(log, cfg, **LARGE), transitions(log, cfg, **LARGE)
    assert steps.rdd.getNumPartitions() >= 20
    assert rows(large) == rows(all_prefixes(log, cfg))
    assert rows(steps) == rows(transitions(log, cfg))
