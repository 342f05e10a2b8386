"""Ranked events carry only what their order and texts are made of; the result stays the same."""
import datetime as dt

import pytest

from trailcast.config import EventLogSpec, PrefixConfig
from trailcast.plans.build import all_prefixes, positioned_events
from trailcast.sources.eventlog import from_table

SPEC = EventLogSpec(case_col="c", activity_col="a", ts_col="t", pos_col="p", attr_cols=("v", "b"))
START = dt.datetime(2024, 1, 1)
ROWS = [(f"c{i % 3}", f"a{i % 5}", START + dt.timedelta(minutes=-i), i, float(i), "x" * 50) for i in range(60)]
TEXTS = {"attrs", "vals_cols", "vals_sorted"}


@pytest.mark.parametrize("m, order, kept", [(0, "reference", set()), (2, "sorted", {"vals_sorted"}), (2, "reference", {"vals_cols", "vals_sorted"})])
def test_ranked_rows_hold_no_unused_text(spark, m, order, kept):
    log = from_table(spark.createDataFrame(ROWS, "c string, a string, t timestamp, p long, v double, b string"), SPEC)
    cfg = PrefixConfig(base=1, gap=2, m=m, key_order=order)
    ranked = positioned_events(log, cfg, small_rows=0, rows_per_bucket=16)
    assert TEXTS & set(ranked.columns) == kept
    large, small = all_prefixes(log, cfg, small_rows=0, rows_per_bucket=16), all_prefixes(log, cfg)
    assert sorted(map(tuple, large.collect())) == sorted(map(tuple, small.collect()))
    assert large.count() == 3 * 9
