"""Live prefixes of a replayed stream equal the batch job's."""
import datetime as dt
import json
import os
import random

import pandas as pd
import pytest

from trailcast.config import PrefixConfig
from trailcast.plans.build import all_prefixes
from trailcast.sources.eventlog import EventLogSpec, from_table
from trailcast.streaming import live
from trailcast.streaming.live import start_live_prefixes

SPEC = EventLogSpec(case_col="c", activity_col="a", ts_col="t", pos_col="p", attr_cols=("v", "b"))
SCHEMA = "c string, a string, t timestamp, p long, v double, b string"
START = dt.datetime(2024, 1, 1)


def replay(spark, tmp_dir, parts, cfg, delay="1 hour"):
    src, out, mark = (os.path.join(tmp_dir, x) for x in ("in", "out", "mark"))
    end = [("zz-end", "end", START + dt.timedelta(days=900), 10 ** 6, 0.0, "")]
    for rows in [*parts, end]:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        start_live_prefixes(from_table(stream, SPEC), out, mark, cfg, delay, available_now=True).awaitTermination(300)     # restarted for every part
    return sorted(tuple(r) for r in spark.read.parquet(out).select("case_id", "anchor", "prefix", "prediction", "dedup_key", "prefix_len").collect())


def batch(spark, rows, cfg):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in all_prefixes(from_table(df, SPEC), cfg).select("case_id", "anchor", "prefix", "prediction", "dedup_key", "prefix_len").collect())


def events(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        case = rng.choice(["hot", "hot", "hot", *[f"c{k}" for k in range(12)]])
        rows.append((case, rng.choice(["review", "pay", "ship, all", None]), START + dt.timedelta(minutes=i // 3), i, rng.choice([1.5, 2.0]), rng.choice(["x", "it's"])))
    return rows + [("one", "a", START, n, 1.0, "x"), ("two", "a", START, n + 1, 1.0, "x"), ("two", "b", START + dt.timedelta(minutes=3), n + 2, 1.0, "x")]


@pytest.mark.parametrize("cfg", [PrefixConfig(base=1, gap=3, m=1), PrefixConfig(base=0, gap=1, m=2), PrefixConfig(base=0, gap=2, m=0, dedup_sep="|")])
def test_replay_equals_batch(spark, tmp_dir, cfg):
    rows = events(240, cfg.gap)
    rng = random.Random(1)
    order = sorted(rows, key=lambda r: r[2] + dt.timedelta(minutes=rng.random() * 40))          # out of order by up to 40 minutes
    parts = [order[k:k + 90] for k in range(0, len(order), 90)]
    assert replay(spark, tmp_dir, parts, cfg) == batch(spark, rows, cfg)


def test_events_beyond_the_delay_are_dropped(spark, tmp_dir):
    rows = [("c", f"a{i}", START + dt.timedelta(hours=i), i, 1.0, "x") for i in range(8)]
    late = ("c", "late", START + dt.timedelta(minutes=30), 99, 1.0, "x")
    cfg = PrefixConfig(base=1, gap=1, m=1)
    got = replay(spark, tmp_dir, [rows[:6], [*rows[6:], late]], cfg)
    assert got == batch(spark, rows, cfg)


class Cell:
    """A list or value state that counts its calls."""
    def __init__(self, calls):
        self.items, self.calls = [], calls

    def exists(self):
        self.calls.append("exists")
        return bool(self.items)

    def get(self):
        self.calls.append("get")
        return iter(list(self.items))

    def appendValue(self, value):
        self.calls.append("append")
        self.items.append(value)

    def appendList(self, values):
        self.calls.extend(["append"] * len(values))
        self.items.extend(values)

    def put(self, values):
        self.calls.append("put")
        self.items = list(values)

    def clear(self):
        self.calls.append("clear")
        self.items = []


class Trace(Cell):
    def get(self):
        self.calls.append("get")
        return self.items[0] if self.items else None

    def update(self, value):
        self.put([value])


class Handle:
    def __init__(self):
        self.calls, self.timers = [], set()

    def getListState(self, name, schema):
        return Cell(self.calls)

    def getValueState(self, name, schema):
        return Trace(self.calls)

    def registerTimer(self, at):
        self.calls.append("timer")
        self.timers.add(at)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_state_calls_of_a_case_do_not_grow_with_its_events(monkeypatch):
    """An arrival of a case costs a few calls and one timer; what stays has a timer of its own."""
    monkeypatch.setattr(live, "ROWS_CHARS", 2_000)
    calls = {}
    for n in (20, 2_000):
        handle, proc, got = Handle(), live._Prefixes(PrefixConfig(base=1, gap=3, m=1)), []
        proc.init(handle)
        for half in (range(0, n, 2), range(1, n, 2)):            # the second arrival lies between the first one's events
            part = pd.DataFrame({"at": [1_000_500 * i for i in half], "pos": list(half), "act": [f"a{i % 7}" for i in half], "by_cols": "{}", "by_key": "{}"})
            part["event"] = [json.dumps(e) for e in part[["at", "pos", "act", "by_cols", "by_key"]].values.tolist()]
            list(proc.handleInputRows(("c",), iter([part]), Clock(0)))
        while handle.timers:                                     # Spark: those up to the watermark, first ones first
            mark = max(min(handle.timers), n * 1_000 // 2)
            for at in sorted(t for t in handle.timers if t <= mark):
                got += [r for f in proc.handleExpiredTimer(("c",), Clock(mark), None) for text in f["rows"] for r in json.loads(text)]
                handle.timers.discard(at)
            if mark >= n * 1_000 // 2 and handle.timers:
                mark = n * 2_000
                for at in sorted(handle.timers):
                    got += [r for f in proc.handleExpiredTimer(("c",), Clock(mark), None) for text in f["rows"] for r in json.loads(text)]
                    handle.timers.discard(at)
        assert [r["anchor"] for r in got] == list(range(1, n - 1, 3))
        assert all(r["prediction"] == f"a{(r['anchor'] + 1) % 7}" for r in got)
        calls[n] = len(handle.calls)
    assert calls[20] == calls[2_000] < 25
