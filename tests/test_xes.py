"""XES logs: nested attributes, traces without events, the header, and files read by several tasks."""
import os
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from trailcast.config import PrefixConfig
from trailcast.plans.build import build_dataset
from trailcast.plans.split_xes import split_xes
from trailcast.sources.eventlog import eventless_traces, read_xes_events, read_xes_log, read_xes_traces
from trailcast.sources.xes import xes_records

HEAD = """<?xml version="1.0" encoding="UTF-8" ?>
<!-- a log -->
<log xes.version="1.0" xmlns="http://www.xes-standard.org/">
<extension name="Concept" prefix="concept" uri="http://www.xes-standard.org/concept.xesext"/>
<global scope="event"><string key="concept:name" value="?"/></global>
<classifier name="Activity" keys="concept:name"/>
<string key="concept:name" value="the log"/>
"""


def _event(act, minute, more=""):
    return (f'<event><string key="concept:name" value="{act}"/>'
            f'<date key="time:timestamp" value="2020-01-01T{10 + minute // 60}:{minute % 60:02d}:00.000+00:00"/>{more}</event>')


def _trace(name, body, more=""):
    return f'<trace><string key="concept:name" value="{name}"/>{more}{body}</trace>'


def _log(folder, traces, head=HEAD, name="log.xes"):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(head + "\n".join(traces) + "\n</log>\n")
    return path


NESTED = ('<list key="tags"><values><string key="b" value="007"/><int key="a" value="1"/>'
          '<list key="in"><values><string key="b" value="x &amp; &quot;y&quot; é"/></values></list></values></list>'
          '<container key="box"><date key="d" value="2020-01-01"/></container><list key="none"/>')


def test_nested_attributes(spark, tmp_dir):
    path = _log(tmp_dir, [_trace("c1", _event("A", 1, NESTED) + _event("B", 2), '<container key="meta"><float key="f" value="1.50"/></container>'), _trace("c2", _event("A", 3))])
    got = {(r.trace_pos, r.event_in_trace): r.attributes for r in read_xes_events(spark, path).collect()}
    meta = '[{"key": "f", "value": "1.50"}]'
    assert got[1, 0] == {
        "case:concept:name": "c1", "case:meta": meta, "concept:name": "A", "time:timestamp": "2020-01-01T10:01:00.000+00:00",
        "tags": '[{"key": "b", "value": "007"}, {"key": "a", "value": "1"}, {"key": "in", "value": [{"key": "b", "value": "x & \\"y\\" é"}]}]',
        "box": '[{"key": "d", "value": "2020-01-01"}]', "none": "[]"}
    assert got[1, 1] == {"case:concept:name": "c1", "case:meta": meta, "concept:name": "B", "time:timestamp": "2020-01-01T10:02:00.000+00:00"}
    assert got[2, 0] == {"case:concept:name": "c2", "concept:name": "A", "time:timestamp": "2020-01-01T10:03:00.000+00:00"}
    log = read_xes_log(spark, path, attr_keys=["box"]).orderBy("event_pos").collect()
    assert [r.attrs[0].value for r in log] == ['[{"key": "d", "value": "2020-01-01"}]', "nan", "nan"]


def test_plain_log_needs_no_python(spark, tmp_dir):
    path = _log(tmp_dir, [_trace("c1", _event("A", 1))])
    plan = read_xes_events(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_eventless_traces_count_in_the_split(spark, tmp_dir):
    """int(4 * 0.5) = 2 test traces with the two empty ones counted, int(2 * 0.5) = 1 without."""
    full = [_trace("c1", "".join(_event(a, i) for i, a in enumerate("ABCD"))), _trace("c2", "".join(_event(a, 30 + i) for i, a in enumerate("XYZV")))]
    path = _log(tmp_dir, [_trace("e1", ""), full[0], _trace("e2", ""), full[1]])
    cfg = PrefixConfig(base=1, gap=1, m=0, test_share=0.5)
    empty = eventless_traces(read_xes_traces(spark, path))
    assert empty.count() == 2
    log = read_xes_log(spark, path)
    sides = lambda ds: {r.case_id: r.split for r in ds.collect()}
    assert sides(build_dataset(log, cfg, eventless=empty)) == {"c1": "test", "c2": "test"}
    assert sides(build_dataset(log, cfg)) == {"c1": "retrieval", "c2": "test"}
    assert sides(build_dataset(log, cfg, eventless=empty, small_rows=1, rows_per_bucket=2)) == {"c1": "test", "c2": "test"}


def test_split_keeps_header_and_text(spark, tmp_dir):
    """Every trace's text and the header, over several files per split, in the log's order."""
    minutes = [7, 90, 3, 55, None, 21, 90, 14, 62, 35, None]
    traces = [_trace(f"c{i}", "" if m is None else _event("A", 1) + _event("B", m, NESTED)) for i, m in enumerate(minutes)]
    path = _log(tmp_dir, traces)
    out = os.path.join(tmp_dir, "out")
    split_xes(spark, path, out, 0.3, traces_per_file=2)
    order = sorted(range(11), key=lambda i: (-1 if minutes[i] is None else max(1, minutes[i]), i))
    want = {"test": sorted(order[-3:]), "retrieval": sorted(order[:-3])}
    for split, rows in want.items():
        parts = sorted((d for d in os.listdir(f"{out}/split={split}") if d.startswith("part=")), key=lambda d: int(d[5:]))
        assert len(parts) == -(-len(rows) // 2)
        texts = []
        for k, part in enumerate(parts):
            files = [f for f in os.listdir(f"{out}/split={split}/{part}") if f.endswith(".txt")]
            assert len(files) == 1
            text = open(f"{out}/split={split}/{part}/{files[0]}", encoding="utf-8").read()
            body = "\n".join(traces[i] for i in rows[2 * k:2 * k + 2])
            assert text == HEAD + body + "\n</log>\n"
            ET.fromstring(text.encode())
            texts.append(text)
        back = read_xes_traces(spark, f"{out}/split={split}")
        assert [r.string[0]._value for r in back.orderBy("trace_pos").collect()] == [f"c{i}" for i in rows]


def test_split_boundaries(spark, tmp_dir):
    path = _log(tmp_dir, [_trace(f"c{i}", _event("A", i)) for i in range(3)])
    out = os.path.join(tmp_dir, "out")
    count = lambda s: read_xes_traces(spark, f"{out}/split={s}").count()
    split_xes(spark, path, out, 0.1, traces_per_file=1)
    assert (count("retrieval"), count("test")) == (3, 0)
    test = [os.path.join(d, f) for d, _, fs in os.walk(f"{out}/split=test") for f in fs if f.endswith(".txt")]
    assert len(test) == 1 and open(test[0]).read() == HEAD + "</log>\n"
    split_xes(spark, path, out, 0.1, zero_test_means_all=True)       # replaces all former files
    assert (count("retrieval"), count("test")) == (0, 3)
    with pytest.raises(ValueError, match="No <trace>"):
        split_xes(spark, _log(tmp_dir, [], name="empty.xes"), out)


def test_one_file_read_by_many_tasks(spark, tmp_dir):
    """Places are those in the file, whatever the input splits."""
    path = _log(tmp_dir, [_trace(f"c{i}", _event("A" * (i % 50), i % 60)) for i in range(2000)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        records = xes_records(spark, path)
        assert spark.read.option("lineSep", "<trace>").text(path).rdd.getNumPartitions() > 5
        rows = records.select("trace_pos", F.regexp_extract("xml", 'value="c(\\d+)"', 1).cast("int").alias("i")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.trace_pos, r.i) for r in rows) == [(i + 1, i) for i in range(2000)]


def test_several_files(spark, tmp_dir):
    folder = os.path.join(tmp_dir, "many files")
    os.mkdir(folder)
    for k in range(3):
        _log(folder, [_trace(f"c{k}{i}", _event("A", i)) for i in range(3)], name=f"{k}.xes")
    rows = read_xes_traces(spark, folder).orderBy("trace_pos").collect()
    assert [r.string[0]._value for r in rows] == [f"c{k}{i}" for k in range(3) for i in range(3)]
    out = os.path.join(tmp_dir, "out")
    split_xes(spark, folder, out, 0.34)
    assert read_xes_traces(spark, f"{out}/split=test").count() == 3


def test_nested_attributes_pass_python_by_rows(spark):
    """Long traces: Python gets few texts at once, not an Arrow batch of 10,000."""
    from trailcast.sources.xes import nested_attributes
    one = "<trace><list key='l'><values><string key='a' value='b'/></values></list><event/></trace>"
    rows = spark.createDataFrame([(1, one, True), (2, "<trace></trace>", False), (3, "<trace><list", True)], "trace_pos long, xml string, has_nested boolean")
    got = rows.select("trace_pos", nested_attributes(rows).alias("n"))
    assert "BatchEvalPython" in (plan := got._jdf.queryExecution().toString()) and "ArrowEvalPython" not in plan
    assert {r.trace_pos: r.n for r in got.collect()} == {1: [{"l": '[{"key": "a", "value": "b"}]'}, {}], 2: None, 3: None}
