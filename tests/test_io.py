"""Sources and sinks: XES, prefix CSV, run history JSON, attribute labels, partitioned writes."""
import json
import os

from pyspark.sql import functions as F

from trailcast.config import PrefixConfig
from trailcast.operators.runs import group_history, history_entries
from trailcast.plans.build import all_prefixes, build_dataset
from trailcast.sinks.writers import write_prefix_csv, write_vectors, write_xes
from trailcast.sources.eventlog import read_xes_log, read_xes_traces
from trailcast.sources.tables import read_attribute_labels, read_prefix_table, read_run_history

XES = """<?xml version="1.0" encoding="UTF-8"?>
<log xes.version="1.0">
{traces}
</log>
"""


def _event(act, minute, lc="complete", res="r"):
    return (f'<event><string key="concept:name" value="{act}"/>'
            f'<date key="time:timestamp" value="2020-01-01T10:{minute:02d}:00.000+00:00"/>'
            f'<string key="lifecycle:transition" value="{lc}"/>'
            f'<string key="org:resource" value="{res}"/></event>')


def _write_xes(tmp_dir):
    t1 = "".join(_event(a, i) for i, a in enumerate("ABCDE"))
    t1 += _event("Z", 30, lc="start")          # dropped by the lifecycle filter
    t2 = "".join(_event(a, 10 + i, res="s") for i, a in enumerate("ABX"))
    t3 = "".join(_event(a, 40 + i) for i, a in enumerate("QR"))
    traces = "\n".join(f'<trace><string key="concept:name" value="{c}"/>'
                       f'<string key="region" value="north"/>{body}</trace>'
                       for c, body in [("case1", t1), ("case2", t2), ("case3", t3)])
    path = os.path.join(tmp_dir, "log.xes")
    with open(path, "w") as f:
        f.write(XES.format(traces=traces))
    return path


def test_xes_to_prefixes(spark, tmp_dir):
    log = read_xes_log(spark, _write_xes(tmp_dir))
    assert log.count() == 11
    pre = {(r.case_id, r.anchor): r for r in all_prefixes(log, PrefixConfig(base=1, gap=1, m=1)).collect()}
    assert pre[("case1", 1)].prefix == \
        "A,B - Values: {'litr': 'complete', 'orre': 'r', 'titi': '2020-01-01 10:01:00+00:00'}"
    assert pre[("case1", 3)].prediction == "E"
    assert ("case1", 4) not in pre          # the trailing 'start' event is filtered out
    assert pre[("case2", 1)].prediction == "X"
    assert not any(c == "case3" for c, _ in pre)   # two events: no prefix


def test_xes_split_and_write(spark, tmp_dir):
    path = _write_xes(tmp_dir)
    ds = build_dataset(read_xes_log(spark, path), PrefixConfig(base=1, gap=1, m=0, test_share=0.4))
    # case3 ends last (10:41) but yields nothing; it is still the one test trace (int(3*0.4)=1)
    assert {r.split for r in ds.collect()} == {"retrieval"}
    traces = read_xes_traces(spark, path)
    assert [r.trace_pos for r in traces.orderBy("trace_pos").collect()] == [1, 2, 3]
    out = os.path.join(tmp_dir, "split_xes")
    write_xes(traces.withColumn("split", F.when(F.col("trace_pos") == 3, "test").otherwise("retrieval"))
              .drop("trace_pos"), out)
    back = read_xes_traces(spark, os.path.join(out, "split=retrieval"))
    assert back.count() == 2


def test_prefix_csv_roundtrip(spark, tmp_dir):
    rows = [("A,B - Values: {'x': 'a \"q\"'}", "C", "retrieval"), ("line\nbreak,D", "NA", "test"),
            ("E", "null", "test")]
    df = spark.createDataFrame(rows, "prefix string, prediction string, split string")
    out = write_prefix_csv(df, os.path.join(tmp_dir, "csv"))
    back = read_prefix_table(spark, os.path.join(out, "split=test"))
    assert sorted(tuple(r) for r in back.collect()) == [("E", "null"), ("line\nbreak,D", "NA")]


def _report(ds, acc, top_k=None):
    return {"dataset": ds, "model_id": "hashing", "llm": "vote", "prompt_variant": None, "top_k": top_k,
            "accuracy": acc, "total_samples": 4, "correct_predictions": 2}


def test_run_history_layouts(spark, tmp_dir):
    legacy = [{"timestamp": "2024-01-01T00:00:00", "run_label": "a", "top_k": 3, "max_rows": None,
               "reports": [_report("b1_g3_x", 0.5, 5), _report("b1_g3_y_row", 0.7)]},
              {"timestamp": "2024-01-02T00:00:00", "run_label": "b", "top_k": None,
               "reports": [_report("b1_g3_x", 0.6, 3)]}]
    p1 = os.path.join(tmp_dir, "legacy.json")
    with open(p1, "w", encoding="utf-8-sig") as f:
        json.dump(legacy, f)
    entries = history_entries(read_run_history(spark, p1))
    g = {r.config_key: r for r in group_history(entries).collect()}
    x = [k for k in g if k.startswith("dataset=b1_g3_x|")]
    assert len(x) == 1 and g[x[0]].n_runs == 2 and "top_k=3" in x[0]
    y = [r for k, r in g.items() if k.startswith("dataset=b1_g3_y_row|")]
    assert y[0].split_type == "row_level"
    keyed = {"dataset=b1_g3_x|...": {"config": {"top_k": "3"}, "runs": [
        {"timestamp": "2024-01-03", "run_label": "c", "metrics": _report("b1_g3_x", 0.9)}]}}
    p2 = os.path.join(tmp_dir, "keyed.json")
    with open(p2, "w") as f:
        json.dump(keyed, f)
    r = read_run_history(spark, p2).collect()
    assert len(r) == 1 and r[0].run_label == "c" and r[0].accuracy == 0.9


def test_attribute_labels(spark, tmp_dir):
    assert read_attribute_labels(spark, os.path.join(tmp_dir, "missing.json")).count() == 0
    p = os.path.join(tmp_dir, "empty.json")
    with open(p, "w") as f:
        f.write("{}")
    assert read_attribute_labels(spark, p).count() == 0
    p2 = os.path.join(tmp_dir, "labels.json")
    with open(p2, "w") as f:
        json.dump({"litr": "lifecycle:transition", "va": "va"}, f)
    assert sorted(tuple(r) for r in read_attribute_labels(spark, p2).collect()) == [
        ("litr", "lifecycle:transition"), ("va", "va")]


def test_vector_collections_replace_only_their_partition(spark, tmp_dir):
    path = os.path.join(tmp_dir, "vectors")
    mk = lambda variant, n: spark.createDataFrame(
        [("hashing", variant, i, [1.0, 0.0], "p", "q") for i in range(n)],
        "model_id string, variant string, point_id long, embedding array<double>, prefix string, prediction string")
    write_vectors(mk("v1", 3), path)
    write_vectors(mk("v2", 2), path)
    write_vectors(mk("v1", 1), path)     # recreate collection v1 only
    got = {r.variant: r["count"] for r in spark.read.parquet(path).groupBy("variant").count().collect()}
    assert got == {"v1": 1, "v2": 2}


def test_split_log_runs_and_reports(spark, tmp_dir):
    from trailcast.catalog.prefix_q import orders_log
    from trailcast.operators.runs import latest_per_key
    from trailcast.operators.split import temporal_split
    from trailcast.operators.traces import trace_table
    from trailcast.sinks.writers import append_runs, replace_report, write_split_log
    log = orders_log(spark, "/root/testdata/sf0.001")
    split = temporal_split(trace_table(log), 0.3)
    out = write_split_log(log, split, os.path.join(tmp_dir, "split_log"))
    back = spark.read.parquet(out)
    assert back.count() == log.filter("case_id IS NOT NULL").count()
    n_test = split.filter("split = 'test'").count()
    assert back.filter("split = 'test'").select("case_id").distinct().count() == n_test
    runs = os.path.join(tmp_dir, "runs")
    entry = spark.createDataFrame([("2024-01-01", "a", "k1", 0.5)], "timestamp string, run_label string, "
                                  "config_key string, accuracy double")
    append_runs(entry, runs)
    append_runs(entry.withColumn("run_label", F.lit("b")), runs)
    assert spark.read.parquet(runs).count() == 2
    reports = os.path.join(tmp_dir, "reports")
    r1 = spark.createDataFrame([("b1_g3", "2024-01-01", "r1"), ("b2_g3", "2024-01-01", "r2")],
                               "variant_key string, timestamp string, run_label string")
    replace_report(latest_per_key(r1, "variant_key", ["timestamp", "run_label"]), reports)
    r2 = spark.createDataFrame([("b1_g3", "2024-02-01", "r3")], "variant_key string, timestamp string, run_label string")
    replace_report(r2, reports)
    got = {r.variant_key: r.run_label for r in spark.read.parquet(reports).collect()}
    assert got == {"b1_g3": "r3", "b2_g3": "r2"}


def test_execution_report_sizes(spark, tmp_dir):
    from trailcast.operators.runs import execution_report
    df = spark.range(1000).withColumn("x", F.col("id") * 2)

    def writer(name, d):
        path = os.path.join(tmp_dir, name)
        d.coalesce(2).write.parquet(path)
        return path

    def boom():
        raise ValueError("bad log")

    rep = {r.dataset: r for r in execution_report(spark, {"ok": lambda: df, "bad": boom}, writer).collect()}
    files = [f for f in os.listdir(os.path.join(tmp_dir, "ok")) if f.endswith(".parquet")]
    on_disk = sum(os.path.getsize(os.path.join(tmp_dir, "ok", f)) for f in files)
    assert rep["ok"].output_rows == 1000 and rep["ok"].output_bytes == on_disk
    assert rep["bad"].error.startswith("ValueError") and rep["bad"].output_rows is None


def test_xes_composite_mode(spark, tmp_dir):
    """Composite labels: name+lifecycle+resource, no lifecycle filter, those keys leave
    the value map."""
    keys = ("lifecycle:transition", "org:resource")
    log = read_xes_log(spark, _write_xes(tmp_dir), activity_keys=keys)
    cfg = PrefixConfig(base=1, gap=1, m=1, lifecycle_filter=False)
    pre = {(r.case_id, r.anchor): r for r in all_prefixes(log, cfg).collect()}
    assert pre[("case1", 1)].prefix == "A+complete+r,B+complete+r - Values: {'titi': '2020-01-01 10:01:00+00:00'}"
    assert pre[("case1", 4)].prediction == "Z+start+r"      # not filtered in this mode
    assert pre[("case1", 1)].dedup_key == "A+complete+rB+complete+r"


def test_xes_timestamp_styles(spark):
    from trailcast.sources.eventlog import xes_timestamp_text
    df = spark.createDataFrame([("2011-10-01T00:38:44.546+02:00",), ("2011-10-01T00:38:44.000Z",),
                                ("2011-10-01T00:38:44+0130",)], "t string")
    got = lambda style: [r[0] for r in df.select(xes_timestamp_text(F.col("t"), style)).collect()]
    assert got("as_written") == ["2011-10-01 00:38:44.546000+02:00", "2011-10-01 00:38:44+00:00",
                                 "2011-10-01 00:38:44+01:30"]
    assert got("utc_offset") == ["2011-09-30 22:38:44.546000+00:00", "2011-10-01 00:38:44+00:00",
                                 "2011-09-30 23:08:44+00:00"]
    assert got("naive")[0] == "2011-09-30 22:38:44.546000"


def test_labels_round_trip(spark, tmp_dir):
    from trailcast.sinks.writers import write_labels
    df = spark.createDataFrame([("v1", "ev", "event"), ("v1", "am", "amount"), ("v2", "ev", "other")],
                               "variant string, key string, label string")
    path = write_labels(df, os.path.join(tmp_dir, "labels"))
    got = sorted(tuple(r) for r in read_attribute_labels(spark, f"{path}/variant=v1").collect())
    assert got == [("am", "amount"), ("ev", "event")]


def test_xes_repeated_key_last_value_wins(spark, tmp_dir):
    from trailcast.sources.eventlog import read_xes_events
    path = os.path.join(tmp_dir, "log.xes")
    with open(path, "w") as f:
        f.write('<log><trace><string key="concept:name" value="t"/><event><string key="concept:name" value="a"/>'
                '<string key="x" value="1"/><string key="x" value="2"/></event></trace></log>')
    rows = read_xes_events(spark, path).collect()
    assert [r.attributes for r in rows] == [{"case:concept:name": "t", "concept:name": "a", "x": "2"}]
