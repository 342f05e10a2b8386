"""Golden cases derived by hand from the reference semantics (FIXTURES.md §3)."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from trailcast.config import EventLogSpec, PrefixConfig
from trailcast.functions.naming import eval_config, eval_config_key, parse_variant, variant_name_py
from trailcast.functions.text import (abbreviate, bytes_to_mb, extract_answer, format_duration,
                                      length_bucket, prefix_length, trim_last_m_values)
from trailcast.operators.metrics import (classification_metrics, first_n_valid, mean_report)
from trailcast.operators.prefixes import dedup_first_wins
from trailcast.operators.rerank import rerank_topk
from trailcast.operators.runs import table_equality
from trailcast.operators.split import temporal_split
from trailcast.plans.build import all_prefixes
from trailcast.sources.eventlog import from_table

SPEC = EventLogSpec(case_col="case", activity_col="act", ts_col=None, pos_col="pos", attr_cols=())


def _log(spark, traces):
    rows, pos = [], 0
    for case, acts in traces:
        for a in acts:
            rows.append((case, a, pos))
            pos += 1
    return from_table(spark.createDataFrame(rows, "case string, act string, pos long"), SPEC)


@pytest.mark.parametrize("n,base,gap,expected", [
    (2, 0, 1, []), (3, 1, 3, [1]), (6, 1, 3, [1, 4]), (5, 1, 1, [1, 2, 3]), (5, 0, 2, [0, 2]), (5, 4, 1, [])])
def test_anchors(spark, n, base, gap, expected):
    log = _log(spark, [("c", [chr(65 + i) for i in range(n)])])
    got = sorted(r.anchor for r in all_prefixes(log, PrefixConfig(base=base, gap=gap, m=0)).collect())
    assert got == expected


def test_prefix_text_reference_key_order(spark):
    rows = [("c", a, i, f"t{i + 1}", f"r{i + 1}") for i, a in enumerate("ABCDE")]
    df = spark.createDataFrame(rows, "case string, act string, pos long, `time:timestamp` string, `org:resource` string")
    spec = EventLogSpec(case_col="case", activity_col="act", ts_col=None, pos_col="pos",
                        attr_cols=("time:timestamp", "org:resource"))
    out = {r.anchor: r for r in all_prefixes(from_table(df, spec), PrefixConfig(base=1, gap=1, m=2)).collect()}
    assert out[1].prefix == "A - Values: {'titi': 't1', 'orre': 'r1'},B - Values: {'titi': 't2', 'orre': 'r2'}"
    assert out[2].prefix == "A,B - Values: {'titi': 't2', 'orre': 'r2'},C - Values: {'orre': 'r3', 'titi': 't3'}"
    assert out[3].prefix == "A,B,C - Values: {'orre': 'r3', 'titi': 't3'},D - Values: {'orre': 'r4', 'titi': 't4'}"
    assert [out[i].prediction for i in (1, 2, 3)] == ["C", "D", "E"]
    assert [out[i].dedup_key for i in (1, 2, 3)] == ["AB", "ABC", "ABCD"]


def test_activities_only(spark):
    log = _log(spark, [("c", list("ABCDEF"))])
    out = {r.anchor: (r.prefix, r.prediction) for r in all_prefixes(log, PrefixConfig(base=1, gap=3, m=0)).collect()}
    assert out == {1: ("A,B", "C"), 4: ("A,B,C,D,E", "F")}


def test_dedup_first_wins_ignores_label(spark):
    log = _log(spark, [("t1", ["A", "B", "C"]), ("t2", ["A", "B", "D"]),
                       ("t3", ["AB", "C", "X"]), ("t4", ["A", "BC", "Y"])])
    pre = all_prefixes(log, PrefixConfig(base=1, gap=3, m=0)).withColumn("split", F.lit("test"))
    got = sorted((r.prefix, r.prediction) for r in dedup_first_wins(pre, ["split"]).collect())
    assert got == [("A,B", "C"), ("AB,C", "X")]


def _traces(spark):
    ts = lambda x: None if x is None else dt.datetime(2020, 1, 1, 0, 0, x)
    return spark.createDataFrame([(f"c{i}", i, ts(e)) for i, e in enumerate([5, 3, 5, None])],
                                 "case_id string, trace_pos long, end_ts timestamp_ntz")


@pytest.mark.parametrize("p,quirk,expected", [(0.3, False, {"c2"}), (0.5, False, {"c0", "c2"}),
                                              (0.2, False, set()), (0.2, True, {"c0", "c1", "c2", "c3"})])
def test_temporal_split(spark, p, quirk, expected):
    out = temporal_split(_traces(spark), p, zero_test_means_all=quirk)
    assert {r.case_id for r in out.collect() if r.split == "test"} == expected


@pytest.mark.parametrize("key,abbr", [("time:timestamp", "titi"), ("lifecycle:transition", "litr"),
                                      ("org:resource", "orre"), ("Cumulative net worth (EUR)", "Cunewo(E"),
                                      ("id", "id"), ("a::b", "ab")])
def test_abbreviation(spark, key, abbr):
    assert spark.range(1).select(abbreviate(F.lit(key))).first()[0] == abbr


def test_abbreviation_collision(spark):
    df = spark.createDataFrame([("c", "A", 0, "r", "q")],
                               "case string, act string, pos long, `org:resource` string, `ord:reason` string")
    spec = EventLogSpec(case_col="case", activity_col="act", ts_col=None, pos_col="pos")
    attrs = from_table(df, spec).first().attrs
    assert [(a.key, a.value) for a in attrs if a.key == "orre"] == [("orre", "q")]


def test_trim_and_length(spark):
    s = "A - Values: {'x': '1'},B - Values: {'x': '2'}"
    df = spark.createDataFrame([(s,), ("A - Values: {'x': '1, 2'},B",), ("A, ,B",), ("",)], "p string")
    r = df.select(trim_last_m_values(F.col("p"), 1).alias("t1"), trim_last_m_values(F.col("p"), 2).alias("t2"),
                  prefix_length(F.col("p")).alias("n")).collect()
    assert r[0].t1 == "A,B - Values: {'x': '2'}" and r[0].t2 == s
    assert [x.n for x in r] == [2, 2, 2, 0]


def test_buckets(spark):
    df = spark.createDataFrame([(v,) for v in (0, 5, 6, 20, 30, 31)], "n int")
    assert [r[0] for r in df.select(length_bucket(F.col("n"))).collect()] == \
        ["1-5", "1-5", "6-10", "11-20", "21-30", "31+"]


def test_answer_parsing(spark):
    cases = [("x <answer>Send Fine</answer> y", "send fine"),
             ('<answer>\n"Send\\ Fine"\n</answer>', "send fine"),
             ("<answer>a</answer><answer>b</answer>", "a"),
             ("<answer>N/A</answer>", None), ("<answer></answer>", None), ("<answer>None</answer>", None),
             ("Send Fine", None), ("", None), ("<ANSWER>a</ANSWER>", None),
             ('<answer>" a "</answer>', " a ")]
    df = spark.createDataFrame([(c,) for c, _ in cases], "raw string")
    assert [r[0] for r in df.select(extract_answer(F.col("raw"))).collect()] == [e for _, e in cases]


def test_metrics_golden(spark):
    df = spark.createDataFrame(list(zip("aabc", "abbd")), "gold string, pred string")
    m = classification_metrics(df).first()
    assert (m.total_samples, m.correct_predictions, m.accuracy) == (4, 2, 0.5)
    assert m.precision_macro == 0.375 and m.recall_macro == 0.375
    assert abs(m.f1_macro - 1 / 3) < 1e-8
    empty = classification_metrics(df.limit(0)).collect()  # empty input: all zero
    assert [tuple(r) for r in empty] == [(0, 0, 0.0, 0.0, 0.0, 0.0)]


def test_mean_report(spark):
    reps = spark.createDataFrame([("d1", 0.5, 0.5, 0.5, 0.5, 4, 2), ("d2", 1.0, 1.0, 1.0, 1.0, 1, 1)],
                                 "dataset string, accuracy double, precision_macro double, recall_macro double, "
                                 "f1_macro double, total_samples long, correct_predictions long")
    r = mean_report(reps).first()
    assert r.mean_accuracy == 0.75 and r.micro_accuracy_over_all_samples == 0.6
    assert (r.total_samples, r.total_correct_predictions, r.dataset_count) == (5, 3, 2)


@pytest.mark.parametrize("max_rows,scored,skipped", [(2, 2, 2), (9, 3, 2)])
def test_first_n_valid(spark, max_rows, scored, skipped):
    rows = spark.createDataFrame([(i + 1, "x" if v else None) for i, v in enumerate([0, 1, 0, 1, 1])],
                                 "row_index long, pred string")
    out = first_n_valid(rows, max_rows).collect()
    assert sum(r.pred is not None for r in out) == scored and sum(r.pred is None for r in out) == skipped


def test_rerank_golden(spark):
    c = spark.createDataFrame([(0, i + 1, i, s, p) for i, (s, p) in
                               enumerate(zip([0.9, 0.8, 0.7, 0.6], [0.1, 2.0, 2.0, -1.0]))],
                              "query_id long, rank long, point_id long, score double, pair_score double")
    got = [(r.point_id, r.score) for r in rerank_topk(c, 2, "pair_score").orderBy("rank").collect()]
    assert got == [(1, 2.0), (2, 2.0)]
    two = c.filter("rank <= 2")
    got2 = [(r.point_id, r.score) for r in rerank_topk(two, 2, "pair_score").orderBy("rank").collect()]
    assert got2 == [(0, 0.9), (1, 0.8)]


def test_variant_names_and_config(spark):
    assert variant_name_py("X", 1, 3, 1) == "b1_g3_X"
    assert variant_name_py("X", 1, 3, 3, cross_dedup=True) == "last_3_b1_g3_X_trace_dedup"
    assert variant_name_py("X", 1, 3, 3, "row", True) == "last_3_b1_g3_X_row"
    df = spark.createDataFrame([("last_3_b1_g3_X_trace_dedup",), ("b1_g3_X_row",), ("X",)], "d string")
    r = df.select(parse_variant(F.col("d")).alias("v"),
                  eval_config(F.col("d"), None, None, None, 3, None, None, None)["split_type"].alias("st")).collect()
    assert [(x.v.base, x.v.gap, x.v.m, x.st) for x in r] == [
        (1, 3, 3, "trace_level"), (1, 3, 1, "row_level"), (None, None, None, "trace_level")]
    key = df.select(eval_config_key(eval_config(F.col("d"), "hashing", None, None, 3, None, None, None))).first()[0]
    assert key.startswith("dataset=last_3_b1_g3_X_trace_dedup|base=1|gap=3|m=3|top_k=3|max_rows=None|model_id=hashing")


def test_formatting(spark):
    df = spark.createDataFrame([(59.6,), (3661.0,), (0.5,)], "s double")
    assert [r[0] for r in df.select(format_duration(F.col("s"))).collect()] == ["1m 0s", "1h 1m 1s", "0m 0s"]
    assert spark.range(1).select(bytes_to_mb(F.lit(1572864))).first()[0] == 1.5


def test_table_equality(spark):
    base = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    same = spark.createDataFrame([("b", 2), ("a", 1), ("a", 1)], "k string, v int")
    diff = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "k string, v int")
    firsts = spark.createDataFrame([("a", 1), ("a", 9), ("b", 2)], "k string, v int")
    res = lambda o: tuple(table_equality(base, o).first())
    assert res(same) == (True, True) and res(diff) == (False, False) and res(firsts) == (True, False)


def test_nested_value_spans(spark):
    s = "A - Values: {'x': '{a{b{c}}}'},B - Values: {'y': '{\"k\": {\"j\": 1}}'},C"
    r = spark.createDataFrame([(s,)], "p string").select(
        prefix_length(F.col("p")).alias("n"), trim_last_m_values(F.col("p"), 1).alias("t")).first()
    assert r.n == 3
    assert r.t == "A,B - Values: {'y': '{\"k\": {\"j\": 1}}'},C"


def test_normalize_label_matches_python_strip_and_casefold(spark):
    from trailcast.functions.text import normalize_label
    raw = ["\x1c Straße ", "ΣΟΦΟΣ", "ﬁnal ſtep", "\"'Send\\ Fine'\"", "İstanbul"]
    expected = [r.replace("\\ ", " ").strip().strip("\"'").casefold() for r in raw]
    df = spark.createDataFrame([(r,) for r in raw], "x string")
    assert [r[0] for r in df.select(normalize_label(F.col("x"))).collect()] == expected


def test_float_text_matches_python(spark):
    """Guarantee: Python's str(float) for every value with at most 15 significant digits
    (any magnitude) and for nan / inf. Values needing 16-17 digits may keep Java's
    17-digit text when Java's digits are not the shortest."""
    import random
    from trailcast.functions.text import python_float_text
    rnd = random.Random(7)
    vals = [0.0, 1.0, 6.55, 1e7, 12345678.0, 1e16, 1e-4, 1e-5, float("nan"), float("inf"), -2.5e-7, 1e22]
    vals += [float(f"{rnd.uniform(-1, 1) * 10 ** rnd.randint(-8, 20):.{rnd.randint(0, 14)}e}") for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert [r[0] for r in df.select(python_float_text(F.col("x"))).collect()] == [str(v) for v in vals]


def test_spans_of_any_length_and_depth(spark):
    big = "a - Values: {'x': '" + "y" * 1_000_000 + "'},b"
    deep = "a - Values: {'x': '" + "{" * 50 + "z" + "}" * 50 + "'},b, c - Values: {'q': '1'}"
    inner = "a - Values: {'x': '{b - Values: {c}}'},d - Values: {open,e"
    df = spark.createDataFrame([(big,), (deep,), (inner,)], "p string")
    r = df.select(prefix_length(F.col("p")).alias("n"), trim_last_m_values(F.col("p"), 1).alias("t")).collect()
    assert [x.n for x in r] == [2, 3, 3]
    assert r[0].t == big and r[1].t == "a,b, c - Values: {'q': '1'}" and r[2].t == inner


def test_casefold_is_the_full_folding(spark):
    from trailcast.functions.text import casefold
    texts = ["Straße ﬃ ς", "ΑΒΓ", "ẞᎠꭰ", "plain", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(casefold(F.col("t"))).collect()] == [t.casefold() for t in texts]
