"""Random logs x random (base, gap, m, block_size): the block/scan assembly equals a
direct statement of the semantics (exactly the last m events of a prefix carry values)."""
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from trailcast.config import EventLogSpec, PrefixConfig
from trailcast.plans.build import all_prefixes
from trailcast.sources.eventlog import from_table

SPEC = EventLogSpec(case_col="case", activity_col="act", ts_col=None, pos_col="pos", attr_cols=("v",))

traces_st = st.lists(st.lists(st.sampled_from(["a", "b", "c", "dd"]), min_size=1, max_size=30),
                     min_size=1, max_size=6)


def expected(traces, base, gap, m):
    out = set()
    for c, acts in enumerate(traces):
        n = len(acts)
        if n <= 2:
            continue
        for i in range(base, n - 1, gap):
            def render(j):
                if j > i - m:
                    # key order: column order for events <= base, sorted after (one key here)
                    return f"{acts[j]} - Values: {{'v': '{j}'}}"
                return acts[j]
            out.add((f"c{c}", i, ",".join(render(j) for j in range(i + 1)), acts[i + 1],
                     "".join(acts[: i + 1])))
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(traces=traces_st, base=st.integers(0, 4), gap=st.integers(1, 4), m=st.integers(0, 4),
       block=st.integers(2, 9))
def test_assembly_matches_semantics(spark, traces, base, gap, m, block):
    rows, pos = [], 0
    for c, acts in enumerate(traces):
        for j, a in enumerate(acts):
            rows.append((f"c{c}", a, pos, str(j)))
            pos += 1
    log = from_table(spark.createDataFrame(rows, "case string, act string, pos long, v string"), SPEC)
    got = all_prefixes(log, PrefixConfig(base=base, gap=gap, m=m, block_size=block))
    got = {(r.case_id, r.anchor, r.prefix, r.prediction, r.dedup_key) for r in got.collect()}
    assert got == expected(traces, base, gap, m)


rows_st = st.lists(st.tuples(st.sampled_from(["hot", "hot", "hot", "a", "b", "c"]),
                             st.integers(-5, 5), st.text(alphabet="xyzé", max_size=3)),
                   min_size=1, max_size=300)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=rows_st, per_bucket=st.integers(1, 60), grouped=st.booleans())
def test_bucketed_ranking_matches_window(spark, rows, per_bucket, grouped):
    from trailcast.operators.ranking import row_number_within
    data = [(g, k, s, i) for i, (g, k, s) in enumerate(rows)]     # i makes the order unique
    df = spark.createDataFrame(data, "g string, k long, s string, i long")
    part = ["g"] if grouped else []
    plain = row_number_within(df, ["k", "s", "i"], part)
    buck = row_number_within(df, ["k", "s", "i"], part, small_rows=0, rows_per_bucket=per_bucket)
    assert sorted(tuple(r) for r in plain.collect()) == sorted(tuple(r) for r in buck.collect())


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(st.text(alphabet=st.sampled_from(
    ["a", "'", '"', "\\", "\n", "\t", "\r", "\x00", "\x07", "\x1f", "\x7f", "\x85", "\xa0", "\xad",
     "é", " ", "{", "}"]), max_size=8), min_size=1, max_size=30))
def test_py_repr_matches_python_repr(spark, texts):
    from trailcast.functions.text import py_repr
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(py_repr(F.col("t"))).collect()] == [repr(t) for t in texts]
