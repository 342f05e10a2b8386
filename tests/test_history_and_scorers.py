"""Grouped run history, text pair scorers, approximate evaluation and run reports."""
import random

import pytest
from pyspark.sql import functions as F

from trailcast.config import EvalConfig, PrefixConfig
from trailcast.operators import rerank
from trailcast.operators.runs import history_entries
from trailcast.plans.build import build_dataset
from trailcast.plans.evaluate import evaluate, run_reports
from trailcast.session import materialize
from trailcast.sinks import run_history
from trailcast.sinks.run_history import RunHistory
from trailcast.sources.eventlog import EVENTS_SPEC, from_table

SF = "/root/testdata/sf0.001"


def test_history_keeps_entries_in_order(spark, tmp_dir, monkeypatch):
    """Merges equal appending to lists in memory; a list is cut into chunks, none above the size."""
    monkeypatch.setattr(run_history, "CHUNK", 4)
    history, want, rng = RunHistory(spark, tmp_dir), {}, random.Random(5)
    for step in range(4):
        keys = [rng.choice(["hot"] * 5 + ["a", "b", f"new{step}", None]) for _ in range([23, 1, 9, 14][step])]
        rows = [(k, ("d", step), f"t{step}-{i:03d}", f"run {i}", float(i)) for i, k in enumerate(keys)]
        for k, _c, t, label, acc in rows:
            want.setdefault(k, []).append((t, label, acc))
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "config_key string, config struct<dataset: string, step: int>, timestamp string, run_label string, accuracy double")
        history.merge(df, ["timestamp"])
        got = {}
        for r in sorted(history.entries().collect(), key=lambda r: r.position):
            got.setdefault(r.config_key, []).append((r.timestamp, r.run_label, r.accuracy))
            assert r.position == len(got[r.config_key])
        assert got == want
    assert history.grouped().agg(F.max(F.size("runs"))).first()[0] == 4
    assert history.grouped().groupBy("config_key", "chunk").count().where("count > 1").count() == 0


def test_clip_pair():
    assert rerank.clip_pair("a b c", "d", 10) == ("a b c", "d")
    assert rerank.clip_pair("a b c d e", "x y", 4) == ("a b", "x y")
    assert rerank.clip_pair("a b", "u v w x y z", 3) == ("a", "u v") or rerank.clip_pair("a b", "u v w x y z", 3) == ("a b", "u")
    assert rerank.clip_pair("", "u v w", 2) == ("", "u v") and rerank.clip_pair("a,b", "c", 0) == ("", "")
    for n in range(9):
        a, b = rerank.clip_pair("one, two. three", "four five, six; seven", n)
        assert len(rerank.TOKEN.findall(a)) + len(rerank.TOKEN.findall(b)) == n


def load_common_words():
    def common_words(q, c):
        return [float(len(set(a.split()) & set(b.split()))) for a, b in zip(q, c)]
    return lambda: common_words                        # by value: workers don't import this module


common_words = load_common_words()()


def test_text_scorer_loads_once_a_task_and_clips(spark, tmp_dir):
    def load():
        open(f"{tmp_dir}/{random.random()}", "w").close()
        return lambda q, c: [float(max(len(rerank.TOKEN.findall(a + " " + b)) for a, b in zip(q, c)))] * len(q)
    scorer = rerank.text_pair_scorer(load, max_tokens=512, batch=7)
    rows = [(i, "word " * (i * 20), "x" if i % 3 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "i long, q string, c string").repartition(2)
    got = df.select(scorer(F.col("q"), F.col("c")).alias("s")).collect()
    import os
    assert max(r.s for r in got) == 512 and len(os.listdir(tmp_dir)) == 2


@pytest.fixture(scope="module")
def prefixes(spark):
    log = from_table(spark.read.parquet(f"{SF}/events.parquet"), EVENTS_SPEC)
    return materialize(build_dataset(log, PrefixConfig(base=1, gap=3, m=1)), ["split"])


def test_evaluate_with_a_text_scorer(spark, prefixes):
    """The pool is ordered by the scorer on the two prefix texts, ties by the first stage."""
    cfg = EvalConfig(top_k=2, reranker="words", rerank_pool_k=6)
    got = evaluate(prefixes, cfg, variant="v", scorers={"words": rerank.text_pair_scorer(load_common_words())})
    pool = evaluate(prefixes, EvalConfig(top_k=6), variant="v").neighbours.collect()
    text = {r.row_id: r.prefix for r in prefixes.where("split = 'test'").collect()}
    want = {}
    for q in {r.query_id for r in pool}:
        mine = [(-common_words([text[q]], [r.prefix])[0], r["rank"], r.point_id) for r in pool if r.query_id == q]
        want[q] = [p for _s, _r, p in sorted(mine)[:2]]
    found = {}
    for r in sorted(got.neighbours.collect(), key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append(r.point_id)
    assert found == want and got.metrics.first().reranker_model == "words"
    with pytest.raises(ValueError):
        evaluate(prefixes, cfg)


def test_approximate_evaluation_and_run_reports(spark, prefixes, tmp_dir):
    cfg = EvalConfig(top_k=3, approx=True)
    approx, exact = evaluate(prefixes, cfg, variant="b1_g3_events"), evaluate(prefixes, EvalConfig(top_k=3), variant="b1_g3_events")
    pairs = lambda r: {(x.query_id, x.point_id) for x in r.neighbours.select("query_id", "point_id").collect()}
    a, e = pairs(approx), pairs(exact)
    assert len(a & e) >= 0.9 * len(e)
    reports = run_reports(approx, cfg, "nightly", "2024-05-01T00:00:00")
    entries = history_entries(reports)
    row = entries.first()
    assert (row.timestamp, row.run_label, row.config.dataset) == ("2024-05-01T00:00:00", "nightly", "b1_g3_events")
    history = RunHistory(spark, tmp_dir)
    for label in ("nightly", "again"):
        e = history_entries(run_reports(exact, EvalConfig(top_k=3), label, "2024-05-02"))
        history.merge(e.select("config_key", "config", "timestamp", "run_label", "accuracy"), ["timestamp", "run_label"])
    assert [(r.position, r.run_label) for r in history.entries().orderBy("position").collect()] == [(1, "nightly"), (2, "again")]
    with pytest.raises(ValueError):
        EvalConfig(approx_recall=0).validate()
