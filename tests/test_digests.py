"""Prefix digests: equal exactly where the texts are, however they are cut, in linear time."""
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailcast.config import PrefixConfig
from trailcast.operators import digests, prefixes
from trailcast.operators.prefixes import block_rows, digested, first_places, with_anchors


def log_blocks(spark, traces, cfg):
    rows = [(c, i, a) for c, acts in enumerate(traces) for i, a in enumerate(acts)]
    events = spark.createDataFrame(rows, "case_id long, idx long, act string").withColumn("plain", F.col("act")).withColumn("rich", F.col("act")).repartition(4)
    table = spark.createDataFrame([(c, c, len(t), "retrieval" if c % 3 else "test") for c, t in enumerate(traces)], "case_id long, trace_pos long, n long, split string")
    return prefixes.trace_blocks(events, table, cfg)


def plain_winners(traces, cfg, cross):
    first = {}
    for c, acts in enumerate(traces):
        split = "retrieval" if c % 3 else "test"
        if len(acts) > 2:
            for i in range(cfg.base, len(acts) - 1, cfg.gap):
                first.setdefault((split, cfg.dedup_sep.join(acts[:i + 1])), (c, i))
    return sorted((s, *w) for (s, t), w in first.items() if not (cross and s == "test" and ("retrieval", t) in first))


@pytest.mark.parametrize("block, sep, m", [(4096, "", 1), (2, "", 2), (3, "|", 1), (8, "", 3)])
def test_winners_by_digest(spark, block, sep, m):
    rng = random.Random(block)
    names = ["a", "b", "ab", "ba", "", "é", "日本", "a b"]
    traces = [[rng.choice(names[:rng.choice([2, 4, 8])]) for _ in range(rng.choice([1, 2, 3, 9, 30]))] for _ in range(60)]
    traces += [traces[3]] * 4 + [["a", "b"] * 25, ["ab"] * 25 + ["b"]]
    cfg = PrefixConfig(base=1, gap=2, m=m, block_size=block, dedup_sep=sep)
    cfg.validate()
    blocks = log_blocks(spark, traces, cfg)
    for cross in (False, True):
        got = sorted((r.split, r.trace_pos, r.anchor) for r in first_places(blocks, cfg, cross).collect())
        assert got == plain_winners(traces, cfg, cross)
    by_text = sorted((r.trace_pos, r.anchor) for r in first_places(blocks.drop("split"), cfg, seed=1).collect())
    assert sorted((r.trace_pos, r.anchor) for r in first_places(blocks.drop("split"), cfg).collect()) == by_text


def test_digest_is_the_polynomial_of_the_text(spark):
    text = ["xy", "", "zé"]
    got = digests._event_digests(pa.array([text, [], ["xyz"], ["q"] * 3], pa.list_(pa.string()))).to_pylist()
    raw = "xyzé".encode()
    want = [sum((b + 1) * pow(digests.BASES[0], i, digests.PRIMES[0]) for i, b in enumerate(raw[:n])) % digests.PRIMES[0] for n in (2, 2, 5)]
    assert [d["h0"] for d in got[0]] == want and [d["size"] for d in got[0]] == [2, 2, 5] and got[1] == []
    piece = pa.array([["a" * 3000, "b"]] * 5 + [["c"]], pa.list_(pa.string())).slice(2, 4)
    assert digests._event_digests(piece).to_pylist()[-1][0]["size"] == 1
    assert all(p < 2 ** 31 and all(p % k for k in range(2, 46341)) for p in digests.PRIMES)


def test_dedup_time_is_linear_in_the_trace(spark):
    """100,000 anchors in one trace: their texts together would be 30 GB."""
    cfg = PrefixConfig(base=1, gap=1, m=1)
    rng = random.Random(0)
    acts = [rng.choice(["review", "pay", "ship"]) for _ in range(100_000)]
    events = spark.createDataFrame(list(enumerate(acts)), "idx long, act string").selectExpr("0L as case_id", "idx", "act", "act as plain", "act as rich")
    blocks = block_rows(events, cfg.block_events, 1).selectExpr("case_id", "blk", "arr", "0L as trace_pos", "100000L as n", "string(null) as cum_plain", "string(null) as cum_key").cache()
    blocks.count()
    begin = time.time()
    assert first_places(blocks, cfg).count() == 99_998
    assert time.time() - begin < 60
    blocks.unpersist()


def test_collisions_need_all_primes(spark):
    """Every anchor of a multi-block trace has its own digest."""
    cfg = PrefixConfig(base=0, gap=1, m=1, block_size=16)
    blocks = log_blocks(spark, [["a"] * 400, ["a", "b"] * 200], cfg)
    rows = with_anchors(digested(blocks, cfg), cfg).select("trace_pos", "anchor", digests.anchor_digest(prefixes._local(cfg)).alias("k")).collect()
    assert len({bytes(r.k) for r in rows}) == len(rows) - 1        # the two traces share "a" alone
