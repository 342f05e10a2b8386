"""Prefix operators: anchors (F2), next activity (F3), cumulative prefix text (F4, I2),
dedup key (I4), first-wins dedup (E4), cross-split anti join (D3), trace text (E1).

Assembly works on bounded blocks of ``block_size`` consecutive events of one trace:

1. every event is rendered once, row-locally (activity text, value-map text);
2. events are grouped per (trace, block); a block also receives the first
   ``max(m, 1)`` events of the next block so that every anchor finds its value window
   and its label inside one block row (groups are bounded by block_size + m);
3. the text of all *earlier* blocks of a trace comes from a Hillis-Steele prefix scan
   over the block table: ceil(log2(blocks per trace)) rounds of equi-joins on
   (trace, block) - unique keys, so a hot trace is spread over many tasks. Logs whose
   longest trace fits in one block (the usual case) skip the scan entirely;
4. anchors are generated per block with ``sequence`` and rendered with ``slice`` +
   ``transform`` on the block array.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailcast.config import PrefixConfig
from trailcast.functions.text import VALUES_MARKER, py_repr
from trailcast.operators.digests import BEFORE, anchor_digest, earlier_digests, with_event_digests
from trailcast.operators.split import seeded_order_key

def map_text(attrs: Column, sort_keys: bool) -> Column:
    arr = F.array_sort(attrs) if sort_keys else attrs
    items = F.transform(arr, lambda a: F.concat(py_repr(a["key"]), F.lit(": "), py_repr(a["value"])))
    return F.concat(F.lit("{"), F.array_join(items, ", "), F.lit("}"))


def event_columns(log: DataFrame, cfg: PrefixConfig) -> DataFrame:
    """The columns that the order and the texts of the events are made of. A ranking sorts and
    writes its rows whole, so the others are left out before it."""
    if cfg.m == 0:
        texts = []
    elif "vals_sorted" not in log.columns:
        texts = ["attrs"]
    else:
        texts = ["vals_sorted"] if cfg.key_order == "sorted" else ["vals_cols", "vals_sorted"]
    return log.select("case_id", "event_pos", "activity", "ts", *texts)


def render_events(pos_log: DataFrame, cfg: PrefixConfig) -> DataFrame:
    """Per event: ``act`` (label / dedup part), ``plain`` (activity only) and ``rich``
    (activity + value map). Reference key order: events rendered with the first anchor
    (idx <= base) keep column order, later ones are sorted (§2.13.2)."""
    act = F.coalesce(F.col("activity"), F.lit("nan"))
    pre = "vals_sorted" in pos_log.columns      # rendered natively by the source adapter
    by_key = F.col("vals_sorted") if pre else map_text(F.col("attrs"), True)
    by_cols = F.col("vals_cols") if pre else map_text(F.col("attrs"), False)
    if cfg.m == 0:
        rich = act
    elif cfg.key_order == "sorted":
        rich = F.concat(act, F.lit(VALUES_MARKER), by_key)
    else:
        rich = F.concat(act, F.lit(VALUES_MARKER), F.when(F.col("idx") <= cfg.base, by_cols).otherwise(by_key))
    return pos_log.withColumn("act", act).withColumn("plain", act).withColumn("rich", rich)


def block_rows(events: DataFrame, block_size: int, spill: int, tasks: int | None = None) -> DataFrame:
    """(case_id, blk, arr): events of one block sorted by idx, plus the first ``spill``
    events of the next block; grouped by ``tasks`` tasks if given."""
    blk = F.floor(F.col("idx") / block_size).cast("long")
    spill_into_prev = (blk > 0) & ((F.col("idx") % block_size) < spill)
    ev = F.struct(F.col("idx").cast("long").alias("idx"), "act", "plain", "rich")
    rows = events.select("case_id", ev.alias("ev"), F.explode(
        F.when(spill_into_prev, F.array(blk, blk - 1)).otherwise(F.array(blk))).alias("blk"))
    if tasks is not None:
        rows = rows.repartition(tasks, "case_id", "blk")
    return rows.groupBy("case_id", "blk").agg(F.sort_array(F.collect_list("ev")).alias("arr"))


def earlier_block_text(blocks: DataFrame, block_size: int, rounds: int, sep: str) -> DataFrame:
    """(case_id, blk, cum_plain, cum_key): text of blocks 0..blk-1 of each trace, by a
    parallel prefix scan (Hillis-Steele) over the block table.

    Round r: every row is emitted twice with ``explode`` - as itself and as the
    predecessor of block blk + 2^r - and regrouped by (trace, block): at most two rows per
    group, one exchange per round, each round reading the previous one once (a self-join
    would reference the previous round twice and double the plan every round)."""
    # own events come first in the sorted block array; a block is full unless it is the
    # trace's last one, which has no spill
    n_own = F.least(F.size("arr"), F.lit(block_size))
    cur = blocks.select(
        "case_id", "blk",
        F.array_join(F.slice(F.col("arr.plain"), 1, n_own), ",").alias("p"),
        F.array_join(F.slice(F.col("arr.act"), 1, n_own), sep).alias("d"))
    for r in range(rounds):
        shift = 1 << r
        twice = F.array(F.struct(F.col("blk").alias("k"), F.lit(1).alias("me"), "p", "d"),
                        F.struct((F.col("blk") + shift).alias("k"), F.lit(0).alias("me"), "p", "d"))
        g = (cur.select("case_id", F.explode(twice).alias("x"))
             .groupBy("case_id", F.col("x.k").alias("blk"))
             .agg(F.sort_array(F.collect_list(F.struct("x.me", "x.p", "x.d"))).alias("xs")))
        two = F.size("xs") == 2          # [predecessor, itself]
        cur = g.filter(F.element_at("xs", -1)["me"] == 1).select(
            "case_id", "blk",
            F.when(two, F.concat_ws(",", F.col("xs")[0]["p"], F.col("xs")[1]["p"]))
             .otherwise(F.col("xs")[0]["p"]).alias("p"),
            F.when(two, F.concat_ws(sep, F.col("xs")[0]["d"], F.col("xs")[1]["d"]))
             .otherwise(F.col("xs")[0]["d"]).alias("d"))
    return cur.select("case_id", (F.col("blk") + 1).alias("blk"),
                      F.col("p").alias("cum_plain"), F.col("d").alias("cum_key"))


def anchors_column(blk: Column, n: Column, cfg: PrefixConfig, block_size: int) -> Column:
    """Anchors i (0-based last prefix event) whose value window starts in block ``blk``:
    i in range(base, n-1, gap) and block(max(0, i - M + 1)) == blk, M = max(m, 1)."""
    mm = max(cfg.m, 1)
    lo = F.when(blk == 0, F.lit(0)).otherwise(blk * block_size + mm - 1)
    hi = F.least(blk * block_size + block_size + mm - 2, n - 2)
    lo = F.greatest(lo, F.lit(cfg.base))
    first = F.lit(cfg.base) + F.ceil((lo - cfg.base) / F.lit(cfg.gap)).cast("long") * cfg.gap
    return F.when(first <= hi, F.sequence(first.cast("long"), hi.cast("long"), F.lit(cfg.gap).cast("long"))) \
        .otherwise(F.array().cast("array<bigint>"))


BROADCAST_TRACES = 1_000_000   # trace rows (case, position, count, split) broadcast below this


def trace_blocks(events: DataFrame, traces: DataFrame, cfg: PrefixConfig,
                 max_events: int | None = None, n_traces: int | None = None,
                 earlier_text: bool = True, tasks: int | None = None) -> DataFrame:
    """Event blocks of every trace with more than two events, with the trace's columns: case_id,
    blk, arr, trace_pos, n [, split], linear in the log; and, with ``earlier_text``, the text of
    the trace's earlier blocks (:func:`with_earlier_text`).

    events: rendered, positioned events (case_id, idx, act, plain, rich)
    traces: case_id, trace_pos, n [, split]
    n_traces: exact trace count when known; at most BROADCAST_TRACES rows of the narrow
    trace table are broadcast to the block rows, above that it is a shuffle join (AQE
    splits a skewed, i.e. hot, case on the block side)
    tasks: tasks of the grouping (:func:`~trailcast.operators.ranking.tasks_for`). Above that
    number of traces these then bring a row for each of their blocks, a unique key, into the
    same tasks: the blocks aren't moved again, and the narrow rows are what is hashed
    """
    B, mm = cfg.block_events, max(cfg.m, 1)
    blocks = block_rows(events, B, mm, tasks)
    trace_cols = [c for c in ("trace_pos", "n", "split") if c in traces.columns]
    tr = traces.filter(F.col("n") > 2).select("case_id", *trace_cols)
    small = n_traces is not None and n_traces <= BROADCAST_TRACES
    if small or tasks is None:
        rows = blocks.join(F.broadcast(tr) if small else tr, "case_id")
    else:
        of = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / B).cast("long"))
        per_block = tr.withColumn("blk", F.explode(of)).repartition(tasks, "case_id", "blk")
        rows = blocks.join(per_block.hint("shuffle_hash"), ["case_id", "blk"])
    return with_earlier_text(rows, cfg, max_events) if earlier_text else rows


def with_earlier_text(rows: DataFrame, cfg: PrefixConfig, max_events: int | None = None) -> DataFrame:
    """Blocks with cum_plain and cum_key, the text of the trace's earlier blocks (null in the
    first): one copy per block, so only for what renders text."""
    B = cfg.block_events
    if max_events is None:
        max_events = rows.agg(F.max("n")).first()[0] or 0
    n_blocks = max(1, math.ceil(max_events / B))
    if n_blocks == 1:
        return rows.withColumn("cum_plain", F.lit(None).cast("string")) \
            .withColumn("cum_key", F.lit(None).cast("string"))
    # only traces of several blocks take part in the scan
    several = rows.filter(F.col("n") > B).select("case_id", "blk", "arr")
    cum = earlier_block_text(several, B, math.ceil(math.log2(n_blocks)), cfg.dedup_sep)
    return rows.join(cum, ["case_id", "blk"], "left")


def with_anchors(blocks: DataFrame, cfg: PrefixConfig) -> DataFrame:
    """One row per anchor of a block (column ``anchor``)."""
    return blocks.withColumn("anchor", F.explode(
        anchors_column(F.col("blk"), F.col("n"), cfg, cfg.block_events)))


def anchor_block(anchor: Column, cfg: PrefixConfig) -> Column:
    """The block that holds an anchor's value window from its first event on."""
    return F.floor(F.greatest(F.lit(0), anchor - max(cfg.m, 1) + 1) / F.lit(cfg.block_events)).cast("long")


def _local(cfg: PrefixConfig) -> Column:
    return (F.col("anchor") - F.col("blk") * cfg.block_events).cast("int")


def dedup_text(cfg: PrefixConfig) -> Column:
    """I4: the activities of events 0..anchor, joined with nothing between them."""
    key_local = F.array_join(F.slice(F.col("arr.act"), 1, _local(cfg) + 1), cfg.dedup_sep)
    return F.concat(F.coalesce("cum_key", F.lit("")), key_local) if cfg.dedup_sep == "" \
        else F.concat_ws(cfg.dedup_sep, "cum_key", key_local)


def render_prefixes(rows: DataFrame, cfg: PrefixConfig, extra: list[str] = ()) -> DataFrame:
    """Text, label and length of anchor rows (F3, F4, I2): case_id, trace_pos, ``extra``,
    anchor, prefix, prediction, dedup_key, prefix_len."""
    local = _local(cfg)
    # events 0..local of the block: plain text before the value window, rich text in it
    # (the last m events); slices of field arrays, no per-element lambdas
    if cfg.m == 0:
        text = F.array_join(F.slice(F.col("arr.plain"), 1, local + 1), ",")
    else:
        s0 = F.greatest(F.lit(0), local - cfg.m + 1)
        plain_part = F.when(s0 > 0, F.array_join(F.slice(F.col("arr.plain"), 1, s0), ","))
        rich_part = F.array_join(F.slice(F.col("arr.rich"), s0 + 1, local + 1 - s0), ",")
        text = F.concat_ws(",", plain_part, rich_part)
    return rows.select(
        "case_id", "trace_pos", *extra,
        F.col("anchor").cast("long").alias("anchor"),
        F.concat_ws(",", "cum_plain", text).alias("prefix"),
        F.element_at(F.col("arr.act"), local + 2).alias("prediction"),
        dedup_text(cfg).alias("dedup_key"),
        (F.col("anchor") + 1).cast("long").alias("prefix_len"))


def anchor_steps(rows: DataFrame, cfg: PrefixConfig) -> DataFrame:
    """F3 without text: the activities at and after each anchor."""
    return rows.select(
        "case_id", F.col("anchor").cast("long").alias("anchor"),
        (F.col("anchor") + 1).cast("long").alias("prefix_len"),
        F.element_at(F.col("arr.act"), _local(cfg) + 1).alias("last_activity"),
        F.element_at(F.col("arr.act"), _local(cfg) + 2).alias("prediction"))


def assemble_prefixes(events: DataFrame, traces: DataFrame, cfg: PrefixConfig,
                      max_events: int | None = None, n_traces: int | None = None,
                      tasks: int | None = None) -> DataFrame:
    """Every anchor row of every trace with more than two events, rendered: case_id,
    trace_pos, [split,] anchor, prefix, prediction, dedup_key, prefix_len (arguments as in
    :func:`trace_blocks`)."""
    blocks = trace_blocks(events, traces, cfg, max_events, n_traces, tasks=tasks)
    return render_prefixes(with_anchors(blocks, cfg), cfg, ["split"] if "split" in blocks.columns else [])


def digested(blocks: DataFrame, cfg: PrefixConfig, max_events: int | None = None) -> DataFrame:
    """``blocks`` without their texts, with the digests of their events (``_d``) and of the
    trace's earlier blocks (``before``, null in the first)."""
    B = cfg.block_events
    if max_events is None:
        max_events = blocks.agg(F.max("n")).first()[0] or 0
    rows = with_event_digests(blocks, cfg.dedup_sep).drop("cum_plain", "cum_key")
    if max_events <= B:
        return rows.withColumn("before", F.lit(None).cast(BEFORE)).drop("arr")
    several = with_event_digests(blocks.where(F.col("n") > B), cfg.dedup_sep)
    before = earlier_digests(several, B, math.ceil(math.log2(math.ceil(max_events / B))))
    return rows.drop("arr").join(before, ["case_id", "blk"], "left")


#: an anchor's place in the log as one number: trace position * PLACE + anchor (a long has
#: at most 19 digits). A decimal is a fixed-width state of a hash aggregation.
PLACE = Decimal(10) ** 19


def first_places(blocks: DataFrame, cfg: PrefixConfig, cross_dedup: bool = False,
                 splits: tuple[str, ...] = ("retrieval", "test"), seed: int | None = None,
                 max_events: int | None = None) -> DataFrame:
    """E4 and D3 before any text is rendered: the place (trace_pos, anchor) of the first row
    of each dedup key, per split (column ``split``) when the blocks have one; with
    ``cross_dedup`` a key of the first split gives no row of the second.

    Each anchor's digest comes from running sums over its trace's events
    (:mod:`trailcast.operators.digests`, linear in the log); one hash aggregation over the
    fixed-width (digest, place) rows, combined before the shuffle. With ``seed`` the rows
    carry ``_h``, the key's seeded order (G2), which is an MD5 of the whole text: there the
    text is made for every anchor and hashed (SHA-256)."""
    by_split = "split" in blocks.columns
    place = F.col("trace_pos").cast("decimal(19,0)") * F.lit(PLACE) + F.col("anchor").cast("decimal(19,0)")
    if seed is None:
        rows = with_anchors(digested(blocks, cfg, max_events), cfg)
        keys = {"_k": anchor_digest(_local(cfg))}
    else:
        text = dedup_text(cfg)
        rows = with_anchors(blocks, cfg)
        keys = {"_k": F.unhex(F.sha2(text, 256)), "_h": seeded_order_key(text, seed)}
    rows = rows.select(*[v.alias(k) for k, v in keys.items()], place.alias("_w"), *(["split"] if by_split else []))
    if by_split:
        first, second = splits
        agg = rows.groupBy(*keys).agg(*[F.min(F.when(F.col("split") == s, F.col("_w"))).alias(s) for s in splits])
        kept = F.col(second).isNotNull() & (F.col(first).isNull() if cross_dedup else F.lit(True))
        pick = F.array(F.struct(F.lit(first).alias("split"), F.col(first).alias("_w")),
                       F.struct(F.lit(second).alias("split"), F.when(kept, F.col(second)).alias("_w")))
        won = agg.select(*keys, F.inline(pick)).filter("_w is not null")
    else:
        won = rows.groupBy(*keys).agg(F.min("_w").alias("_w"))
    anchor = F.pmod(F.col("_w"), F.lit(PLACE))
    return won.withColumn("anchor", anchor.cast("long")) \
        .withColumn("trace_pos", ((F.col("_w") - anchor) / F.lit(PLACE)).cast("long")).drop("_w")


def render_places(blocks: DataFrame, places: DataFrame, cfg: PrefixConfig, extra: list[str]) -> DataFrame:
    """Render only the given places (trace_pos, anchor, ``extra``): they meet their block
    as one bounded list per (trace, block)."""
    per_block = places.withColumn("blk", anchor_block(F.col("anchor"), cfg)) \
        .groupBy("trace_pos", "blk").agg(F.collect_list(F.struct("anchor", *extra)).alias("_p"))
    rows = blocks.drop("split").join(per_block, ["trace_pos", "blk"])
    rows = rows.withColumn("_p", F.explode("_p")).select("*", "_p.*").drop("_p")
    return render_prefixes(rows, cfg, extra)


def dedup_first_wins(prefixes: DataFrame, scope: list[str] = ("split",)) -> DataFrame:
    """Keep the first row per dedup key within ``scope`` (earliest trace, then anchor).

    An arg-min aggregation: map-side partial aggregation collapses a hot key to one row
    per input partition before the shuffle."""
    scope = [c for c in scope if c in prefixes.columns]
    payload = [c for c in prefixes.columns if c not in (*scope, "dedup_key", "trace_pos", "anchor")]
    best = F.min(F.struct("trace_pos", "anchor", *payload)).alias("_w")
    return (prefixes.groupBy(*scope, "dedup_key").agg(best)
            .select(*scope, "dedup_key", "_w.*")
            .select(*prefixes.columns))


def cross_split_anti(test: DataFrame, retrieval: DataFrame) -> DataFrame:
    """D3: drop test prefixes whose dedup key already occurs in retrieval."""
    keys = retrieval.select("dedup_key").distinct()
    return test.join(keys, "dedup_key", "left_anti").select(*test.columns)


def trace_text(events: DataFrame, traces: DataFrame, block_size: int = 4096,
               max_events: int | None = None) -> DataFrame:
    """Whole trace as activity text in (ts, event_pos) order, assembled from bounded
    blocks and the distributed prefix scan (no whole-trace collect)."""
    blocks = block_rows(events, block_size, 0)
    if max_events is None:
        max_events = traces.agg(F.max("n")).first()[0] or 0
    n_blocks = max(1, math.ceil(max_events / block_size))
    rounds = math.ceil(math.log2(n_blocks)) if n_blocks > 1 else 0
    last = traces.select("case_id", "trace_pos", "n",
                         F.floor((F.col("n") - 1) / block_size).cast("long").alias("blk"))
    own = F.array_join(F.col("arr.plain"), ",")
    if rounds:
        cum = earlier_block_text(blocks, block_size, rounds, "")
        joined = blocks.join(last, ["case_id", "blk"]).join(cum, ["case_id", "blk"], "left")
        text = F.concat_ws(",", "cum_plain", own)
    else:
        joined = blocks.join(last, ["case_id", "blk"])
        text = own
    return joined.select("case_id", "trace_pos", F.col("n").cast("long").alias("n_events"),
                         text.alias("activities"))
