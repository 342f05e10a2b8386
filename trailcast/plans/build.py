"""L1: event log -> deduplicated (prefix -> next activity) table with a split column.

Shuffles: one hash aggregation by trace (trace table, map-side combined), one ranking
of the narrow trace table (split), one grouping by (trace, block), one aggregation of
(digest, place) rows by dedup digest, one ranking of the narrow winners (row_id), one join
of the winners with their blocks. Prefix text, which grows with the square of a trace, is
rendered after all of them and never shuffled. Nothing is collected except four scalars
(trace count, event count, longest trace, anchors)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailcast.config import PrefixConfig
from trailcast.functions.naming import variant_name_py
from trailcast.operators.clean import drop_null_cases, lifecycle_filter
from trailcast.operators.prefixes import (anchor_steps, assemble_prefixes, event_columns, first_places,
                                          render_events, render_places, trace_blocks, with_anchors,
                                          with_earlier_text)
from trailcast.operators.ranking import row_number_within, tasks_for
from trailcast.operators.split import row_split, temporal_split
from trailcast.operators.traces import event_positions, trace_table
from trailcast.session import materialize

PREFIX_COLUMNS = ["split", "row_id", "case_id", "trace_pos", "anchor", "prefix", "prediction",
                  "dedup_key", "prefix_len"]


@dataclass
class LogStats:
    traces: int
    kept_events: int
    longest: int
    anchors_upper: int


def log_stats(traces: DataFrame, cfg: PrefixConfig) -> LogStats:
    n = F.col("n")
    anchors = F.when(n > 2, F.greatest(F.lit(0), F.ceil((n - 1 - cfg.base) / F.lit(cfg.gap)))) \
        .otherwise(F.lit(0))
    r = traces.agg(F.count(F.lit(1)), F.sum(n), F.max(n), F.sum(anchors)).first()
    return LogStats(int(r[0] or 0), int(r[1] or 0), int(r[2] or 0), int(r[3] or 0))


def positioned_events(log: DataFrame, cfg: PrefixConfig, stats: LogStats | None = None,
                      **rank_opts) -> DataFrame:
    kept = drop_null_cases(lifecycle_filter(log, enabled=cfg.lifecycle_filter))
    pos = event_positions(event_columns(kept, cfg), n_rows=stats.kept_events if stats else None, **rank_opts)
    return render_events(pos, cfg)


def traces_of(log: DataFrame, cfg: PrefixConfig, eventless: DataFrame | None = None) -> DataFrame:
    """The trace table, written once: the stats, the split and the assembly all read it,
    and recomputing it would rescan the whole event log each time. ``eventless`` (first_pos)
    traces only count and take their place in the split: their case stays null."""
    traces = trace_table(log, lifecycle_filter=cfg.lifecycle_filter)
    if eventless is not None:
        fill = {"trace_pos": F.col("first_pos"), "first_pos": F.col("first_pos"), "n_all": F.lit(0), "n": F.lit(0)}
        traces = traces.unionByName(eventless.select(*[
            fill.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in traces.schema.fields]))
    return materialize(traces)


def all_prefixes(log: DataFrame, cfg: PrefixConfig, traces: DataFrame | None = None,
                 stats: LogStats | None = None, **rank_opts) -> DataFrame:
    """Every anchor of every trace (no split, no dedup)."""
    cfg.validate()
    if traces is None:
        traces = traces_of(log, cfg)
    if stats is None:
        stats = log_stats(traces, cfg)
    events = positioned_events(log, cfg, stats, **rank_opts)
    return assemble_prefixes(events, traces, cfg, max_events=stats.longest, n_traces=stats.traces,
                             tasks=tasks_for(log.sparkSession, stats.kept_events, **rank_opts))


def transitions(log: DataFrame, cfg: PrefixConfig, **rank_opts) -> DataFrame:
    """Every anchor's last and next activity, without its prefix text: case_id, anchor,
    prefix_len, last_activity, prediction."""
    cfg.validate()
    traces = traces_of(log, cfg)
    stats = log_stats(traces, cfg)
    cfg = replace(cfg, m=0)
    blocks = trace_blocks(positioned_events(log, cfg, stats, **rank_opts), traces, cfg, max_events=0, n_traces=stats.traces,
                          tasks=tasks_for(log.sparkSession, stats.kept_events, **rank_opts))
    return anchor_steps(with_anchors(blocks, cfg), cfg)


def winners(log: DataFrame, cfg: PrefixConfig = PrefixConfig(), eventless: DataFrame | None = None,
            **rank_opts) -> tuple[DataFrame, DataFrame, LogStats]:
    """(event blocks of all traces, written once; the rows that split and dedup leave: split,
    row_id, trace_pos, anchor; the log's statistics). Linear in the log: no prefix text."""
    cfg.validate()
    traces = traces_of(log, cfg, eventless)
    stats = log_stats(traces, cfg)
    events = positioned_events(log, cfg, stats, **rank_opts)
    by_trace = cfg.split_mode == "trace"
    split = temporal_split(traces, cfg.test_share, cfg.zero_test_means_all,
                           n_traces=stats.traces, **rank_opts) if by_trace else traces
    # read by the dedup (activities only) and by the rendering: written once
    blocks = materialize(trace_blocks(events, split, cfg, stats.longest, stats.traces, earlier_text=False,
                                      tasks=tasks_for(log.sparkSession, stats.kept_events, **rank_opts)))
    if by_trace:
        won = first_places(blocks, cfg, cfg.cross_dedup, max_events=stats.longest)
    else:
        # the seeded order is a hash of the whole text. The test size is int(n * p) of the exact
        # deduplicated row count: write the narrow winners once, then count and rank them
        won = materialize(first_places(with_earlier_text(blocks, cfg, stats.longest), cfg, seed=cfg.row_split_seed))
        won = row_split(won, cfg.test_share, cfg.row_split_seed, key="_k", n_rows=won.count(), **rank_opts)
    won = row_number_within(won.select("split", "trace_pos", "anchor"), ["trace_pos", "anchor"], ["split"],
                            name="row_id", materialize_input=True, n_rows=stats.anchors_upper, **rank_opts)
    return blocks, won.withColumn("row_id", F.col("row_id") - 1), stats


def build_dataset(log: DataFrame, cfg: PrefixConfig = PrefixConfig(), variant: str | None = None,
                  eventless: DataFrame | None = None, **rank_opts) -> DataFrame:
    """Prefix table: split, row_id (0-based position in the split's file order), case_id,
    trace_pos, anchor, prefix, prediction, dedup_key, prefix_len [, variant]. ``eventless``:
    places of the log's traces without events (:func:`~trailcast.sources.eventlog.eventless_traces`)."""
    blocks, won, stats = winners(log, cfg, eventless, **rank_opts)
    out = render_places(with_earlier_text(blocks, cfg, stats.longest), won, cfg, ["split", "row_id"]).select(*PREFIX_COLUMNS)
    if variant is not None:
        out = out.withColumn("variant", F.lit(variant))
    return out


def dataset_variant(stem: str, cfg: PrefixConfig) -> str:
    return variant_name_py(stem, cfg.base, cfg.gap, cfg.m, cfg.split_mode, cfg.cross_dedup)
