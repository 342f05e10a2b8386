"""Queries for the prefix core: sources, cleaning, traces, anchors, prefix text, dedup,
splits (A2, C1-C5, E1-E4, F1-F4, G1, G2, D3, I1-I4)."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailcast.catalog import sqlx
from trailcast.config import EventLogSpec, PrefixConfig
from trailcast.functions.text import abbreviate
from trailcast.operators.clean import drop_null_cases, drop_trace_attributes, lifecycle_filter
from trailcast.operators.prefixes import event_columns, render_events, trace_text
from trailcast.operators.split import temporal_split
from trailcast.operators.traces import event_positions, short_trace_filter, trace_table
from trailcast.plans.build import all_prefixes, build_dataset
from trailcast.plans.compact import compact_dataset, read_compact, write_compact
from trailcast.plans.split_xes import split_xes
from trailcast.session import ensure_checkpoint_dir
from trailcast.sources.eventlog import (CASE_PREFIX, CONVERSATIONS_SPEC, EVENTS_LIFECYCLE_SPEC, EVENTS_SPEC,
                                        ORDERS_SPEC, events_with_lifecycle, from_table, read_xes_events)
from trailcast.streaming.live import start_live_prefixes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark, d):
    return from_table(table(spark, d, "events"), EVENTS_SPEC)


def orders_log(spark, d):
    return from_table(table(spark, d, "orders"), ORDERS_SPEC)


# ----------------------------------------------------------------------------- queries

def q_event_log_scan(spark, d):
    log = events_log(spark, d)
    return log.select("case_id", "event_pos", "activity", "ts", F.col("vals_sorted").alias("values_text"))


def q_lifecycle_filter(spark, d):
    log = from_table(events_with_lifecycle(spark, d), EVENTS_LIFECYCLE_SPEC)
    return lifecycle_filter(log).select("case_id", "event_pos", "activity", "lifecycle")


def q_event_projection(spark, d):
    log = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("case:concept:name"), F.col("o_orderstatus").alias("case:status"),
        F.col("o_totalprice").alias("case:price"), "o_orderdate", "o_orderpriority")
    return drop_trace_attributes(log, "case:concept:name")


def _events_positioned(spark, d, cfg):
    log = events_log(spark, d)
    return log, render_events(event_positions(event_columns(drop_null_cases(log), cfg)), cfg)


def q_trace_assembly(spark, d):
    cfg = PrefixConfig(m=0)
    log, ev = _events_positioned(spark, d, cfg)
    return trace_text(ev, trace_table(log))


def q_trace_end_time(spark, d):
    return trace_table(orders_log(spark, d)).select(
        "case_id", "trace_pos", "end_ts", F.col("n_all").alias("n_events"))


def q_event_position(spark, d):
    pos = event_positions(drop_null_cases(orders_log(spark, d)).select("event_pos", "case_id", "ts"))
    return pos.select("event_pos", "case_id", "idx")


def q_short_trace_filter(spark, d):
    return short_trace_filter(trace_table(orders_log(spark, d))).select("case_id", "n")


def q_prefix_anchors(spark, d):
    cfg = PrefixConfig(base=0, gap=2, m=0)
    return all_prefixes(orders_log(spark, d), cfg).select("case_id", "anchor")


def q_next_activity(spark, d):
    cfg = PrefixConfig(base=1, gap=1, m=0)
    return all_prefixes(orders_log(spark, d), cfg).select("case_id", "anchor", "prediction")


def q_prefix_activities(spark, d):
    cfg = PrefixConfig(base=1, gap=3, m=0)
    return all_prefixes(events_log(spark, d), cfg).select(
        "case_id", "anchor", "prefix", "dedup_key", "prediction", "prefix_len")


def q_prefix_last_m_values(spark, d):
    cfg = PrefixConfig(base=1, gap=3, m=3, key_order="reference")
    return all_prefixes(events_log(spark, d), cfg).select("case_id", "anchor", "prefix", "prediction")


COMPOSITE_SPEC = EventLogSpec(case_col="o_custkey", activity_col="o_orderpriority",
                              ts_col="o_orderdate", pos_col="o_orderkey",
                              activity_cols=("o_orderstatus",))


def q_composite_activity(spark, d):
    cfg = PrefixConfig(base=1, gap=3, m=0)
    log = from_table(table(spark, d, "orders"), COMPOSITE_SPEC)
    return all_prefixes(log, cfg).select("case_id", "anchor", "prefix", "prediction", "dedup_key")


def q_prefix_dedup(spark, d):
    cfg = PrefixConfig(base=1, gap=3, m=1)
    return build_dataset(events_log(spark, d), cfg).select(
        "split", "row_id", "case_id", "anchor", "prefix", "prediction", "prefix_len")


def q_prefix_compact_view(spark, d):
    """The prefix table rendered from its compact form: blocks of 8 events and narrow rows,
    written and read back."""
    cfg = PrefixConfig(base=1, gap=3, m=1, block_size=8)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/trailcast-compact/{uuid.uuid4().hex}"
    write_compact(compact_dataset(events_log(spark, d), cfg), path)
    return read_compact(spark, path).view().select(
        "split", "row_id", "case_id", "anchor", "prefix", "prediction", "prefix_len")


def q_live_prefixes(spark, d):
    """The events table replayed as a stream in two arrivals, cut at the middle of its time
    span, and an event long after them that lets the watermark pass the last ones."""
    events = table(spark, d, "events")
    schema = events.schema
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/trailcast-live/{uuid.uuid4().hex}"
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    middle = low + (high - low) / 2
    closing = spark.range(1).select(*[(F.lit(-1).cast(f.dataType) if f.name in ("user_id", "event_id") else
                                       F.lit(high + timedelta(days=365)).cast(f.dataType) if f.name == "ts" else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])
    for part in (events.where(F.col("ts") < F.lit(middle)), events.where(F.col("ts") >= F.lit(middle)), closing):
        part.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(schema).parquet(f"{root}/in")
        start_live_prefixes(from_table(stream, EVENTS_SPEC), f"{root}/out", f"{root}/mark", PrefixConfig(base=1, gap=3, m=3), available_now=True).awaitTermination()
    return spark.read.parquet(f"{root}/out").select("case_id", "anchor", "prefix", "prediction")


def q_cross_split_anti(spark, d):
    cfg = PrefixConfig(base=1, gap=3, m=0, cross_dedup=True)
    return build_dataset(orders_log(spark, d), cfg).select(
        "split", "row_id", "case_id", "anchor", "prefix", "prediction")


def q_temporal_split(spark, d):
    tr = trace_table(orders_log(spark, d))
    return temporal_split(tr, 0.3).select("case_id", "split", "split_rank")


def _write_events_xes(spark, d, path):
    """The events table as an XES log: a trace per user, a list attribute per event."""
    pair = lambda key, value: F.struct(F.lit(key).alias("_key"), value.cast("string").alias("_value"))
    tags = F.struct(F.lit("tags").alias("_key"), F.struct(F.array(
        pair("id", F.col("event_id")), pair("props", F.col("props"))).alias("string")).alias("values"))
    time = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    event = F.struct("event_id", F.array(pair("concept:name", F.col("event_type"))).alias("string"),
                     F.array(pair("time:timestamp", time)).alias("date"), F.array(tags).alias("list"))
    traces = table(spark, d, "events").where("user_id IS NOT NULL").groupBy("user_id").agg(
        F.array_sort(F.collect_list(event)).alias("event"), F.min("event_id").alias("first")).orderBy("first")
    traces.select(F.array(pair("concept:name", F.col("user_id"))).alias("string"), F.transform(
        "event", lambda e: e.dropFields("event_id")).alias("event")).write.format("xml").option("rootTag", "log") \
        .option("rowTag", "trace").option("attributePrefix", "_").save(path)


def q_xes_split(spark, d):
    """B3 + A1: a log in XES split by end times into two logs; both read back event by event,
    with the nested attribute as JSON text."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/trailcast-xes/{uuid.uuid4().hex}"
    _write_events_xes(spark, d, f"{root}/log")
    split_xes(spark, f"{root}/log", f"{root}/out", 0.3)
    a = F.col("attributes")
    sides = [read_xes_events(spark, f"{root}/out/split={s}").select(
        F.lit(s).alias("split"), a[CASE_PREFIX + "concept:name"].cast("long").alias("case_id"),
        F.col("event_in_trace").cast("long").alias("event_in_trace"), a["concept:name"].alias("activity"),
        a["tags"].alias("tags")) for s in ("retrieval", "test")]
    return sides[0].unionByName(sides[1])


def q_row_split(spark, d):
    cfg = PrefixConfig(base=1, gap=3, m=0, split_mode="row")
    return build_dataset(events_log(spark, d), cfg).select(
        "split", "row_id", "dedup_key", "prefix", "prediction")


def q_lifecycle_dedup(spark, d):
    """Dedup order follows the kept events, the temporal split all of them."""
    log = from_table(events_with_lifecycle(spark, d), EVENTS_LIFECYCLE_SPEC)
    return build_dataset(log, PrefixConfig(base=0, gap=1, m=0, cross_dedup=True)).select(
        "split", "row_id", "case_id", "anchor", "prefix", "prediction", "prefix_len")


# The same results through the distributed paths a large log takes: range-bucketed
# ranking (every count treated as large) and 8-event blocks joined by a multi-round
# prefix scan. Checked against the same oracle SQL as the default plans.
SCALE_PATH = dict(small_rows=0, rows_per_bucket=5000)


def q_prefix_dedup_scale_path(spark, d):
    cfg = PrefixConfig(base=1, gap=3, m=1, block_size=8)
    return build_dataset(events_log(spark, d), cfg, **SCALE_PATH).select(
        "split", "row_id", "case_id", "anchor", "prefix", "prediction", "prefix_len")


def q_trace_assembly_scale_path(spark, d):
    log = events_log(spark, d)
    cfg = PrefixConfig(m=0)
    ev = render_events(event_positions(event_columns(drop_null_cases(log), cfg), **SCALE_PATH), cfg)
    return trace_text(ev, trace_table(log), block_size=8)


def q_conversation_prefixes(spark, d):
    """Conversations as a log: no timestamps, turn order only; the turn number is the
    one attribute value."""
    log = from_table(table(spark, d, "conversations"), CONVERSATIONS_SPEC)
    return all_prefixes(log, PrefixConfig(base=0, gap=1, m=1)).select(
        "case_id", "anchor", "prefix", "prediction", "dedup_key")


def q_attribute_abbrev(spark, d):
    part = table(spark, d, "part")
    return part.select("p_partkey", abbreviate(F.col("p_type")).alias("abbr_type"),
                       abbreviate(F.col("p_name")).alias("abbr_name"))


QUERIES = {
    "event_log_scan": q_event_log_scan,
    "lifecycle_filter": q_lifecycle_filter,
    "event_projection": q_event_projection,
    "trace_assembly": q_trace_assembly,
    "trace_end_time": q_trace_end_time,
    "event_position": q_event_position,
    "short_trace_filter": q_short_trace_filter,
    "prefix_anchors": q_prefix_anchors,
    "next_activity": q_next_activity,
    "prefix_activities": q_prefix_activities,
    "prefix_last_m_values": q_prefix_last_m_values,
    "composite_activity": q_composite_activity,
    "prefix_dedup": q_prefix_dedup,
    "prefix_compact_view": q_prefix_compact_view,
    "live_prefixes": q_live_prefixes,
    "cross_split_anti": q_cross_split_anti,
    "temporal_split": q_temporal_split,
    "xes_split": q_xes_split,
    "row_split": q_row_split,
    "lifecycle_dedup": q_lifecycle_dedup,
    "attribute_abbrev": q_attribute_abbrev,
    "prefix_dedup_scale_path": q_prefix_dedup_scale_path,
    "trace_assembly_scale_path": q_trace_assembly_scale_path,
    "conversation_prefixes": q_conversation_prefixes,
}

# ----------------------------------------------------------------------------- oracles

_LC = ("CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 4 = 0 THEN 'start' "
       "WHEN event_id % 4 = 1 THEN ' Complete ' WHEN event_id % 4 = 2 THEN 'completed' "
       "ELSE 'COMPLETE' END")


def _prefix_sql(pos: str, base: int, gap: int, item: str, extra_cols: str = "") -> str:
    """All anchors with their prefix text / dedup key / label, by brute force."""
    return f"""
WITH p AS ({pos}),
a AS ({sqlx.anchors_sql('p', base, gap)})
SELECT a.case_id, a.trace_pos, a.anchor,
       string_agg({item}, ',' ORDER BY e.idx) AS prefix,
       string_agg(e.act, '' ORDER BY e.idx) AS dedup_key,
       any_value(nx.act) AS prediction, a.anchor + 1 AS prefix_len {extra_cols}
FROM a JOIN p e ON e.case_id = a.case_id AND e.idx <= a.anchor
JOIN p nx ON nx.case_id = a.case_id AND nx.idx = a.anchor + 1
GROUP BY a.case_id, a.trace_pos, a.anchor"""


def _split_sql(pos: str, share: float = 0.3) -> str:
    return f"""
SELECT case_id, trace_pos,
  CASE WHEN row_number() OVER (ORDER BY coalesce(epoch_us(end_ts), -9223372036854775808), trace_pos)
       > count(*) OVER () - CAST(floor(CAST(count(*) OVER () AS DOUBLE) * CAST({share} AS DOUBLE)) AS BIGINT)
  THEN 'test' ELSE 'retrieval' END AS split,
  row_number() OVER (ORDER BY coalesce(epoch_us(end_ts), -9223372036854775808), trace_pos) AS split_rank
FROM (SELECT DISTINCT case_id, trace_pos, end_ts FROM ({pos}))"""


def _dedup_sql(prefix_sql: str, split_sql: str, cross: bool) -> str:
    cross_filter = ("AND NOT (s.split = 'test' AND s.dedup_key IN "
                    "(SELECT dedup_key FROM w WHERE split = 'retrieval'))") if cross else ""
    return f"""
WITH pr AS ({prefix_sql}), sp AS ({split_sql}),
s AS (SELECT pr.*, sp.split,
        row_number() OVER (PARTITION BY sp.split, pr.dedup_key ORDER BY pr.trace_pos, pr.anchor) AS k
      FROM pr JOIN sp USING (case_id)),
w AS (SELECT * FROM s WHERE k = 1)
SELECT s.split, row_number() OVER (PARTITION BY s.split ORDER BY s.trace_pos, s.anchor) - 1 AS row_id,
       s.case_id, s.anchor, s.prefix, s.prediction, s.prefix_len
FROM w s WHERE TRUE {cross_filter}"""


CONV_POS = """
SELECT conv_id AS case_id, turn, coalesce(role, 'nan') AS act,
       row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx,
       count(*) OVER (PARTITION BY conv_id) AS n, min(turn) OVER (PARTITION BY conv_id) AS trace_pos
FROM conversations WHERE conv_id IS NOT NULL"""

EV_MAP_SORTED = sqlx.events_map_sql("e", sort=True)
EV_MAP_COLS = sqlx.events_map_sql("e", sort=False)

ORACLE = {
    "event_log_scan": f"""SELECT user_id AS case_id, event_id AS event_pos, event_type AS activity, ts,
        {sqlx.events_map_sql('', sort=True)} AS values_text FROM events""",
    "lifecycle_filter": f"""SELECT user_id AS case_id, event_id AS event_pos, event_type AS activity,
        lc AS lifecycle FROM (SELECT *, {_LC} AS lc FROM events)
        WHERE lower(regexp_replace(lc, '^\\s+|\\s+$', '', 'g')) IN ('complete', 'completed')""",
    "event_projection": """SELECT o_orderkey, o_custkey AS "case:concept:name", o_orderdate, o_orderpriority
        FROM orders""",
    "trace_assembly": """SELECT user_id AS case_id, min(event_id) AS trace_pos, count(*) AS n_events,
        string_agg(event_type, ',' ORDER BY ts, event_id) AS activities FROM events
        WHERE user_id IS NOT NULL GROUP BY user_id""",
    "trace_end_time": """SELECT o_custkey AS case_id, min(o_orderkey) AS trace_pos,
        max(o_orderdate) AS end_ts, count(*) AS n_events FROM orders
        WHERE o_custkey IS NOT NULL GROUP BY o_custkey""",
    "event_position": f"""SELECT event_id AS event_pos, case_id, idx FROM ({sqlx.ORDERS_POS})""",
    "short_trace_filter": """SELECT o_custkey AS case_id, count(*) AS n FROM orders
        WHERE o_custkey IS NOT NULL GROUP BY o_custkey HAVING count(*) > 2""",
    "prefix_anchors": f"""SELECT case_id, anchor FROM ({sqlx.anchors_sql('(' + sqlx.ORDERS_POS + ')', 0, 2)})""",
    "next_activity": f"""SELECT case_id, anchor, prediction FROM ({_prefix_sql(sqlx.ORDERS_POS, 1, 1, 'e.act')})""",
    "prefix_activities": f"""SELECT case_id, anchor, prefix, dedup_key, prediction, prefix_len
        FROM ({_prefix_sql(sqlx.EVENTS_POS, 1, 3, 'e.act')})""",
    "prefix_last_m_values": f"""SELECT case_id, anchor, prefix, prediction FROM ({_prefix_sql(
        sqlx.EVENTS_POS, 1, 3,
        f"CASE WHEN e.idx > a.anchor - 3 THEN e.act || ' - Values: ' || "
        f"(CASE WHEN e.idx <= 1 THEN {EV_MAP_COLS} ELSE {EV_MAP_SORTED} END) ELSE e.act END")})""",
    "composite_activity": f"""SELECT case_id, anchor, prefix, prediction, dedup_key FROM ({_prefix_sql(
        sqlx.ORDERS_POS.replace('o_orderpriority AS act', "o_orderpriority || '+' || coalesce(o_orderstatus, 'nan') AS act"),
        1, 3, 'e.act')})""",
    "prefix_dedup": _dedup_sql(
        _prefix_sql(sqlx.EVENTS_POS, 1, 3,
                    f"CASE WHEN e.idx > a.anchor - 1 THEN e.act || ' - Values: ' || "
                    f"(CASE WHEN e.idx <= 1 THEN {EV_MAP_COLS} ELSE {EV_MAP_SORTED} END) ELSE e.act END"),
        _split_sql(sqlx.EVENTS_POS), cross=False),
    "cross_split_anti": f"""SELECT split, row_id, case_id, anchor, prefix, prediction FROM (
        {_dedup_sql(_prefix_sql(sqlx.ORDERS_POS, 1, 3, 'e.act'), _split_sql(sqlx.ORDERS_POS), cross=True)})""",
    "temporal_split": f"""SELECT case_id, split, split_rank FROM ({_split_sql(sqlx.ORDERS_POS)})""",
    "xes_split": """
WITH t AS (SELECT user_id, max(ts) AS end_ts, min(event_id) AS first FROM events WHERE user_id IS NOT NULL GROUP BY user_id),
s AS (SELECT user_id, CASE WHEN row_number() OVER (ORDER BY end_ts ASC NULLS FIRST, first) > count(*) OVER ()
  - CAST(floor(CAST(count(*) OVER () AS DOUBLE) * CAST(0.3 AS DOUBLE)) AS BIGINT) THEN 'test' ELSE 'retrieval' END AS split FROM t)
SELECT s.split, CAST(e.user_id AS BIGINT) AS case_id,
  row_number() OVER (PARTITION BY e.user_id ORDER BY e.event_id) - 1 AS event_in_trace, e.event_type AS activity,
  '[{"key": "id", "value": "' || e.event_id || '"}, {"key": "props", "value": '
  || coalesce(CAST(to_json(e.props) AS VARCHAR), 'null') || '}]' AS tags
FROM events e JOIN s USING (user_id)""",
    "row_split": f"""
WITH pr AS ({_prefix_sql(sqlx.EVENTS_POS, 1, 3, 'e.act')}),
w AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY trace_pos, anchor) = 1),
r AS (SELECT *, row_number() OVER (ORDER BY md5(dedup_key || '|42'), dedup_key) AS h,
             count(*) OVER () AS n FROM w),
s AS (SELECT *, CASE WHEN h <= CAST(floor(CAST(n AS DOUBLE) * CAST(0.3 AS DOUBLE)) AS BIGINT)
                THEN 'test' ELSE 'retrieval' END AS split FROM r)
SELECT split, row_number() OVER (PARTITION BY split ORDER BY trace_pos, anchor) - 1 AS row_id,
       dedup_key, prefix, prediction FROM s""",
    "conversation_prefixes": f"""SELECT case_id, anchor, prefix, prediction, dedup_key FROM ({_prefix_sql(
        CONV_POS, 0, 1, "CASE WHEN e.idx > a.anchor - 1 THEN e.act || ' - Values: {''tu'': ' || "
        + sqlx.repr_sql("CAST(e.turn AS VARCHAR)") + " || '}' ELSE e.act END")})""",
    "attribute_abbrev": f"""SELECT p_partkey, {sqlx.abbrev_sql('p_type')} AS abbr_type,
        {sqlx.abbrev_sql('p_name')} AS abbr_name FROM part""",
}
_KEPT = f"lower(regexp_replace({_LC}, '^\\s+|\\s+$', '', 'g')) IN ('complete', 'completed')"
_LC_POS = sqlx.EVENTS_POS.replace("FROM events", f"FROM events WHERE {_KEPT}")
ORACLE["lifecycle_dedup"] = _dedup_sql(_prefix_sql(_LC_POS, 0, 1, "e.act"), _split_sql(sqlx.EVENTS_POS), cross=True)
ORACLE["prefix_dedup_scale_path"] = ORACLE["prefix_dedup"]
ORACLE["prefix_compact_view"] = ORACLE["prefix_dedup"]
ORACLE["live_prefixes"] = ORACLE["prefix_last_m_values"]
ORACLE["trace_assembly_scale_path"] = ORACLE["trace_assembly"]
