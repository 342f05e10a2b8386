"""Queries for text forms, attribute labels and prompts (I5, I6, I9, E9, H4, D4, I12-I17,
K1 activity histogram, D1 over prefixes)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailcast.catalog import sqlx
from trailcast.catalog.prefix_q import _prefix_sql, _split_sql, _dedup_sql, events_log
from trailcast.config import PrefixConfig
from trailcast.functions.text import prefix_length, trim_last_m_values
from trailcast.operators.encoders import activity_histogram_encoder, activity_vocabulary
from trailcast.operators.knn import context_pack, knn_topk
from trailcast.operators.labels import (ATTRIBUTE_LABELS, LEGEND_HEADING, attribute_keys,
                                        attribute_legend, label_table, lookup_labels)
from trailcast.operators.prompts import (HEAD_IDENTITY, HEAD_INSTRUCTIONS, HEAD_PAST, HEAD_PREFIX,
                                         PROMPT_VARIANTS, assemble_prompts, neighbour_block)
from trailcast.plans.build import all_prefixes, build_dataset
from trailcast.session import materialize
from trailcast.sources.eventlog import EVENTS_LIFECYCLE_SPEC, events_with_lifecycle, from_table

M3 = PrefixConfig(base=1, gap=3, m=3)
LC_CFG = PrefixConfig(base=1, gap=3, m=1)
RET_CFG = PrefixConfig(base=1, gap=3, m=0)
K = 3
VARIANT = "b1_g3_events"


def q_prefix_length(spark, d):
    pre = all_prefixes(events_log(spark, d), M3)
    return pre.select("case_id", "anchor", prefix_length(F.col("prefix")).alias("prefix_length"))


def q_trim_last_m_values(spark, d):
    pre = all_prefixes(events_log(spark, d), M3)
    return pre.select("case_id", "anchor", trim_last_m_values(F.col("prefix"), 1).alias("trimmed"))


def _lc_keys(spark, d):
    log = from_table(events_with_lifecycle(spark, d), EVENTS_LIFECYCLE_SPEC)
    return attribute_keys(all_prefixes(log, LC_CFG))


def q_attribute_keys(spark, d):
    return _lc_keys(spark, d)


def q_attribute_label_lookup(spark, d):
    return lookup_labels(_lc_keys(spark, d), label_table(spark))


def q_attribute_legend(spark, d):
    kl = lookup_labels(_lc_keys(spark, d), label_table(spark)).withColumn("variant", F.lit(VARIANT))
    return attribute_legend(kl, ["variant"])


def _retrieval(spark, d):
    log = events_log(spark, d)
    ds = materialize(build_dataset(log, RET_CFG), ["split"])
    enc = activity_histogram_encoder(activity_vocabulary(log))
    test = ds.filter(F.col("split") == "test").select(F.col("row_id").alias("query_id"), "prefix")
    corp = ds.filter(F.col("split") == "retrieval").select(F.col("row_id").alias("point_id"),
                                                            "prefix", "prediction")
    nb = knn_topk(enc(test, "prefix", "embedding"), enc(corp, "prefix", "embedding"), K,
                  "query_id", "point_id", "embedding", distinct=True)
    ctx = context_pack(nb.join(corp.select("point_id", "prefix", "prediction"), "point_id"))
    return test, ctx


def q_histogram_knn(spark, d):
    test, ctx = _retrieval(spark, d)
    item = lambda x: F.concat(x["rank"].cast("string"), F.lit(":"), x["point_id"].cast("string"))
    return ctx.select("query_id", F.array_join(F.transform("context", item), ";").alias("neighbours"))


def q_neighbour_block(spark, d):
    _, ctx = _retrieval(spark, d)
    return ctx.select("query_id", neighbour_block(F.col("context")).alias("block"))


def _prompt_rows(spark, d):
    test, ctx = _retrieval(spark, d)
    return test.join(ctx, "query_id").withColumn("legend", F.lit(""))


def q_prompt_assembly(spark, d):
    return assemble_prompts(_prompt_rows(spark, d), "prompt_1", "local-model").select("query_id", "layout", "prompt")


def q_prompt_messages(spark, d):
    return assemble_prompts(_prompt_rows(spark, d), None, "gpt-4o-mini").select(
        "query_id", "layout", "system_prompt", "user_prompt")


QUERIES = {
    "prefix_length": q_prefix_length,
    "trim_last_m_values": q_trim_last_m_values,
    "attribute_keys": q_attribute_keys,
    "attribute_label_lookup": q_attribute_label_lookup,
    "attribute_legend": q_attribute_legend,
    "histogram_knn": q_histogram_knn,
    "neighbour_block": q_neighbour_block,
    "prompt_assembly": q_prompt_assembly,
    "prompt_messages": q_prompt_messages,
}

# ----------------------------------------------------------------------------- oracles


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_EV_M3 = (f"CASE WHEN e.idx > a.anchor - 3 THEN e.act || ' - Values: ' || "
          f"(CASE WHEN e.idx <= 1 THEN {sqlx.events_map_sql('e', False)} "
          f"ELSE {sqlx.events_map_sql('e', True)} END) ELSE e.act END")
M3_SQL = _prefix_sql(sqlx.EVENTS_POS, 1, 3, _EV_M3)
SPAN = " - Values: \\{(?:[^{}]|\\{(?:[^{}]|\\{[^{}]*\\})*\\})*\\}"

_LC = ("CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 4 = 0 THEN 'start' "
       "WHEN event_id % 4 = 1 THEN ' Complete ' WHEN event_id % 4 = 2 THEN 'completed' "
       "ELSE 'COMPLETE' END")
EVENTS_LC_POS = f"""
SELECT user_id AS case_id, event_id, event_type AS act, ts, value, props, lc,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
       count(*) OVER (PARTITION BY user_id) AS n, min(event_id) OVER (PARTITION BY user_id) AS trace_pos
FROM (SELECT *, {_LC} AS lc FROM events)
WHERE lower(regexp_replace(lc, '^\\s+|\\s+$', '', 'g')) IN ('complete', 'completed')"""
_LC_MAP = ("('{' || '''ev'': ' || " + sqlx.repr_sql("CAST(e.event_id AS VARCHAR)") +
           " || ', ''litr'': ' || " + sqlx.repr_sql("e.lc") + " || '}')")
KEYS_SQL = f"""SELECT DISTINCT unnest(regexp_extract_all(m, '''([^'']*)'': ', 1)) AS key FROM (
    SELECT {_LC_MAP} || {sqlx.events_map_sql('e', True)} AS m
    FROM ({sqlx.anchors_sql('(' + EVENTS_LC_POS + ')', 1, 3)}) a
    JOIN ({EVENTS_LC_POS}) e ON e.case_id = a.case_id AND e.idx = a.anchor)"""
_LABEL_CASE = "CASE key " + " ".join(f"WHEN {lit(a)} THEN {lit(b)}" for a, b in ATTRIBUTE_LABELS) + " ELSE key END"
LABELS_SQL = f"SELECT key, {_LABEL_CASE} AS label FROM ({KEYS_SQL})"

_DS = _dedup_sql(_prefix_sql(sqlx.EVENTS_POS, 1, 3, "e.act"), _split_sql(sqlx.EVENTS_POS), cross=False)
_VOCAB = "(SELECT list(DISTINCT event_type ORDER BY event_type) FROM events WHERE event_type IS NOT NULL)"
_HIST = f"""SELECT *, list_transform(cnt, lambda x: CASE WHEN nrm > 0 THEN x / nrm ELSE 0.0 END) AS u FROM (
    SELECT *, sqrt(list_sum(list_transform(cnt, lambda x: x * x))) AS nrm FROM (
      SELECT *, list_transform({_VOCAB}, lambda v: CAST(len(list_filter(string_split(prefix, ','),
             lambda a: a = v)) AS DOUBLE)) AS cnt FROM ({_DS})))"""
TOP_SQL = f"""WITH h AS ({_HIST}),
pairs AS (SELECT q.row_id AS query_id, c.row_id AS point_id, q.prefix AS qprefix, c.prefix AS cprefix,
                 c.prediction AS cpred, list_dot_product(q.u, c.u) AS sc
          FROM h q JOIN h c ON q.split = 'test' AND c.split = 'retrieval')
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sc, 6) DESC, point_id) AS rank
               FROM pairs) WHERE rank <= {K}"""
_ITEM = ("'<past_trace id=\"trace_' || rank || '\">' || cprefix || '</past_trace>' || chr(10) || "
         "'<next_activity id=\"trace_' || rank || '\">' || cpred || '</next_activity>'")
BLOCK_SQL = f"""SELECT query_id, any_value(qprefix) AS prefix,
    string_agg({_ITEM}, chr(10) ORDER BY rank) AS block FROM ({TOP_SQL}) GROUP BY query_id"""
_P1 = PROMPT_VARIANTS[0]
_PREFIX_BLOCK = f"{lit(HEAD_PREFIX + chr(10) + '<prefix>')} || prefix || {lit('</prefix>' + chr(10) + chr(10))}"

ORACLE = {
    "prefix_length": f"""SELECT case_id, anchor, CAST(len(list_filter(string_split(
        regexp_replace(prefix, '{SPAN}', '', 'g'), ','), lambda x: trim(x) <> '')) AS BIGINT) AS prefix_length
        FROM ({M3_SQL})""",
    "trim_last_m_values": f"""SELECT case_id, anchor, CASE WHEN len(sp) <= 1 THEN prefix ELSE
        array_to_string(list_transform(pc, lambda x, j: x || CASE WHEN j <= len(sp) AND j > len(sp) - 1
          THEN sp[j] ELSE '' END), '') END AS trimmed
        FROM (SELECT *, regexp_extract_all(prefix, '{SPAN}') AS sp,
                     regexp_split_to_array(prefix, '{SPAN}') AS pc FROM ({M3_SQL}))""",
    "attribute_keys": KEYS_SQL,
    "attribute_label_lookup": LABELS_SQL,
    "attribute_legend": f"""SELECT '{VARIANT}' AS variant, {lit(LEGEND_HEADING)} || chr(10) ||
        string_agg('- ' || key || ' = ' || label, chr(10) ORDER BY key) AS legend FROM ({LABELS_SQL})""",
    "histogram_knn": f"""SELECT query_id, string_agg(rank || ':' || point_id, ';' ORDER BY rank) AS neighbours
        FROM ({TOP_SQL}) GROUP BY query_id""",
    "neighbour_block": f"SELECT query_id, block FROM ({BLOCK_SQL})",
    "prompt_assembly": f"""SELECT query_id, 'single' AS layout,
        {lit(HEAD_IDENTITY + chr(10) + _P1[1] + chr(10) + chr(10) + HEAD_INSTRUCTIONS + chr(10) + _P1[2] + chr(10) + chr(10) + HEAD_PAST + chr(10))}
        || block || {lit(chr(10) + chr(10))} || {_PREFIX_BLOCK} AS prompt FROM ({BLOCK_SQL})""",
    "prompt_messages": f"""SELECT query_id, 'chat' AS layout,
        {lit(HEAD_IDENTITY + chr(10) + _P1[1] + chr(10) + chr(10) + HEAD_INSTRUCTIONS + chr(10) + _P1[2])} AS system_prompt,
        {lit(HEAD_PAST + chr(10))} || block || {lit(chr(10) + chr(10))} || {_PREFIX_BLOCK} AS user_prompt
        FROM ({BLOCK_SQL})""",
}
