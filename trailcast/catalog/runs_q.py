"""Queries for naming, configuration keys, run history and reports (B8, B9, B10, D5,
E10, E11, E12, H2, I18-I20).

Run and report records are derived from ``orders``: every order is one evaluation
report of a run (timestamp = order date, label = order key), its setup (dataset variant,
model, top_k, reranker, ...) is read off the order's columns, so the history grows with
the table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trailcast.catalog import sqlx
from trailcast.catalog.prefix_q import _dedup_sql, _prefix_sql, _split_sql, events_log, orders_log, table
from trailcast.config import PrefixConfig
from trailcast.functions.naming import collection_name, eval_config, eval_config_key, parse_variant, variant_name
from trailcast.functions.text import bytes_to_mb, format_duration
from trailcast.operators.runs import (execution_report, group_history, history_entries, latest_per_key,
                                      run_grid, table_equality)
from trailcast.plans.build import build_dataset
from trailcast.session import ensure_checkpoint_dir
from trailcast.sinks.run_history import RunHistory

MODELS = ["hashing", "hashing_bigram"]


def _setups(spark, d):
    o = table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    stem = F.concat(F.regexp_replace(F.lower("o_orderpriority"), "[^a-z0-9]+", "_"),
                    F.when(k % 3 == 0, F.lit("_train")).when(k % 3 == 1, F.lit("_test")).otherwise(F.lit("")))
    return o.select(
        "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority", stem.alias("stem"),
        (k % 3).alias("base"), (1 + c % 3).alias("gap"), (1 + F.floor(k / 7) % 3).alias("m"),
        F.when(F.col("o_orderstatus") == "F", F.lit("row")).otherwise(F.lit("trace")).alias("split_mode"),
        (F.col("o_orderstatus") == "P").alias("cross_dedup"))


def _variants(spark, d):
    s = _setups(spark, d)
    return s.withColumn("variant", variant_name(F.col("stem"), F.col("base"), F.col("gap"), F.col("m"),
                                                F.col("split_mode"), F.col("cross_dedup")))


def q_variant_name(spark, d):
    v = _variants(spark, d)
    return v.select("o_orderkey", "variant",
                    collection_name(F.lit("hashing"), F.col("variant")).alias("collection"))


def _names(spark, d):
    v = _variants(spark, d)
    return v.withColumn("name", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderpriority"))
                        .otherwise(F.col("variant")))


def q_parse_variant(spark, d):
    n = _names(spark, d)
    p = parse_variant(F.col("name"))
    from trailcast.functions.naming import split_type
    return n.select("o_orderkey", "name", p["base"].alias("base"), p["gap"].alias("gap"),
                    p["m"].alias("m"), split_type(F.col("name")).alias("split_type"))


def _reports(spark, d):
    """Report rows with run-level and report-level settings."""
    o = table(spark, d, "orders")
    k, st = F.col("o_orderkey"), F.col("o_orderstatus")
    dataset = variant_name(F.regexp_replace(F.lower("o_orderpriority"), "[^a-z0-9]+", "_"),
                           F.lit(1), F.lit(3), 1 + k % 2, F.lit("trace"), F.lit(False))
    return o.select(
        "o_orderkey", F.col("o_orderdate").alias("timestamp"),
        F.concat(F.lit("run_"), k.cast("string")).alias("run_label"),
        F.when(st == "F", F.lit(3)).cast("long").alias("run_top_k"),
        F.when(st == "O", F.lit(100)).cast("long").alias("max_rows"),
        F.lit(None).cast("string").alias("run_reranker_model"),
        F.when(st == "P", F.lit(10)).cast("long").alias("run_rerank_pool_k"),
        dataset.alias("dataset"),
        F.when(k % 2 == 0, F.lit("hashing")).otherwise(F.lit("hashing_bigram")).alias("model_id"),
        F.lit("vote").alias("llm"), F.lit(None).cast("string").alias("prompt_variant"),
        F.lit(5).cast("long").alias("top_k"),
        F.when(st == "P", F.lit("suffix_overlap")).alias("reranker_model"),
        F.lit(None).cast("long").alias("rerank_pool_k"),
        (F.col("o_totalprice") / 1e6).alias("accuracy"))


def q_eval_config_key(spark, d):
    n = _names(spark, d)
    k, st = F.col("o_orderkey"), F.col("o_orderstatus")
    cfg = eval_config(F.col("name"), F.when(k % 2 == 0, F.lit("hashing")), F.lit("vote"),
                      F.when(k % 4 != 0, F.concat(F.lit("prompt_"), (1 + k % 3).cast("string"))),
                      1 + k % 5, F.when(st == "O", F.lit(100)),
                      F.when(st == "P", F.lit("suffix_overlap")), F.when(st == "P", F.lit(10)))
    return n.select("o_orderkey", eval_config_key(cfg).alias("config_key"), cfg["split_type"].alias("split_type"))


def q_run_history_grouped(spark, d):
    return group_history(history_entries(_reports(spark, d)))


def q_run_history_entries(spark, d):
    """Entries per configuration, in order, after two merges of runs."""
    runs = history_entries(_reports(spark, d)).select("config_key", "config", "timestamp", "run_label")
    history = RunHistory(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/trailcast-history/{uuid.uuid4().hex}")
    odd = F.length("run_label") % 2 == 1
    history.merge(runs.where(odd), ["timestamp", "run_label"])
    history.merge(runs.where(~odd), ["timestamp", "run_label"])
    return history.entries().select("config_key", "position", "timestamp", "run_label")


def q_latest_report_per_variant(spark, d):
    s = _setups(spark, d)
    key = F.concat(F.when(F.col("m") > 1, F.concat(F.lit("last_"), F.col("m").cast("string"), F.lit("_")))
                   .otherwise(F.lit("")), F.lit("b"), F.col("base").cast("string"), F.lit("_g"),
                   F.col("gap").cast("string"))
    reports = s.select(key.alias("variant_key"), F.col("o_orderdate").alias("timestamp"), "o_orderkey",
                       F.concat(F.lit("run_"), F.col("o_orderkey").cast("string")).alias("run_label"))
    return latest_per_key(reports, "variant_key", ["timestamp", "o_orderkey"]) \
        .select("variant_key", "timestamp", "run_label")


def q_run_grid(spark, d):
    return run_grid(_variants(spark, d).select(F.col("variant").alias("dataset")), MODELS)


def q_table_equality(spark, d):
    o = table(spark, d, "orders")
    li = table(spark, d, "lineitem")
    a = o.select("o_orderkey", "o_custkey")
    b = li.join(o, li.l_orderkey == o.o_orderkey).select("o_orderkey", "o_custkey").distinct()
    c = table(spark, d, "customer")
    c1 = c.select("c_custkey", "c_nationkey")
    c2 = c.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_regionkey")
    return table_equality(a, b).withColumn("pair", F.lit("orders_vs_lineitem_orders")).unionByName(
        table_equality(c1, c2).withColumn("pair", F.lit("nation_vs_region_of_customers")))


def q_format_duration(spark, d):
    e = table(spark, d, "events")
    span = e.groupBy("user_id").agg(
        ((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6)
        .alias("seconds"))
    return span.select("user_id", "seconds", format_duration(F.col("seconds")).alias("duration"))


def q_bytes_to_mb(spark, d):
    docs = table(spark, d, "documents")
    per = docs.groupBy("source").agg(F.sum(F.octet_length("text")).alias("bytes"))
    return per.select("source", "bytes", bytes_to_mb(F.col("bytes")).alias("size_mb"))


def q_execution_report(spark, d):
    cfg = PrefixConfig()
    jobs = {"events": lambda: build_dataset(events_log(spark, d), cfg),
            "orders": lambda: build_dataset(orders_log(spark, d), cfg)}
    return execution_report(spark, jobs).select("dataset", "output_rows", "error")


QUERIES = {
    "variant_name": q_variant_name,
    "parse_variant": q_parse_variant,
    "eval_config_key": q_eval_config_key,
    "run_history_grouped": q_run_history_grouped,
    "run_history_entries": q_run_history_entries,
    "latest_report_per_variant": q_latest_report_per_variant,
    "run_grid": q_run_grid,
    "table_equality": q_table_equality,
    "format_duration": q_format_duration,
    "bytes_to_mb": q_bytes_to_mb,
    "execution_report": q_execution_report,
}

# ----------------------------------------------------------------------------- oracles

_SETUPS = """SELECT o_orderkey, o_orderdate, o_orderstatus, o_orderpriority,
    regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g') ||
      CASE o_orderkey % 3 WHEN 0 THEN '_train' WHEN 1 THEN '_test' ELSE '' END AS stem,
    o_orderkey % 3 AS base, 1 + o_custkey % 3 AS gap, 1 + (o_orderkey // 7) % 3 AS m,
    CASE WHEN o_orderstatus = 'F' THEN 'row' ELSE 'trace' END AS split_mode,
    (o_orderstatus = 'P') AS cross_dedup FROM orders"""


def _variant_sql(stem, base, gap, m, split_mode, cross):
    core = (f"(CASE WHEN {m} > 1 THEN 'last_' || {m} || '_' ELSE '' END || 'b' || {base} || '_g' || {gap} "
            f"|| '_' || regexp_replace(regexp_replace({stem}, '_train$', ''), '_test$', ''))")
    return (f"(CASE WHEN {split_mode} = 'row' THEN {core} || '_row' WHEN {cross} THEN {core} || '_trace_dedup' "
            f"ELSE {core} END)")


_VARIANTS = f"SELECT *, {_variant_sql('stem', 'base', 'gap', 'm', 'split_mode', 'cross_dedup')} AS variant FROM ({_SETUPS})"
_NAMES = f"SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority ELSE variant END AS name FROM ({_VARIANTS})"
_PAT = "^(?:last_(\\d+)_)?b(\\d+)_g(\\d+)_(.+)$"


def _parse(name):
    ok = f"regexp_matches({name}, '{_PAT}')"
    return (f"CASE WHEN {ok} THEN CAST(regexp_extract({name}, '{_PAT}', 2) AS BIGINT) END",
            f"CASE WHEN {ok} THEN CAST(regexp_extract({name}, '{_PAT}', 3) AS BIGINT) END",
            f"CASE WHEN {ok} THEN CAST(coalesce(nullif(regexp_extract({name}, '{_PAT}', 1), ''), '1') AS BIGINT) END")


def _split_type(name):
    return f"CASE WHEN coalesce(ends_with({name}, '_row'), false) THEN 'row_level' ELSE 'trace_level' END"


def _key_sql(dataset, model, llm, pv, top_k, max_rows, rr, pool):
    b, g, m = _parse(dataset)
    parts = [("dataset", dataset), ("base", b), ("gap", g), ("m", m), ("top_k", top_k), ("max_rows", max_rows),
             ("model_id", model), ("llm", llm), ("prompt_variant", pv), ("reranker_model", rr),
             ("rerank_pool_k", pool)]
    return " || '|' || ".join(f"'{n}=' || coalesce(CAST(({v}) AS VARCHAR), 'None')" for n, v in parts)


_REPORTS = """SELECT o_orderkey, o_orderdate AS timestamp, 'run_' || o_orderkey AS run_label,
    CASE WHEN o_orderstatus = 'F' THEN 3 END AS run_top_k, CASE WHEN o_orderstatus = 'O' THEN 100 END AS max_rows,
    CASE WHEN o_orderstatus = 'P' THEN 10 END AS run_rerank_pool_k,
    'b1_g3_' || regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g') AS d1,
    CASE WHEN o_orderkey % 2 = 0 THEN 'hashing' ELSE 'hashing_bigram' END AS model_id,
    CASE WHEN o_orderstatus = 'P' THEN 'suffix_overlap' END AS reranker_model,
    1 + o_orderkey % 2 AS mm FROM orders"""
_HIST = f"""SELECT *, {_key_sql('dataset', 'model_id', "'vote'", 'NULL', 'coalesce(run_top_k, 5)', 'max_rows',
                                 'reranker_model', 'run_rerank_pool_k')} AS config_key
    FROM (SELECT *, CASE WHEN mm > 1 THEN 'last_' || mm || '_' ELSE '' END || d1 AS dataset FROM ({_REPORTS}))"""

ORACLE = {
    "variant_name": f"SELECT o_orderkey, variant, 'hashing_' || variant AS collection FROM ({_VARIANTS})",
    "parse_variant": "SELECT o_orderkey, name, {0} AS base, {1} AS gap, {2} AS m, {3} AS split_type FROM ({4})".format(
        *_parse("name"), _split_type("name"), _NAMES),
    "eval_config_key": f"""SELECT o_orderkey, {_key_sql('name', "CASE WHEN o_orderkey % 2 = 0 THEN 'hashing' END",
        "'vote'", "CASE WHEN o_orderkey % 4 <> 0 THEN 'prompt_' || (1 + o_orderkey % 3) END", '1 + o_orderkey % 5',
        "CASE WHEN o_orderstatus = 'O' THEN 100 END", "CASE WHEN o_orderstatus = 'P' THEN 'suffix_overlap' END",
        "CASE WHEN o_orderstatus = 'P' THEN 10 END")} AS config_key, {_split_type('name')} AS split_type
        FROM ({_NAMES})""",
    "run_history_grouped": f"""SELECT config_key, count(*) AS n_runs, min(timestamp) AS first_timestamp,
        max(timestamp) AS last_timestamp,
        (array_agg(run_label ORDER BY timestamp DESC, run_label DESC))[1] AS last_run_label,
        any_value({_split_type('dataset')}) AS split_type FROM ({_HIST}) GROUP BY config_key""",
    "run_history_entries": f"""SELECT config_key, row_number() OVER (PARTITION BY config_key ORDER BY length(run_label) % 2 DESC, timestamp, run_label) AS position,
        timestamp, run_label FROM ({_HIST})""",
    "latest_report_per_variant": f"""SELECT variant_key, timestamp, run_label FROM (
        SELECT CASE WHEN m > 1 THEN 'last_' || m || '_' ELSE '' END || 'b' || base || '_g' || gap AS variant_key,
               o_orderdate AS timestamp, o_orderkey, 'run_' || o_orderkey AS run_label FROM ({_SETUPS}))
        QUALIFY row_number() OVER (PARTITION BY variant_key ORDER BY timestamp DESC, o_orderkey DESC) = 1""",
    "run_grid": f"""WITH r AS (SELECT dataset, row_number() OVER (ORDER BY dataset) AS dr
                   FROM (SELECT DISTINCT variant AS dataset FROM ({_VARIANTS})))
        SELECT (dr - 1) * 2 + mi AS grid_pos, dataset, model_id
        FROM r, (VALUES (0, 'hashing'), (1, 'hashing_bigram')) m(mi, model_id)""",
    "table_equality": """WITH a AS (SELECT o_orderkey, o_custkey FROM orders),
        b AS (SELECT DISTINCT o.o_orderkey, o.o_custkey FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
        r AS (SELECT c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
        SELECT 'orders_vs_lineitem_orders' AS pair,
          (SELECT count(*) FROM (SELECT o_orderkey FROM a EXCEPT ALL SELECT o_orderkey FROM b)) = 0 AND
          (SELECT count(*) FROM (SELECT o_orderkey FROM b EXCEPT ALL SELECT o_orderkey FROM a)) = 0 AS same_first_column,
          (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) = 0 AND
          (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) = 0 AS same_rows
        UNION ALL SELECT 'nation_vs_region_of_customers',
          (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT ALL SELECT c_custkey FROM r)) = 0 AND
          (SELECT count(*) FROM (SELECT c_custkey FROM r EXCEPT ALL SELECT c_custkey FROM customer)) = 0,
          (SELECT count(*) FROM (SELECT c_custkey, c_nationkey FROM customer EXCEPT ALL SELECT * FROM r)) = 0 AND
          (SELECT count(*) FROM (SELECT * FROM r EXCEPT ALL SELECT c_custkey, c_nationkey FROM customer)) = 0""",
    "format_duration": """SELECT user_id, seconds,
          CASE WHEN t // 3600 > 0 THEN (t // 3600) || 'h ' ELSE '' END || ((t // 60) % 60) || 'm ' || (t % 60) || 's' AS duration
        FROM (SELECT *, CAST(round_even(seconds, 0) AS BIGINT) AS t FROM (
          SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds FROM events GROUP BY user_id))""",
    "bytes_to_mb": """SELECT source, bytes, round_even(bytes / 1048576.0, 3) AS size_mb
        FROM (SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source)""",
}
ORACLE["execution_report"] = " UNION ALL ".join(
    f"SELECT '{name}' AS dataset, count(*) AS output_rows, CAST(NULL AS VARCHAR) AS error FROM ("
    f"{_dedup_sql(_prefix_sql(pos, 1, 3, 'e.act'), _split_sql(pos), cross=False)})"
    for name, pos in (("events", sqlx.EVENTS_POS), ("orders", sqlx.ORDERS_POS)))
