"""Event log sources (A1 XES, A2 tabular) producing the canonical event log:

    case_id, event_pos bigint, activity string, ts, [lifecycle string],
    attrs array<struct<key string, value string>>   (value text in column order),
    vals_cols / vals_sorted string                  (rendered value map, both key orders)

``event_pos`` is the total order the reference takes from file order; every first-wins
and tie rule downstream reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailcast.config import EventLogSpec
from trailcast.functions.text import abbreviate, composite_activity, py_repr, value_text
from trailcast.sources.xes import nested_attributes, xes_records

CASE_PREFIX = "case:"
LIFECYCLE = "lifecycle:transition"


def abbreviations(spark: SparkSession, names: list[str]) -> dict[str, str]:
    """:func:`abbreviate` of column or attribute names (schema metadata)."""
    if not names:
        return {}
    row = spark.range(1).select(*[abbreviate(F.lit(n)).alias(f"n{i}") for i, n in enumerate(names)]).first()
    return dict(zip(names, row))


def attribute_layout(spark: SparkSession, columns: list[str], spec: EventLogSpec) -> list[tuple[str, str]]:
    """(abbreviated key, source column) pairs in column order. Columns that share an
    abbreviation share one key: first position, last column's value (§2.13.4)."""
    excluded = {spec.case_col, spec.activity_col, *spec.activity_cols, *spec.extra_excluded}
    cols = list(spec.attr_cols) if spec.attr_cols is not None else \
        [c for c in columns if c not in excluded]
    order: list[str] = []
    source: dict[str, str] = {}
    short = abbreviations(spark, cols)
    for c in cols:
        if c in excluded:
            continue
        k = short[c]
        if k not in source:
            order.append(k)
        source[k] = c
    return [(k, source[k]) for k in order]


def rendered(base: DataFrame, values: list[tuple[str, F.Column]]) -> DataFrame:
    """``base`` with attrs and the value-map texts ``{'key': 'value', ...}`` in column order
    and in sorted key order, by native string functions. Each value is written once, and
    quoted once, in a projection of its own; what a job doesn't read is pruned."""
    keys = [k for k, _ in values]
    names = base.columns
    if not keys:
        return base.select(*names, F.array().cast("array<struct<key:string,value:string>>").alias("attrs"),
                           F.lit("{}").alias("vals_cols"), F.lit("{}").alias("vals_sorted"))
    written = base.select(*names, *[v.alias(f"_v{i}") for i, (_, v) in enumerate(values)])
    quoted = written.select("*", *[py_repr(F.col(f"_v{i}")).alias(f"_q{i}") for i in range(len(keys))])
    items = {k: F.concat(F.lit(repr(k) + ": "), F.col(f"_q{i}")) for i, k in enumerate(keys)}
    text = lambda ks: F.concat(F.lit("{"), F.concat_ws(", ", *[items[k] for k in ks]), F.lit("}"))
    attrs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"_v{i}").alias("value")) for i, k in enumerate(keys)])
    return quoted.select(*names, attrs.alias("attrs"), text(keys).alias("vals_cols"), text(sorted(keys)).alias("vals_sorted"))


def from_table(df: DataFrame, spec: EventLogSpec) -> DataFrame:
    """A2: map a tabular table onto the canonical event log (no rows dropped here)."""
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    layout = attribute_layout(df.sparkSession, df.columns, spec)
    act = F.col(spec.activity_col).cast("string")
    if spec.activity_cols:
        act = composite_activity(F.col(spec.activity_col), *[F.col(c) for c in spec.activity_cols])
    cols = [F.col(spec.case_col).alias("case_id"),
            F.col(spec.pos_col).cast("long").alias("event_pos"),
            act.alias("activity"),
            (F.col(spec.ts_col) if spec.ts_col else F.lit(None).cast("timestamp_ntz")).alias("ts")]
    if spec.lifecycle_col:
        cols.append(F.col(spec.lifecycle_col).cast("string").alias("lifecycle"))
    heads = ["case_id", "event_pos", "activity", "ts"] + (["lifecycle"] if spec.lifecycle_col else [])
    base = df.select(*cols, *[F.col(c).alias(f"_c{i}") for i, (_, c) in enumerate(layout)])
    out = rendered(base, [(k, value_text(F.col(f"_c{i}"), dtypes[c])) for i, (k, c) in enumerate(layout)])
    return out.select(*heads, "attrs", "vals_cols", "vals_sorted")


# --------------------------------------------------------------------------- presets
# Column mappings of the driver tables used as event logs (FIXTURES.md §1).

EVENTS_SPEC = EventLogSpec(case_col="user_id", activity_col="event_type", ts_col="ts",
                           pos_col="event_id")
ORDERS_SPEC = EventLogSpec(case_col="o_custkey", activity_col="o_orderpriority",
                           ts_col="o_orderdate", pos_col="o_orderkey")
CONVERSATIONS_SPEC = EventLogSpec(case_col="conv_id", activity_col="role", ts_col=None,
                                  pos_col="turn", attr_cols=("turn",))


def lifecycle_column(event_id: F.Column) -> F.Column:
    """Derived lifecycle attribute for ``events`` (FIXTURES.md §1)."""
    v = (F.when(event_id % 4 == 0, "start").when(event_id % 4 == 1, " Complete ")
         .when(event_id % 4 == 2, "completed").otherwise("COMPLETE"))
    return F.when(event_id % 17 == 0, F.lit(None).cast("string")).otherwise(v)


def events_with_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ev.withColumn("lifecycle:transition", lifecycle_column(F.col("event_id")))


EVENTS_LIFECYCLE_SPEC = EventLogSpec(case_col="user_id", activity_col="event_type", ts_col="ts",
                                     pos_col="event_id", lifecycle_col="lifecycle:transition")


def read_table_log(spark: SparkSession, path: str, spec: EventLogSpec,
                   fmt: str = "parquet", options: dict | None = None) -> DataFrame:
    reader = spark.read.format(fmt)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    return from_table(reader.load(path), spec)


# --------------------------------------------------------------------------- XES (A1)

_ATTR = T.ArrayType(T.StructType([T.StructField("_key", T.StringType()),
                                  T.StructField("_value", T.StringType())]))
_ATTR_KINDS = ["string", "date", "int", "float", "boolean", "id"]
_EVENT = T.StructType([T.StructField(k, _ATTR) for k in _ATTR_KINDS])
XES_TRACE_SCHEMA = T.StructType([T.StructField(k, _ATTR) for k in _ATTR_KINDS] +
                                [T.StructField("event", T.ArrayType(_EVENT))])


ENTRIES = "array<struct<key:string,value:string>>"


def _attr_entries(struct_col: F.Column) -> F.Column:
    """All typed key/value children of an XES element as key/value entries."""
    arrays = [F.coalesce(struct_col[k], F.array().cast(_ATTR)) for k in _ATTR_KINDS]
    return F.transform(F.concat(*arrays), lambda a: F.named_struct(F.lit("key"), a["_key"], F.lit("value"), a["_value"]))


def _last_wins(entries: F.Column) -> F.Column:
    """Map from key/value entries; of a repeated key the last value stays."""
    def later(e, i):
        rest = F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0)))
        return F.exists(rest, lambda r: r["key"] == e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: e["key"].isNotNull() & ~later(e, i)))


TRACE_SHIFT = 1 << 24   # event_pos = trace_pos * TRACE_SHIFT + position inside the trace


def _parsed(records: DataFrame, **more) -> DataFrame:
    """Typed attributes and events of trace texts, in the layout of ``XES_TRACE_SCHEMA``."""
    fields = F.from_xml("xml", XES_TRACE_SCHEMA.simpleString(), {"rowTag": "trace", "attributePrefix": "_"})
    return records.select("trace_pos", fields.alias("_t"), *[c.alias(n) for n, c in more.items()]) \
        .select("trace_pos", "_t.*", *more)


def read_xes_traces(spark: SparkSession, path: str) -> DataFrame:
    """XES traces (one row per ``<trace>``, also those without events) with ``trace_pos``, the
    trace's place in the log."""
    return _parsed(xes_records(spark, path))


def eventless_traces(traces: DataFrame) -> DataFrame:
    """Places (``first_pos``) of the traces without events: they count in the temporal split's N
    (``build_dataset(..., eventless=...)``), though no event of theirs is in the log."""
    return traces.where(F.col("event").isNull() | (F.size("event") == 0)) \
        .select((F.col("trace_pos") * F.lit(TRACE_SHIFT)).alias("first_pos"))


def read_xes_events(spark: SparkSession, path: str) -> DataFrame:
    """A1: one row per event with all attributes as map<string,string>; trace attributes
    carry the ``case:`` prefix; lists and containers are JSON text, ``[{"key": .., "value": ..}, ..]``
    in document order. Columns: trace_pos, event_in_trace, attributes."""
    records = xes_records(spark, path)
    nested = nested_attributes(records)
    none = F.array().cast(ENTRIES)
    traces = _parsed(records, _nested=none if nested is None else nested)
    deep = (lambda at: none) if nested is None else \
        (lambda at: F.coalesce(F.map_entries(F.get("_nested", at)), none))
    own = _last_wins(F.concat(_attr_entries(F.struct(*[F.col(k) for k in _ATTR_KINDS])), deep(F.lit(0))))
    ev = traces.select(
        "trace_pos", F.transform_keys(own, lambda k, v: F.concat(F.lit(CASE_PREFIX), k)).alias("_tattrs"),
        "_nested", F.posexplode("event").alias("event_in_trace", "ev"))
    return ev.select("trace_pos", "event_in_trace", _last_wins(F.concat(
        F.map_entries("_tattrs"), _attr_entries(F.col("ev")), deep(F.col("event_in_trace") + 1))).alias("attributes"))


def xes_to_log(xes_events: DataFrame, trace_identifier: str = "case:concept:name",
               attr_keys: list[str] | None = None, activity_keys: tuple[str, ...] = (),
               ts_style: str = "utc_offset") -> DataFrame:
    """Canonical log from :func:`read_xes_events`. Trace attributes other than the trace
    id are dropped (C2); ``attr_keys`` lists the event attributes kept as values, in
    column order. Default: the event attribute names present in the log (a distinct
    over names - bounded by the log's schema, not its size), sorted. A log in which no event has
    a lifecycle gets no lifecycle column, so that the filter (C1) leaves it whole."""
    a = F.col("attributes")
    if attr_keys is None:
        names = xes_events.select(F.explode(F.map_keys("attributes")).alias("k")).distinct().collect()
        attr_keys = sorted(r.k for r in names)
        has_lifecycle = LIFECYCLE in attr_keys
    else:
        has_lifecycle = xes_events.where(F.map_contains_key("attributes", LIFECYCLE)).limit(1).count() > 0
    keys = attr_keys
    # composite labels (e.g. name + lifecycle + resource + role) leave the values
    keys = [k for k in keys if not k.startswith(CASE_PREFIX) and k != "concept:name" and k not in activity_keys]
    layout: dict[str, str] = {}
    order: list[str] = []
    short = abbreviations(xes_events.sparkSession, keys)
    for k in keys:
        ab = short[k]
        if ab not in layout:
            order.append(ab)
        layout[ab] = k
    texts = [(ab, F.coalesce(_xes_value_text(layout[ab], a[layout[ab]], ts_style), F.lit("nan")))
             for ab in order]
    pos = F.when(F.col("event_in_trace") < TRACE_SHIFT, F.col("trace_pos") * F.lit(TRACE_SHIFT) + F.col("event_in_trace")) \
        .otherwise(F.raise_error(F.lit(f"a trace element holds more than {TRACE_SHIFT} events")).cast("long"))
    base = xes_events.select(
        a[trace_identifier].alias("case_id"), pos.cast("long").alias("event_pos"),
        (composite_activity(a["concept:name"], *[a[k] for k in activity_keys]) if activity_keys
         else a["concept:name"]).alias("activity"),
        F.to_timestamp(a["time:timestamp"]).alias("ts"),
        *([a[LIFECYCLE].alias("lifecycle")] if has_lifecycle else []), a.alias("attributes"))
    return rendered(base, texts).drop("attributes")


def read_xes_log(spark: SparkSession, path: str, trace_identifier: str = "case:concept:name",
                 attr_keys: list[str] | None = None, activity_keys: tuple[str, ...] = (),
                 ts_style: str = "utc_offset") -> DataFrame:
    return xes_to_log(read_xes_events(spark, path), trace_identifier, attr_keys, activity_keys, ts_style)


XES_TS = "^(\\d{4}-\\d{2}-\\d{2})[T ](\\d{2}:\\d{2}:\\d{2})(?:\\.(\\d+))?(Z|[+-]\\d{2}:?\\d{2})?$"


def xes_timestamp_text(raw: F.Column, style: str = "utc_offset") -> F.Column:
    """Text of an XES date the way pandas prints a timestamp (microseconds only when
    non-zero). ``utc_offset``: UTC time + '+00:00' (tz-aware UTC); ``as_written``: the
    file's local time and offset; ``naive``: UTC time without offset."""
    from trailcast.functions.text import timestamp_text
    if style == "naive":
        return timestamp_text(F.to_timestamp(raw))
    if style == "utc_offset":
        return F.concat(timestamp_text(F.to_timestamp(raw)), F.lit("+00:00"))
    if style != "as_written":
        raise ValueError(f"Unsupported timestamp style: {style}")
    g = lambda i: F.regexp_extract(raw, XES_TS, i)
    frac = F.rpad(F.substring(g(3), 1, 6), 6, "0")
    frac = F.when((g(3) == "") | (frac == "000000"), F.lit("")).otherwise(F.concat(F.lit("."), frac))
    off = g(4)
    off = (F.when(off == "", F.lit("")).when(off == "Z", F.lit("+00:00"))
           .when(F.length(off) == 5, F.concat(F.substring(off, 1, 3), F.lit(":"), F.substring(off, 4, 2)))
           .otherwise(off))
    return F.when(raw.rlike(XES_TS), F.concat(g(1), F.lit(" "), g(2), frac, off))


def _xes_value_text(key: str, v: F.Column, ts_style: str = "utc_offset") -> F.Column:
    if key == "time:timestamp":
        return xes_timestamp_text(v, ts_style)
    return v
