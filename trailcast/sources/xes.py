"""Text of an XES log: its traces, its header, and the nested attributes of its elements.

A log is read as text records that end where the next ``<trace>`` begins, so a large file is
split over many tasks (the XML source reads a file in one task). Logs are UTF-8, with traces
opened by a plain ``<trace>`` tag."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailcast.session import materialize, ship_package

TRACE_OPEN, TRACE_CLOSE = "<trace>", "</trace>"
NESTED = ("list", "container")


def xes_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per trace, written once: trace_pos (1-based, by file path, then place in the
    file), xml (the trace's text as it is in the file) and has_nested. A text record is
    numbered inside its input split; the splits' offsets are one narrow row each."""
    lines = spark.read.option("lineSep", TRACE_OPEN).text(path)
    body = F.substring_index("value", TRACE_CLOSE, 1)
    raw = (lines.where(F.col("value").contains(TRACE_CLOSE))      # not the header
           .select(F.concat(F.lit(TRACE_OPEN), body, F.lit(TRACE_CLOSE)).alias("xml"),
                   body.rlike(f"<({'|'.join(NESTED)})[\\s>/]").alias("has_nested"),
                   F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
           .withColumn("_at", F.monotonically_increasing_id()))
    stored = materialize(raw)
    splits = stored.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    return (stored.join(offsets, ["_file", "_block"])
            .select((F.col("_off") + F.col("_at") - F.col("_first") + 1).alias("trace_pos"), "xml", "has_nested"))


def xes_header(spark: SparkSession, path: str) -> str:
    """What stands before the first trace of the log's first file: XML declaration, ``<log>``
    with its attributes, extensions, globals, classifiers and the log's own attributes."""
    files = spark.read.text(path).inputFiles()
    lines = spark.read.option("lineSep", TRACE_OPEN).text(unquote(min(files)))
    return lines.where(F.col("_metadata.file_block_start") == 0).select("value").first().value


def _children(element: ET.Element) -> list:
    """A list's or container's attributes in document order, nested ones as lists in turn."""
    held = element.find("values") if element.tag == "list" else element
    return [{"key": c.get("key"), "value": _children(c) if c.tag in NESTED else c.get("value")} for c in (held if held is not None else ())]


def _nested(element: ET.Element) -> dict:
    return {c.get("key"): json.dumps(_children(c), ensure_ascii=False) for c in element if c.tag in NESTED and c.get("key") is not None}


def _nested_of_trace(xml: str | None) -> list | None:
    if xml is None:
        return None
    try:
        trace = ET.fromstring(xml)
    except ET.ParseError:               # as the flat attributes: none from a broken element
        return None
    return [_nested(trace), *[_nested(e) for e in trace.findall("event")]]


def nested_attributes(records: DataFrame) -> F.Column | None:
    """Array column of maps key -> JSON text of the ``list`` and ``container`` attributes: the
    trace's own first, then each event's. None when no trace of the log has any, so that plain
    logs never pass Python; null for a trace without any. Traces go to Python by rows, a few at a
    time: an Arrow batch would hold the texts of 10,000 traces, however long they are."""
    if not records.where("has_nested").limit(1).count():
        return None
    ship_package(records.sparkSession)
    parse = F.udf(_nested_of_trace, T.ArrayType(T.MapType(T.StringType(), T.StringType())), useArrow=False)
    return parse(F.when(F.col("has_nested"), F.col("xml")))
