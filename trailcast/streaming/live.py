"""Live prefixes: every event that arrives gives the prefix it labels, while its trace is still
running (survey §2.10).

One stateful operator keyed by case (``transformWithState``). Arriving events wait in the state
until the watermark has passed their time, so events that come out of order, within
``delay``, are put in order; an event-time timer at the first waiting event takes out all that
are due, by (ts, event_pos) as the batch job orders them, and is set anew for the first that
stays. They wait in chunks, a JSON array in one list element for the events of a case in one
arrival, so that a case costs a handful of state calls per arrival, not some for every event; its
rows leave the operator the same way and are parsed by Spark. A taken event is the label of the anchor before it and
extends the trace's text; a row is (case_id, anchor, prefix, prediction, dedup_key, prefix_len),
equal to what the batch job gives for the same events. The state of a case is its text so
far, its last m events and the events that wait. Events later than the watermark are dropped
by Spark, as usual. A trace counts from its third event on, so the row of anchor 0 is held
until then. State is kept in RocksDB and restored from the stream's checkpoint."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from trailcast.config import PrefixConfig
from trailcast.functions.text import VALUES_MARKER
from trailcast.operators.clean import drop_null_cases, lifecycle_filter

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "case_id {case}, rows string"
#: a chunk of waiting events, JSON arrays [at, pos, act, by_cols, by_key], and what is kept of the events that were taken
WAITING = "events string"
CHUNK = 10_000              # events of a chunk at most
ROWS = "array<struct<anchor: bigint, prefix: string, prediction: string, dedup_key: string, prefix_len: bigint>>"
FIELDS = ("anchor", "prefix", "prediction", "dedup_key", "prefix_len")
#: no row is lost for its length or in silence
PARSE = {"mode": "FAILFAST", "maxStringLen": str((1 << 31) - 1)}
ROWS_CHARS = 8 << 20        # prefix text of an array of rows, beyond which the next begins
TRACE = "n long, plain string, dedup string, last array<struct<act string, rich string>>, held_prefix string, held_key string, held_label string"


def _arrays(rows: list[tuple]) -> Iterator[str]:
    """Rows as JSON arrays of bounded text, in the layout of ``ROWS``."""
    part, chars = [], 0
    for row in rows:
        part.append(dict(zip(FIELDS, row)))
        chars += len(row[1]) + len(row[3])
        if chars >= ROWS_CHARS:
            yield json.dumps(part, ensure_ascii=False)
            part, chars = [], 0
    if part:
        yield json.dumps(part, ensure_ascii=False)


class _Prefixes(StatefulProcessor):
    def __init__(self, cfg: PrefixConfig):
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.trace = handle.getValueState("trace", TRACE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            events = part["event"].tolist()
            for k in range(0, len(events), CHUNK):
                self.waiting.appendValue((f"[{','.join(events[k:k + CHUNK])}]",))
            at = int(part["at"].min())
            first = at if first is None else min(first, at)
        if first is not None:
            self._wake(first)
        return iter(())

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))                    # the millisecond that covers it

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(e for chunk in self.waiting.get() for e in json.loads(chunk[0]))
        due = [e for e in waiting if e[0] <= upto]
        if not due:                                       # an arrival's timer, its events taken with an earlier one's
            return
        if rest := waiting[len(due):]:
            self.waiting.put([(json.dumps(rest[k:k + CHUNK], ensure_ascii=False),) for k in range(0, len(rest), CHUNK)])
            self._wake(rest[0][0])
        else:
            self.waiting.clear()
        for rows in _arrays(self._extend(due)):
            yield pd.DataFrame({"case_id": [key[0]], "rows": [rows]})

    def _extend(self, events: list) -> list[tuple]:
        cfg, out = self.cfg, []
        n, plain, dedup, last, *held = self.trace.get() or (0, "", "", [], None, None, None)
        last = [tuple(e) for e in last or []]
        for _at, _pos, act, by_cols, by_key in events:
            if n and n - 1 >= cfg.base and (n - 1 - cfg.base) % cfg.gap == 0:
                row = (n - 1, ",".join([*([plain] if n > len(last) else []), *(rich for _a, rich in last)]), act, dedup, n)
                if n == 1:                                # its trace may end with this event
                    held = [row[1], dedup, act]
                else:
                    out.append(row)
            if n == 2 and held[0] is not None:
                out.insert(0, (0, held[0], held[2], held[1], 1))
                held = [None, None, None]
            values = by_cols if cfg.key_order == "reference" and n <= cfg.base else by_key
            last.append((act, act if cfg.m == 0 else act + VALUES_MARKER + values))
            while len(last) > cfg.m:
                old = last.pop(0)[0]
                plain = old if n + 1 - len(last) == 1 else f"{plain},{old}"
            dedup = act if n == 0 else dedup + cfg.dedup_sep + act
            n += 1
        self.trace.update((n, plain, dedup, last, *held))
        return out

    def close(self) -> None:
        pass


def live_prefixes(log: DataFrame, cfg: PrefixConfig = PrefixConfig(), delay: str = "1 hour") -> DataFrame:
    """Streaming prefix rows of a streaming event log (columns of :func:`from_table`, with a
    timestamp); ``delay`` is how much later than the latest event an event may arrive."""
    cfg.validate()
    spark = log.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kept = drop_null_cases(lifecycle_filter(log, enabled=cfg.lifecycle_filter)).where("ts is not null")
    time = F.col("ts").cast("timestamp")
    at = F.unix_micros(time)
    # an array of JSON texts, since a JSON array has one type: each text is valid by itself
    fields = [at.cast("string"), F.col("event_pos").cast("string"), *[_json_text(c) for c in (
        F.coalesce("activity", F.lit("nan")), F.col("vals_cols"), F.col("vals_sorted"))]]
    event = F.concat(F.lit("["), *[x for f in fields for x in (f, F.lit(","))][:-1], F.lit("]"))
    events = kept.select("case_id", time.alias("time"), at.alias("at"), event.alias("event"))
    case_type = dict(kept.dtypes)["case_id"]
    out = events.withWatermark("time", delay).groupBy("case_id").transformWithStateInPandas(
        _Prefixes(cfg), OUTPUT.format(case=case_type), outputMode="Append", timeMode="EventTime")
    return out.select("case_id", F.inline(F.from_json("rows", ROWS, PARSE)))


def _json_text(text: F.Column) -> F.Column:
    """A string as JSON text: an array of one string without its brackets."""
    array = F.to_json(F.array(text))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def start_live_prefixes(log: DataFrame, out_path: str, checkpoint_location: str, cfg: PrefixConfig = PrefixConfig(),
                        delay: str = "1 hour", available_now: bool = False) -> StreamingQuery:
    """Append the live prefixes of a streaming log to a Parquet table."""
    writer = live_prefixes(log, cfg, delay).writeStream.format("parquet").outputMode("append") \
        .option("path", out_path).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
