"""What became of each cascade start: satisfied, escalated or abandoned."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KINDS = ("start", "satisfied", "escalate")
OUTCOME = {"satisfied": "satisfied", "escalate": "escalated", "start": "abandoned"}
SCHEMA = "session_id bigint, response_id bigint, ts timestamp, outcome string, resolved_at timestamp"


def resolve_cascades(events: DataFrame, ttl_seconds: int = 3600) -> DataFrame:
    """Batch form: the next cascade event of the session within the time limit decides.

    A start can only be decided within `ttl_seconds`, so a session is cut into spans of that
    length and each event is looked at in its own span and as look-ahead of the one before:
    a session with most of the events is spread over many tasks.
    """
    ttl = F.lit(int(ttl_seconds) * 1_000_000)
    timed = events.where(F.col("kind").isin(*KINDS)).select(
        "session_id", "response_id", "ts", "kind", F.unix_micros(F.col("ts").cast("timestamp")).alias("_t")
    )
    span = F.expr(f"_t div {int(ttl_seconds) * 1_000_000}")
    spread = timed.withColumn("_own", span).withColumn(
        "_span", F.explode(F.array(F.col("_own"), F.col("_own") - 1))
    )
    order = W.partitionBy("session_id", "_span").orderBy("_t", "response_id")
    looked = spread.withColumn("_next", F.lead("kind").over(order)).withColumn("_next_t", F.lead("_t").over(order))
    starts = looked.where((F.col("kind") == "start") & (F.col("_own") == F.col("_span")))
    in_time = F.col("_next_t") <= F.col("_t") + ttl
    outcome = F.when(in_time & (F.col("_next") == "satisfied"), F.lit("satisfied")).when(
        in_time & (F.col("_next") == "escalate"), F.lit("escalated")
    )
    return starts.select(
        "session_id", "response_id", F.col("ts").cast("timestamp").alias("ts"),
        F.coalesce(outcome, F.lit("abandoned")).alias("outcome"),
        F.timestamp_micros(F.when(in_time, F.col("_next_t")).otherwise(F.col("_t") + ttl)).alias("resolved_at"),
    )


class CascadeProcessor(StatefulProcessor):
    """Per session: waits until events are complete up to the watermark, then decides in order."""

    def __init__(self, ttl_seconds: int):
        self.ttl = pd.Timedelta(seconds=ttl_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "ts timestamp, response_id bigint, kind string")
        self.open = handle.getValueState("open", "ts timestamp, response_id bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            events = [
                (r.ts.to_pydatetime(), int(r.response_id), r.kind) for r in batch.itertuples(index=False)
            ]
            if events:
                self.pending.appendList(events)
                # One timer for all: when the first event is complete, what is ready is settled and the
                # next one that waits gets a timer.
                self.handle.registerTimer(self._millis(min(e[0] for e in events)))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # The first timer of a batch settles everything up to the watermark; others find nothing.
        limit = timerValues.getCurrentWatermarkInMs()
        waiting = sorted((pd.Timestamp(e[0]), e[1], e[2]) for e in self.pending.get())
        ready = [e for e in waiting if self._millis(e[0]) <= limit]
        later = [(e[0].to_pydatetime(), e[1], e[2]) for e in waiting if self._millis(e[0]) > limit]
        if ready:
            if later:
                self.pending.put(later)
                self.handle.registerTimer(self._millis(later[0][0]))
            else:
                self.pending.clear()
        current = None
        if self.open.exists():
            stored = self.open.get()
            current = (pd.Timestamp(stored[0]), stored[1])
        out = []

        def close(outcome: str, at: pd.Timestamp) -> None:
            out.append((key[0], current[1], current[0], outcome, at))

        for ts, response_id, kind in ready:
            if current is not None:
                if ts > current[0] + self.ttl:
                    close("abandoned", current[0] + self.ttl)
                else:
                    close(OUTCOME[kind], ts)
                current = None
            if kind == "start":
                current = (ts, response_id)
        if current is not None and self._millis(current[0] + self.ttl) <= limit:
            close("abandoned", current[0] + self.ttl)
            current = None
        if current is None:
            self.open.clear()
        else:
            self.open.update((current[0].to_pydatetime(), current[1]))
            self.handle.registerTimer(self._millis(current[0] + self.ttl))
        if out:
            yield pd.DataFrame(out, columns=["session_id", "response_id", "ts", "outcome", "resolved_at"])

    def close(self) -> None:
        pass

    @staticmethod
    def _millis(ts) -> int:
        """The first whole millisecond at or after the time, in UTC."""
        stamp = pd.Timestamp(ts)
        stamp = stamp.tz_localize("UTC") if stamp.tzinfo is None else stamp.tz_convert("UTC")
        return -(-stamp.value // 1_000_000)


def cascade_resolution(events: DataFrame, ttl_seconds: int = 3600, delay: str = "1 hour") -> DataFrame:
    """Stream form. `events` need session_id, response_id, ts (timestamp) and kind.

    A start is reported once the watermark has passed its decision; later rows are dropped.
    The session must use the RocksDB state store.
    """
    timed = events.where(F.col("kind").isin(*KINDS)).select("session_id", "response_id", "ts", "kind")
    return (
        timed.withWatermark("ts", delay)
        .groupBy("session_id")
        .transformWithStateInPandas(
            statefulProcessor=CascadeProcessor(ttl_seconds),
            outputStructType=SCHEMA,
            outputMode="Append",
            timeMode="EventTime",
        )
    )
