"""Dropping repeated prompts, as a cache with a time limit would."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


HASH = "_prompt_hash"


class PromptCache(StatefulProcessor):
    """Remembers per prompt when it was last let through; nothing else is kept."""

    def __init__(self, prompt: str, time: str, ttl_seconds: int, columns: list[str]):
        self.prompt, self.time, self.ttl, self.columns = prompt, time, int(ttl_seconds * 1_000_000), columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "micros bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # The text is the same in all rows, and may be long: it is held once.
        text, parts = None, []
        for part in rows:
            if len(part):
                # Spark renames columns that are no Python names; their order stays.
                part.columns = [*self.columns, HASH]
                text = part[self.prompt].iloc[0]
                parts.append(part[[c for c in self.columns if c != self.prompt]])
        if not parts:
            return
        batch = pd.concat(parts).sort_values(self.time, kind="stable")
        micros = batch[self.time].to_numpy().astype("datetime64[us]").astype("int64")
        last = self.kept.get()[0] if self.kept.exists() else None
        fresh = []
        at = 0
        while at < len(micros):
            if last is None or micros[at] > last + self.ttl:
                last = int(micros[at])
                fresh.append(at)
            # Jump to the first row that the entry no longer covers.
            at = max(at + 1, int(micros.searchsorted(last + self.ttl, side="right")))
        if fresh:
            self.kept.update((last,))
            # The entry still covers a row at exactly its limit.
            self.handle.registerTimer((last + self.ttl) // 1000 + 1)
            yield batch.iloc[fresh].assign(**{self.prompt: text})[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.kept.exists():
            if self.kept.get()[0] + self.ttl < timerValues.getCurrentWatermarkInMs() * 1000:
                self.kept.clear()
        return iter([])

    def close(self) -> None:
        pass


def dedupe_prompts(events: DataFrame, key: str = "prompt", ttl_seconds: int = 3600, time: str = "ts") -> DataFrame:
    """Drop a prompt seen again within `ttl_seconds` after it was last let through.

    Exact text match by SHA-256, in event-time order within a batch; missing prompts are one
    prompt. The session must use the RocksDB state store; an entry is forgotten once the
    watermark has passed its time limit.
    """
    hashed = events.withColumn(HASH, F.coalesce(F.sha2(F.col(key).cast("binary"), 256), F.lit("")))
    return (
        hashed.withWatermark(time, f"{ttl_seconds} seconds")
        .groupBy(HASH)
        .transformWithStateInPandas(
            statefulProcessor=PromptCache(key, time, ttl_seconds, events.columns),
            outputStructType=events.schema,
            outputMode="Append",
            timeMode="EventTime",
        )
    )
