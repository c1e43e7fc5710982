"""A semantic prompt cache: a prompt close enough to a kept one is answered from the cache.

A cache belongs to a scope (a tenant, a user, a model) and, inside it, to a cell of random
hyperplanes through the origin, so that a scope with most of the prompts is spread over tasks. Every
cache is exact: it decides as one that reads its prompts one after the other would. Two prompts at an
angle a fall into the same cell with probability (1 - a / pi) ** planes; without planes a scope is one
cache.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

SCOPE, CELL, UNIT = "_scope", "_cell", "_unit"
# Prompts without a usable vector meet no cache; they are dealt by their key.
NO_VECTOR_PARTS = 1024


def unit_vectors(vectors: pd.Series) -> pd.Series:
    """Vectors of length one; None for those that are null, empty, zero or not finite."""

    def unit(vector) -> np.ndarray | None:
        if vector is None:
            return None
        values = np.asarray(vector, dtype=np.float64)
        largest = np.abs(values).max() if values.size else 0.0
        if not np.isfinite(largest) or largest == 0:
            return None
        # Scaled first, so that no square overflows or vanishes.
        values = values / largest
        return values / np.linalg.norm(values)

    return vectors.map(unit)


def cell_of(vector: np.ndarray, planes: int, seed: int) -> int:
    """The sides of the hyperplanes that the vector lies on, as the bits of a number."""
    normals = np.random.default_rng(seed).standard_normal((planes, vector.size))
    return int(((normals @ vector) > 0) @ (1 << np.arange(planes, dtype=np.int64)))


class SemanticCache(StatefulProcessor):
    """The entries of one cache, by the number of their insertion."""

    def __init__(self, key: str, time: str, threshold: float, ttl_seconds: int, max_entries: int, columns: list[str]):
        self.key, self.time, self.threshold, self.columns = key, time, threshold, columns
        self.ttl, self.most = int(ttl_seconds * 1_000_000), max_entries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "at bigint", "micros bigint, name string, vector array<double>")
        self.next = handle.getValueState("next", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A repeated prompt has the same vector; it is held once, so a popular prompt stays small.
        parts, known, vectors = [], {}, []
        for part in rows:
            if not len(part):
                continue
            # Spark renames columns that are no Python names; their order stays.
            part.columns = [*self.columns, UNIT, SCOPE, CELL]
            which = []
            for vector in part[UNIT]:
                name = None if vector is None else np.asarray(vector, dtype=np.float64).tobytes()
                if name not in known:
                    known[name] = len(vectors)
                    vectors.append(None if vector is None else np.asarray(vector, dtype=np.float64))
                which.append(known[name])
            parts.append(part[self.columns].assign(_which=which))
        if not parts:
            return
        batch = pd.concat(parts, ignore_index=True).sort_values([self.time, self.key], kind="stable", ignore_index=True)
        micros = batch[self.time].to_numpy().astype("datetime64[us]").astype("int64")
        found, similarity = self.decide(micros, batch[self.key].astype(str).to_numpy(), batch["_which"].to_numpy(), vectors)
        yield batch[self.columns].assign(cached_id=found, similarity=similarity)

    def decide(self, micros, names, which, vectors) -> tuple[list, list]:
        """(entry met or None, similarity or None) per row; the state follows."""
        if vectors[which[0]] is None:
            return [None] * len(micros), [None] * len(micros)
        # Insertion number -> (time, name, vector); in the order of insertion.
        live = {k[0]: (v[0], v[1], np.asarray(v[2])) for k, v in sorted(self.entries.iterator())}
        stored, number = set(live), self.next.get()[0] if self.next.exists() else 0
        matrix, order, found, similarity = None, [], [], []
        for t, name, w in zip(micros.tolist(), names, which):
            old = [k for k, entry in live.items() if entry[0] + self.ttl < t]
            for k in old:
                del live[k]
            if old or matrix is None:
                order = list(live)
                matrix = np.array([live[k][2] for k in order]).reshape(len(order), vectors[w].size)
            near = matrix @ vectors[w]
            best = int(near.argmax()) if len(near) else -1
            if best >= 0 and near[best] >= self.threshold:
                found.append(live[order[best]][1])
                similarity.append(float(near[best]))
                continue
            found.append(None)
            similarity.append(None)
            live[number] = (t, name, vectors[w])
            number += 1
            if len(live) > self.most:
                del live[next(iter(live))]
            matrix = None
        for k in stored - live.keys():
            self.entries.removeKey((k,))
        for k in live.keys() - stored:
            t, name, vector = live[k]
            self.entries.updateValue((k,), (t, name, vector.tolist()))
            # The entry still covers a prompt at exactly its limit.
            self.handle.registerTimer((t + self.ttl) // 1000 + 1)
        self.next.update((number,))
        return found, similarity

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        for k in [k for k, v in self.entries.iterator() if v[0] + self.ttl < limit]:
            self.entries.removeKey(k)
        return iter([])

    def close(self) -> None:
        pass


def semantic_cache(
    events: DataFrame,
    key: str = "id",
    vector: str = "embedding",
    scope: str | None = None,
    threshold: float = 0.95,
    ttl_seconds: int = 3600,
    max_entries: int = 1000,
    planes: int = 4,
    time: str = "ts",
    seed: int = 42,
) -> DataFrame:
    """Add `cached_id`, the kept prompt whose answer is used again, and its cosine `similarity`.

    Prompts are taken in the order of `time`, then `key`, batch by batch. One with cosine >=
    `threshold` to an entry at most `ttl_seconds` older meets it (the closest, then the earliest kept);
    any other gets null and becomes an entry itself. A cache keeps `max_entries`, first in, first out,
    and a hit does not renew an entry. Prompts whose vector is null, empty, zero or not finite get null
    and are not kept. A null scope is a scope of its own. Rows without a time or later than the
    watermark (`ttl_seconds` behind the newest) are dropped by Spark.

    A batch's rows of one cache are sorted in one task, so a trigger should bound the batch; vectors of
    repeated prompts are held once. The session must use the RocksDB state store.
    """
    if max_entries < 1:
        raise ValueError("a cache keeps at least one entry")
    if not 0 <= planes <= 62:
        raise ValueError("planes are 0 to 62")

    @pandas_udf("array<double>")
    def unit(vectors: pd.Series) -> pd.Series:
        return unit_vectors(vectors)

    @pandas_udf("bigint")
    def cell(units: pd.Series) -> pd.Series:
        return units.map(lambda v: None if v is None else cell_of(np.asarray(v), planes, seed)).astype("Int64")

    apart = -1 - F.pmod(F.xxhash64(key), F.lit(NO_VECTOR_PARTS))
    given = F.to_json(F.struct(F.col(scope).alias("s"))) if scope else F.lit("")
    keyed = events.withColumn(UNIT, unit(vector)).withColumns(
        {SCOPE: given, CELL: F.coalesce(cell(UNIT) if planes else F.when(F.col(UNIT).isNotNull(), F.lit(0)), apart)}
    )
    added = [StructField("cached_id", StringType()), StructField("similarity", DoubleType())]
    return (
        keyed.withWatermark(time, f"{ttl_seconds} seconds")
        .groupBy(SCOPE, CELL)
        .transformWithStateInPandas(
            statefulProcessor=SemanticCache(key, time, threshold, ttl_seconds, max_entries, events.columns),
            outputStructType=StructType([*events.schema.fields, *added]),
            outputMode="Append",
            timeMode="EventTime",
        )
    )
