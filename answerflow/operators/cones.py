"""The best cosines of many rows to many prototypes, without comparing every row with every one.

Prototypes are dealt to cones around some of them. The angle between a row and a cone's axis,
less the cone's width, bounds the cosine to all prototypes inside: a row visits the most
promising cone of every signal first, and then only those that can still beat what it has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from answerflow.operators.blocks import BLOCK_ROWS, matrix
from answerflow.session import durable

#: Cones there are at most; their axes go to every task.
MOST_CONES = 1024
# Far above the rounding of a cosine.
SLACK = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


@dataclass(frozen=True)
class Cones:
    """Axes (one a row), and per (cone, signal) that has prototypes the widest angle to the axis."""

    axes: np.ndarray
    signals: tuple[str, ...]
    cone: np.ndarray
    signal: np.ndarray
    width: np.ndarray

    def bounds(self, rows: np.ndarray) -> np.ndarray:
        """Upper bounds of the cosines of `rows` (unit or zero) per (cone, signal)."""
        angle = np.arccos(np.clip(rows @ self.axes.T, -1.0, 1.0))[:, self.cone]
        bound = np.cos(np.maximum(angle - self.width, 0.0)) + SLACK
        return np.where(np.any(rows != 0, axis=1)[:, None], bound, 0.0)

    def first(self, rows: np.ndarray) -> list[np.ndarray]:
        """Per row the most promising cone of each signal."""
        bound = self.bounds(rows)
        picks = []
        for s in range(len(self.signals)):
            own = np.flatnonzero(self.signal == s)
            picks.append(self.cone[own[np.argmax(bound[:, own], axis=1)]])
        return [np.unique(p) for p in np.stack(picks, axis=1)]

    def others(self, rows: np.ndarray, best: np.ndarray, seen: list) -> list[np.ndarray]:
        """Per row the cones not seen that may hold more than `best` (per signal, -2 for none)."""
        open_ = self.bounds(rows) > best[:, self.signal]
        return [np.setdiff1d(self.cone[o], s) for o, s in zip(open_, seen)]


def make_cones(prototypes: DataFrame, cones: int) -> tuple[Cones, DataFrame]:
    """Cones of `prototypes` (signal, proto, copies), and the prototypes with `cone` and `part`:
    a cone is cut into parts of about BLOCK_ROWS, so that no task gets a large one whole."""
    picked = prototypes.select("proto").distinct().orderBy(F.xxhash64("proto")).limit(cones).toPandas()
    axes = unit(matrix(picked["proto"]))

    @F.pandas_udf("cone int, angle double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        rows = unit(matrix(vectors))
        cosines = rows @ axes.T
        at = np.argmax(cosines, axis=1)
        angle = np.arccos(np.clip(cosines[np.arange(len(rows)), at], -1.0, 1.0))
        # A vector of zeros has no angle; it is found from everywhere.
        return pd.DataFrame({"cone": at, "angle": np.where(np.any(rows != 0, axis=1), angle, np.pi)})

    dealt = durable(prototypes.withColumn("_n", nearest("proto")).select("signal", "proto", "copies", "_n.cone", "_n.angle"))
    sizes = dealt.groupBy("cone").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).alias("parts"))
    parts = dealt.join(F.broadcast(sizes), "cone").withColumn("part", F.pmod(F.xxhash64("signal", "proto"), "parts").cast("int"))
    # One row per cone and signal.
    widths = dealt.groupBy("cone", "signal").agg(F.max("angle").alias("width")).orderBy("cone", "signal").toPandas()
    signals = tuple(sorted(widths["signal"].unique()))
    number = {s: i for i, s in enumerate(signals)}
    signal = widths["signal"].map(number).to_numpy()
    return Cones(axes, signals, widths["cone"].to_numpy(), signal, widths["width"].to_numpy() + SLACK), parts


def _compare(visits: DataFrame, parts: DataFrame, key_type: str, n_rows: int, m: int) -> DataFrame:
    """`id`, `signal`, `tops` for rows (id, vector, cone): blocks of rows meet the parts of a cone."""
    blocks = max(1, math.ceil(n_rows / BLOCK_ROWS))
    # A part that many rows visit is spread: its rows go by block, the part to all of its salts.
    salts = min(blocks, 4 * int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    protos = parts.groupBy("cone", "part").agg(F.collect_list(F.struct("signal", "proto", "copies")).alias("protos"))
    protos = protos.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    block = F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)).cast("int")
    rows = visits.groupBy("cone", block.alias("block")).agg(F.collect_list(F.struct("id", "vector")).alias("rows"))
    pairs = rows.withColumn("salt", F.pmod("block", F.lit(salts))).join(protos, ["cone", "salt"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows, protos in zip(batch["rows"], batch["protos"]):
                left, ids = unit(matrix([r["vector"] for r in rows])), [r["id"] for r in rows]
                right = unit(matrix([p["proto"] for p in protos]))
                names = np.asarray([p["signal"] for p in protos])
                copies = np.asarray([p["copies"] for p in protos])
                for signal in np.unique(names):
                    own = names == signal
                    cosines = np.repeat(left @ right[own].T, copies[own], axis=1)
                    yield pd.DataFrame({"id": ids, "signal": signal, "tops": list(-np.sort(-cosines, axis=1)[:, :m])})

    return pairs.select("rows", "protos").mapInPandas(run, f"id {key_type}, signal string, tops array<double>")


def merged(tops: DataFrame, m: int) -> DataFrame:
    """Per id and signal the m best of all."""
    lists = tops.groupBy("id", "signal").agg(F.flatten(F.collect_list("tops")).alias("t"))
    return lists.select("id", "signal", F.slice(F.sort_array("t", asc=False), 1, m).alias("tops"))


def best_cosines(
    rows: DataFrame, prototypes: DataFrame, m: int, cones: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Per `id` and `signal` the m best cosines, best first (`tops`); and what was visited: per
    row `cones`, of `all_cones`.

    `rows` has id and vector, `prototypes` signal and proto, none of them null. Prototypes alike
    in both count as often as they are there. There are about as many cones as prototypes in
    blocks of BLOCK_ROWS, MOST_CONES at most, unless given.
    """
    key_type = dict(rows.dtypes)["id"]
    counted = durable(prototypes.groupBy("signal", "proto").agg(F.least(F.count(F.lit(1)), F.lit(m)).cast("int").alias("copies")))
    n_protos = counted.count()
    rows = durable(rows)
    n_rows = rows.count()
    if not n_protos or not n_rows:
        return rows.sparkSession.createDataFrame([], f"id {key_type}, signal string, tops array<double>"), rows.select(
            F.lit(0).alias("cones"), F.lit(0).alias("all_cones")
        )
    found, parts = make_cones(counted, min(MOST_CONES, cones or math.ceil(n_protos / BLOCK_ROWS)))
    names = found.signals

    @F.pandas_udf("array<int>")
    def first(vectors: pd.Series) -> pd.Series:
        return pd.Series(found.first(unit(matrix(vectors))))

    @F.pandas_udf("array<int>")
    def others(vectors: pd.Series, best: pd.Series, seen: pd.Series) -> pd.Series:
        return pd.Series(found.others(unit(matrix(vectors)), matrix(best), list(seen)))

    near = durable(rows.withColumn("seen", first("vector")))
    tops = durable(merged(_compare(near.select("id", "vector", F.explode("seen").alias("cone")), parts, key_type, n_rows, m), m))
    if len(found.axes) == 1:
        return tops, near.select(F.size("seen").alias("cones"), F.lit(1).alias("all_cones"))
    # The least that a signal's tops must be beaten by; -2 while there are fewer than m.
    least = F.when(F.size("tops") >= m, F.element_at("tops", -1)).otherwise(F.lit(-2.0))
    known = tops.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("signal", least))).alias("least"))
    known = known.withColumnRenamed("id", "_id")
    best: Column = F.array(*[F.coalesce(F.try_element_at("least", F.lit(s)), F.lit(-2.0)) for s in names])
    left = near.join(known, F.col("id") == F.col("_id")).select("id", "vector", "seen", best.alias("best"))
    left = durable(left.select("id", "vector", "seen", others("vector", "best", "seen").alias("more")))
    more = _compare(left.select("id", "vector", F.explode("more").alias("cone")), parts, key_type, n_rows, m)
    visited = left.select((F.size("seen") + F.size("more")).alias("cones"), F.lit(len(found.axes)).alias("all_cones"))
    return merged(tops.unionByName(more), m), visited
