"""Near-duplicate embeddings by counting collisions on sorted one-dimensional projections.

Each of many tables projects the vectors onto a random line, sorts them along it inside cells of
vectors with the same signs on some random hyperplanes, and slides a window centred on each
vector. Two vectors collide in a table if they share the cell and lie within the window. Pairs
with enough collisions are verified by their cosine in double precision. How many hyperplanes
(so that a cell stays small), tables and collisions are needed follows from the number of
vectors and the recall asked for at the threshold itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from answerflow.llm.common import shuffle_width, store
from answerflow.llm.components import components, stars

# Vectors that a cell should hold if they lay evenly, and how many one task compares.
IN_A_CELL = 150
IN_ONE_TASK = 2_000
PAIRS_AT_ONCE = 100_000


@dataclass(frozen=True)
class Plan:
    """Hyperplanes per table, tables, window to each side, and collisions a candidate needs."""

    planes: int
    tables: int
    window: float
    collisions: int


def calibrate(rows: int, cosine: float, recall: float, collisions: int = 2) -> Plan:
    """The fewest tables with which a pair at exactly `cosine` collides `collisions` times or
    more with probability `recall`.

    Signs agree on a hyperplane with probability 1 - angle/pi. The difference along a random
    line is normal with the pair's distance as deviation; the window takes two deviations.
    Both hold for any data, as the lines are random. Closer pairs collide more often.
    """
    planes = max(0, round(math.log2(max(rows, 1) / IN_A_CELL)))
    distance = math.sqrt(2 - 2 * cosine)
    window = max(2 * distance, 1e-6)
    inside = math.erf(2 / math.sqrt(2))
    chance = (1 - math.acos(cosine) / math.pi) ** planes * inside
    tables = collisions
    while True:
        fewer = sum(
            math.comb(tables, i) * chance**i * (1 - chance) ** (tables - i) for i in range(collisions)
        )
        if 1 - fewer >= recall:
            return Plan(planes, tables, window, collisions)
        tables += 1


@lru_cache(maxsize=8)
def directions(plan: Plan, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hyperplane normals (size, tables * planes) and lines (size, tables)."""
    rng = np.random.default_rng([seed, size])
    lines = rng.standard_normal((size, plan.tables))
    return rng.standard_normal((size, plan.tables * plan.planes)), lines


def signatures(unit: np.ndarray, plan: Plan, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell number and position on the line, per vector and table."""
    normals, lines = directions(plan, unit.shape[1], seed)
    signs = (unit @ normals > 0).reshape(len(unit), plan.tables, plan.planes)
    cells = (signs * (1 << np.arange(plan.planes, dtype=np.int64))).sum(axis=2, dtype=np.int64)
    return cells, (unit @ lines).astype(np.float32)


def unpack(blobs, size: int) -> np.ndarray:
    """Unit vectors in double precision from packed floats."""
    raw = np.frombuffer(b"".join(blobs), "<f8").reshape(-1, size)
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def collisions(group: pd.DataFrame, plan: Plan, cosine: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs (row numbers) of one cell, each only in the first table it collides in.

    A part `across` two shares only compares rows of different shares.
    """
    size = int(group["size"].iloc[0])
    here = int(group["table"].iloc[0])
    unit = unpack(group["packed"], size)
    cells, places = signatures(unit, plan, seed)
    order = np.lexsort((group["node"].to_numpy(), places[:, here]))
    own, across = group["own"].to_numpy()[order], bool(group["across"].iloc[0])
    line = places[order, here].astype(np.float64)
    ends = np.searchsorted(line, line + plan.window, side="right")
    width = np.maximum(ends - np.arange(len(line)) - 1, 0)
    out_a, out_b = [], []
    upto = np.cumsum(width)
    at = 0
    while at < len(line):
        done = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, done + PAIRS_AT_ONCE, side="right")))
        w = width[at:end]
        a = np.repeat(np.arange(at, end), w)
        b = a + 1 + np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        if across:
            apart = own[a] != own[b]
            a, b = a[apart], b[apart]
        a, b = order[a], order[b]
        met = (cells[a] == cells[b]) & (np.abs(places[a] - places[b]) <= np.float32(plan.window))
        met[:, here] = True
        first = met.argmax(axis=1) == here
        enough = first & (met.sum(axis=1) >= plan.collisions)
        a, b = a[enough], b[enough]
        near = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine
        out_a.append(a[near])
        out_b.append(b[near])
        at = end
    return np.concatenate(out_a), np.concatenate(out_b)


def links_between(vectors: DataFrame, plan: Plan, cosine: float, seed: int) -> DataFrame:
    """From distinct vectors (node, weight, size, packed): rows (a, b, weight).

    With a `weight`, vector `a` has that many more linked rows; without one, a and b are
    connected. Cells with many vectors are split into shares; a part compares one share with
    itself or with another, so every two vectors meet once and a part stays small.
    """
    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, same in batch.groupby("size"):
                for at in range(0, len(same), 2_000):
                    part = same.iloc[at : at + 2_000]
                    cells, _ = signatures(unpack(part["packed"], int(size)), plan, seed)
                    for number in range(plan.tables):
                        yield pd.DataFrame({"node": part["node"], "size": size, "table": number, "cell": cells[:, number]})

    spark = vectors.sparkSession
    cell = ["size", "table", "cell"]
    dealt = store(vectors.select("node", "size", "packed").mapInPandas(deal, "node long, size int, table int, cell long"), "cells")
    crowded = dealt.groupBy(*cell).count().where(F.col("count") > IN_ONE_TASK)
    crowded = crowded.select(*cell, F.ceil(F.col("count") / IN_ONE_TASK).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    placed = (
        dealt.join(crowded, cell, "left")
        .withColumn("own", F.pmod(F.xxhash64("node"), parts).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .withColumn("part", F.least("own", "other").cast("long") * parts + F.greatest("own", "other"))
        .withColumn("across", F.col("part") % (parts + 1) != 0)
        .join(vectors.select("node", "weight", "packed"), "node")
        .select("node", "weight", "packed", *cell, "part", "own", "across")
        .repartition(shuffle_width(spark), *cell, "part")
        .sortWithinPartitions(*cell, "part")
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in cells_of(batches, [*cell, "part"]):
            if len(group) < 2:
                continue
            a, b = collisions(group, plan, cosine, seed)
            if not len(a):
                continue
            node, weight = group["node"].to_numpy(), group["weight"].to_numpy()
            more = np.zeros(len(node), np.int64)
            np.add.at(more, a, weight[b])
            np.add.at(more, b, weight[a])
            has = np.flatnonzero(more)
            child, root = stars(node[a], node[b])
            yield pd.DataFrame({"a": node[has], "b": None, "weight": more[has]}).astype({"b": "Int64"})
            yield pd.DataFrame({"a": child, "b": root, "weight": None}).astype({"weight": "Int64"})

    return placed.mapInPandas(compare, "a long, b long, weight long")


def cells_of(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows sorted by `key`, one after the other."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        if not len(batch):
            continue
        changed = np.zeros(len(batch), bool)
        changed[0] = True
        for c in key:
            values = batch[c].to_numpy()
            changed[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(changed)
        for a, b in zip(starts, starts[1:]):
            yield batch.iloc[a:b]
        held = batch.iloc[starts[-1] :]
    if held is not None:
        yield held


def near_duplicates(
    rows: DataFrame, id: str = "vec_id", vector: str = "embedding", cosine: float = 0.95, recall: float = 0.999, seed: int = 7
) -> DataFrame:
    """One row per row of `rows`: `vec_id`, `n_links` (other rows within `cosine`),
    `component_id` (smallest id reachable over links, itself included) and `kept`.

    Every link returned is verified; a pair at the threshold itself is found with probability
    `recall`, closer ones with more. Equal vectors are one vector with a weight, so copies
    make no pairs. Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, nor do vectors of different lengths; very large and small components count
    like others. A row without an id counts as a
    link of others, but has a null component and is not kept if all its copies have none;
    copies of its vector with an id name it. Repeated rows count as links of each other. Other
    columns are not looked at. An empty table gives an empty result.
    """
    doubles = F.transform(F.col(vector), lambda x: x.cast("double"))
    base = rows.select(F.col(id).alias("vec_id"), doubles.alias("values"))
    finite = ~F.exists("values", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    length = F.aggregate("values", F.lit(0.0), lambda s, x: s + x * x)
    largest = F.array_max(F.transform("values", lambda x: F.abs(x)))
    good = F.coalesce((F.size("values") > 0) & finite, F.lit(False))
    good = F.when(good, largest > 0).otherwise(False)
    base = base.withColumn("values", F.when(good, F.col("values")))
    # Squares of very large or small components leave double precision; the angle does not change
    # if the vector is measured in its largest component.
    outside = (length < 1e-200) | (length > 1e200)
    base = base.withColumn("largest", largest)
    base = base.withColumn(
        "values", F.when(outside, F.transform("values", lambda x: x / F.col("largest"))).otherwise(F.col("values"))
    ).drop("largest")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packed = [None if v is None else (np.asarray(v, "<f8") + 0.0).tobytes() for v in batch["values"]]
            yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "packed": packed})

    base = store(base.mapInPandas(pack, "vec_id long, packed binary"), "vectors")
    vectors = store(
        base.where("packed is not null").groupBy("packed").agg(F.min("vec_id").alias("lowest"), F.count(F.lit(1)).alias("weight"))
        .withColumn("node", F.coalesce("lowest", F.xxhash64("packed")))
        .withColumn("size", (F.octet_length("packed") / 8).cast("int")),
        "distinct-vectors",
    )
    plan = calibrate(vectors.count(), cosine, recall)
    found = store(links_between(vectors, plan, cosine, seed), "found")
    more = found.where("b is null").groupBy("a").agg(F.sum("weight").alias("more"))
    linked = components(found.where("b is not null").select("a", "b"))
    per_vector = (
        vectors.join(more, F.col("node") == F.col("a"), "left")
        .join(linked.withColumnRenamed("node", "child"), F.col("node") == F.col("child"), "left")
        .select("packed", "lowest", "weight", F.coalesce("more", F.lit(0)).alias("more"), F.coalesce("component", "node").alias("component"))
    )
    named = store(per_vector, "named-vectors")
    smallest = named.groupBy("component").agg(F.min("lowest").alias("component_id"))
    named = named.join(smallest, "component").select(
        F.col("packed").alias("same"), (F.col("weight") - 1 + F.col("more")).alias("n_links"), "component_id"
    )
    joined = base.join(named, F.col("packed") == F.col("same"), "left")
    component = F.when(F.col("packed").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
