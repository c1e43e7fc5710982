"""Exact k nearest neighbours with a tree of pivots of two levels.

Training rows belong to the cell of their nearest pivot, and inside it to the leaf of their
nearest sub-pivot. A query first searches its own leaf, which bounds how far its k neighbours can
be. Two bounds then rule out most other cells and, inside a cell, most leaves: the triangle
inequality on a cell's radius, and the distance to the plane half-way between two pivots. Only
what is left is visited. No candidate is ever dropped without proof.

The driver sees the first pivots only. Sub-pivots stay in a table with one row per cell, leaves are
joined into blocks of bounded size, and a leaf with more rows than a block is cut, so neither a
crowded cell nor a popular one ends up in one task. A query's vector travels once to a cell it
must look at and once to a block, whatever the number of leaves there.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from answerflow.operators.blocks import BLOCK_ROWS, matrix, squared_distances
from answerflow.operators.ordering import hash_fraction
from answerflow.session import durable

MAX_PIVOTS = 1024
MAX_SUB_PIVOTS = 4096
LEAF_ROWS = 64
# Distances closer than this many decimals count as equal; the lower neighbour id then comes first.
DIGITS = 9
# Slack for rounding in the bounds: they may let a cell in too many, never one too few.
SLACK = 1e-6
# What a task holds at once, whatever a batch brings: distances in a matrix, rows handed on, and pairs
# measured again.
CELLS = 1 << 18
ROWS_OUT = 1 << 14
PAIRS = 1 << 13
# Rows of a block; comparisons go by leaf. Queries that are sent to their blocks at once: if every one
# visits all blocks, that is as many vectors as there are rows.
ROWS_OF_A_BLOCK = 4 * BLOCK_ROWS
QUERIES_OF_A_ROUND = 4 * BLOCK_ROWS


@dataclass(frozen=True)
class PivotTree:
    """An index over training rows.

    `blocks` holds the rows (cell, block, piece, t), `cells` the sub-pivots and leaves of a cell, and
    the arrays what the driver knows of each cell: its pivot, rows and radius.
    """

    blocks: DataFrame
    cells: DataFrame
    names: np.ndarray
    pivots: np.ndarray
    sizes: np.ndarray
    reach: np.ndarray
    key_type: str
    block_rows: int


def pick_pivots(train: DataFrame, n_train: int, key: str, vector: str, seed: int, leaf_rows: int) -> np.ndarray:
    """As many training vectors as the root of the wanted leaves, `MAX_PIVOTS` at most: the only
    rows that visit the driver."""
    wanted = max(1, min(MAX_PIVOTS, math.ceil(math.sqrt(n_train / leaf_rows))))
    share = min(1.0, 2.0 * wanted / max(n_train, 1) + 1e-9)
    some = train.select(key, vector).where(hash_fraction(key, seed) <= F.lit(share)).limit(wanted).collect()
    return matrix([r[vector] for r in (some or train.select(vector).limit(1).collect())])


def vectors(lists: pa.Array) -> np.ndarray:
    """Arrays of one length as the rows of a matrix."""
    if not len(lists):
        return np.empty((0, 0))
    lengths = pc.min_max(pc.list_value_length(lists)).as_py()
    if lengths["min"] != lengths["max"]:
        raise ValueError("vectors of different lengths")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def fields_of(rows: pa.ListScalar) -> dict[str, pa.Array]:
    """A packed array of rows by column."""
    structs = rows.values
    return dict(zip((f.name for f in structs.type), structs.flatten()))


def numbers(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False)


def steps(n: int, most: int) -> Iterator[slice]:
    """Slices of at most so many of n rows."""
    return (slice(a, min(a + most, n)) for a in range(0, n, most))


def at_once(width: int) -> int:
    """How many rows may meet `width` others in one matrix."""
    return max(1, CELLS // max(width, 1))


def record_batch(columns: dict[str, pa.Array | np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def columns_of(batch: pa.RecordBatch, part: slice) -> dict[str, pa.Array]:
    return {name: c[part] for name, c in zip(batch.schema.names, batch.columns)}


def packed(rows: DataFrame, by: list[str], n_packs, columns: list[str], name: str) -> DataFrame:
    """Rows dealt by id into packs within `by`: one row per pack with an array of its rows."""
    pack = F.pmod(F.xxhash64("id"), F.greatest(n_packs, F.lit(1)).cast("bigint")).alias("pack")
    return rows.groupBy(*by, pack).agg(F.collect_list(F.struct(*columns)).alias(name))


def build_tree(
    train: DataFrame, label: str, key: str = "id", vector: str = "embedding", seed: int = 42, leaf_rows: int = LEAF_ROWS,
    block_rows: int = ROWS_OF_A_BLOCK,
) -> PivotTree:
    """The index over the rows of `train` that have a vector; it is written to the shared folder."""
    spark = train.sparkSession
    train = train.where(F.col(vector).isNotNull())
    key_type, vector_type = dict(train.dtypes)[key], dict(train.dtypes)[vector]
    n_train = train.count()
    if n_train == 0:
        raise ValueError("no training rows")
    pivots = pick_pivots(train, n_train, key, vector, seed, leaf_rows)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch.num_rows, at_once(len(pivots))):
                given = columns_of(batch, part)
                gaps = np.sqrt(squared_distances(vectors(given["vector"]), pivots))
                cell = gaps.argmin(axis=1)
                yield record_batch(given | {"cell": cell.astype(np.int32), "radius": gaps[np.arange(len(cell)), cell]})

    # Vectors keep their type on the way; only the arithmetic is in double precision.
    row_type = f"id {key_type}, vector {vector_type}, label double"
    rows = train.select(F.col(key).alias("id"), F.col(vector).alias("vector"), F.col(label).cast("double").alias("label"))
    celled = durable(rows.mapInArrow(assign, f"{row_type}, cell int, radius double"))
    counts = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("radius").alias("far")).orderBy("cell").collect()
    # At most MAX_PIVOTS rows.
    wanted = [
        (r["cell"], r["n"], min(MAX_SUB_PIVOTS, max(1, round(r["n"] / leaf_rows))), [pivots[r["cell"]].tolist()]) for r in counts
    ]
    known = F.broadcast(spark.createDataFrame(wanted, "cell int, n long, wanted int, own array<array<double>>"))

    at_hash = hash_fraction("id", seed + 1)
    some = celled.join(known, "cell").where(at_hash <= 2.0 * F.col("wanted") / F.col("n") + 1e-9)
    place = F.row_number().over(W.partitionBy("cell").orderBy(at_hash, "id"))
    some = some.select("cell", "wanted", F.col("vector").cast("array<double>").alias("vector"), place.alias("_place"))
    chosen = some.where(F.col("_place") <= F.col("wanted")).groupBy("cell").agg(F.collect_list("vector").alias("chosen"))
    centres = durable(known.join(chosen, "cell", "left").select("cell", F.coalesce("chosen", "own").alias("centres")))

    packs = packed(celled.join(known, "cell"), ["cell"], F.ceil(F.col("n") / block_rows), ["id", "vector", "label"], "r")

    def to_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, packed_rows, centre_rows in zip(batch.column("cell"), batch.column("r"), batch.column("centres")):
                members, own = fields_of(packed_rows), vectors(centre_rows.values)
                for part in steps(len(members["id"]), at_once(len(own))):
                    given = {name: c[part] for name, c in members.items()}
                    gaps = np.sqrt(squared_distances(vectors(given["vector"]), own))
                    leaf = gaps.argmin(axis=1)
                    yield record_batch(given | {
                        "cell": np.full(len(leaf), cell.as_py(), np.int32), "leaf": leaf.astype(np.int32), "gap": gaps[np.arange(len(leaf)), leaf],
                    })

    met = packs.join(centres, "cell").select("cell", "r", "centres")
    leafed = durable(met.mapInArrow(to_leaves, f"{row_type}, cell int, leaf int, gap double"))
    leaves = leafed.groupBy("cell", "leaf").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius"))
    before = F.sum("n").over(W.partitionBy("cell").orderBy("leaf")) - F.col("n")
    leaves = durable(
        leaves.withColumn("block", F.floor(before / block_rows).cast("int")).withColumn("pieces", F.ceil(F.col("n") / block_rows))
    )
    placed = leafed.join(leaves.select("cell", "leaf", "block", "pieces"), ["cell", "leaf"])
    piece = F.pmod(F.xxhash64("id"), F.col("pieces")).alias("piece")
    blocks = placed.groupBy("cell", "block", piece).agg(F.collect_list(F.struct("id", "vector", "label", "leaf")).alias("t"))
    of_cell = leaves.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("leaf", "n", "radius", "block"))).alias("leaves"))
    names = np.array([r["cell"] for r in counts])
    return PivotTree(
        durable(blocks), durable(centres.join(of_cell, "cell")), names, pivots[names], np.array([r["n"] for r in counts]),
        np.array([r["far"] for r in counts]), key_type, block_rows,
    )


def lowest_distances(to_all: np.ndarray, between: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """What a query's distance to any row of a cell is at least.

    `to_all` are its distances to the pivots, `between` those of its own nearest pivot to them. Rows of
    another cell lie beyond the plane half-way between the two pivots, and within their radius.
    """
    own = to_all.min(axis=1, keepdims=True)
    planes = (to_all**2 - own**2) / np.where(between > 0, 2 * between, np.inf)
    return np.maximum(to_all - reach[None, :], planes)


def first_limits(to_pivot: np.ndarray, sizes: np.ndarray, reach: np.ndarray, k: int) -> np.ndarray:
    """A distance within which at least k rows lie for sure (all, if there are fewer)."""
    farthest = to_pivot + reach[None, :]
    order = farthest.argsort(axis=1)
    enough = np.cumsum(sizes[order], axis=1) >= min(k, sizes.sum())
    return np.take_along_axis(farthest, order, axis=1)[np.arange(len(to_pivot)), enough.argmax(axis=1)] + SLACK


def visits_of(
    tree: PivotTree, asked: DataFrame, n_queries: int, pick: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
) -> DataFrame:
    """Rows (cell, block, id, vector, limit, leaves) for the queries `asked` (id, vector, limit, cell).

    `pick(distances to sub-pivots, lower bounds, limits, own leaf)` says which leaves are visited.
    """
    packs = packed(asked, ["cell"], F.lit(math.ceil(n_queries / tree.block_rows)), ["id", "vector", "limit"], "q")
    met = packs.join(tree.cells, "cell").select("cell", "q", "centres", "leaves")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, packed_rows, centre_rows, leaf_rows in zip(*(batch.column(c) for c in ("cell", "q", "centres", "leaves"))):
                queries, leaves = fields_of(packed_rows), fields_of(leaf_rows)
                leaf, block, radius = (numbers(leaves[c]) for c in ("leaf", "block", "radius"))
                centres = vectors(centre_rows.values)[leaf]
                for part in steps(len(queries["id"]), at_once(len(centres))):
                    given = {name: c[part] for name, c in queries.items()}
                    gaps = np.sqrt(squared_distances(vectors(given["vector"]), centres))
                    own = gaps.argmin(axis=1)
                    between = np.sqrt(squared_distances(centres[own], centres))
                    lowest = lowest_distances(gaps, between, radius)
                    q, c = np.nonzero(pick(gaps, lowest, numbers(given["limit"]), own))
                    # Leaves are in order, and so are their blocks: a query's leaves of a block are neighbours here.
                    first = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (block[c[1:]] != block[c[:-1]])]) if len(q) else q
                    ends = np.r_[first, len(q)]
                    for some in steps(len(first), ROWS_OUT):
                        a, b = ends[some.start], ends[some.stop]
                        at = pa.array(q[first[some]])
                        listed = pa.ListArray.from_arrays(pa.array((ends[some.start : some.stop + 1] - a).astype(np.int32)), pa.array(leaf[c[a:b]].astype(np.int32)))
                        yield record_batch({name: v.take(at) for name, v in given.items()} | {
                            "cell": np.full(len(at), cell.as_py(), np.int32), "block": block[c[first[some]]].astype(np.int32), "leaves": listed,
                        })

    types = dict(asked.dtypes)
    return met.mapInArrow(
        run, f"id {types['id']}, vector {types['vector']}, limit double, cell int, block int, leaves array<int>"
    )


def search_blocks(tree: PivotTree, visits: DataFrame, n_queries: int, k: int) -> DataFrame:
    """(id, neighbour, distance, label): the best k of every block for the queries that visit it."""
    packs = packed(visits, ["cell", "block"], F.lit(math.ceil(n_queries / tree.block_rows)), ["id", "vector", "limit", "leaves"], "q")
    met = packs.join(tree.blocks, ["cell", "block"]).select("q", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed_queries, packed_members in zip(batch.column("q"), batch.column("t")):
                queries, members = fields_of(packed_queries), fields_of(packed_members)
                order = np.argsort(numbers(members["leaf"]), kind="stable")
                members = {name: c.take(pa.array(order)) for name, c in members.items()}
                vb, leaf = vectors(members["vector"]), numbers(members["leaf"])
                names, first = np.unique(leaf, return_index=True)
                bounds = list(zip(names, first, np.r_[first[1:], len(leaf)]))
                for part in steps(len(queries["id"]), at_once(len(leaf))):
                    given = {name: c[part] for name, c in queries.items()}
                    va, limit = vectors(given["vector"]), numbers(given["limit"])
                    at = np.repeat(np.arange(len(va)), numbers(pc.list_value_length(given["leaves"])))
                    asked = numbers(given["leaves"].flatten())
                    by = np.argsort(asked, kind="stable")
                    at, asked = at[by], asked[by]
                    found = []
                    for name, a, b in bounds:
                        q = at[np.searchsorted(asked, name) : np.searchsorted(asked, name, side="right")]
                        if not len(q):
                            continue
                        gaps = np.sqrt(squared_distances(va[q], vb[a:b]))
                        keep = min(k, gaps.shape[1])
                        kth = np.partition(gaps, keep - 1, axis=1)[:, keep - 1]
                        i, j = np.nonzero(gaps <= np.minimum(kth + SLACK, limit[q])[:, None] + SLACK)
                        found.append((q[i], a + j))
                    if not found:
                        continue
                    i, j = (np.concatenate([f[n] for f in found]) for n in (0, 1))
                    # Candidates are measured again without cancellation before the cut.
                    distance = np.empty(len(i))
                    for some in steps(len(i), PAIRS):
                        distance[some] = np.round(np.sqrt(((va[i[some]] - vb[j[some]]) ** 2).sum(1)), DIGITS)
                    hits = pd.DataFrame({
                        "id": numbers(given["id"])[i], "neighbour": numbers(members["id"])[j], "distance": distance, "label": numbers(members["label"])[j],
                    })
                    best = hits.sort_values(["id", "distance", "neighbour"]).groupby("id", sort=False).head(k)
                    kinds = {"id": given["id"].type, "neighbour": members["id"].type, "distance": pa.float64(), "label": pa.float64()}
                    yield record_batch({c: pa.array(best[c], kind, from_pandas=True) for c, kind in kinds.items()})

    return met.mapInArrow(run, f"id {dict(visits.dtypes)['id']}, neighbour {tree.key_type}, distance double, label double")


def start_queries(tree: PivotTree, queries: DataFrame, k: int, key: str, vector: str) -> tuple[DataFrame, int]:
    """The queries (id, vector, limit, cell) with their nearest pivot and a first limit, written, and how many there are."""
    types = dict(queries.dtypes)
    names, pivots, sizes, reach = tree.names, tree.pivots, tree.sizes, tree.reach

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch.num_rows, at_once(len(pivots))):
                given = columns_of(batch, part)
                gaps = np.sqrt(squared_distances(vectors(given["vector"]), pivots))
                yield record_batch(given | {"limit": first_limits(gaps, sizes, reach, k), "cell": names[gaps.argmin(axis=1)].astype(np.int32)})

    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("vector"))
    started = durable(asked.mapInArrow(start, f"id {types[key]}, vector {types[vector]}, limit double, cell int"))
    return started, started.count()


def visits_after(tree: PivotTree, started: DataFrame, n_queries: int, k: int) -> DataFrame:
    """The leaves every started query has to visit after a first look into its own."""
    types = dict(started.dtypes)
    names, pivots, reach = tree.names, tree.pivots, tree.reach
    rows = f"id {types['id']}, vector {types['vector']}, limit double"

    def own_leaf(gaps, lowest, limit, own):
        return np.arange(gaps.shape[1])[None, :] == own[:, None]

    near = search_blocks(tree, visits_of(tree, started, n_queries, own_leaf), n_queries, k)
    closest = F.sort_array(F.collect_list("distance"))
    tighter = near.groupBy("id").agg(F.when(F.count(F.lit(1)) >= k, closest[k - 1] + SLACK).alias("tighter"))
    limited = started.join(tighter, "id", "left").select("id", "vector", F.least("limit", "tighter").alias("limit"))
    between_all = np.sqrt(squared_distances(pivots, pivots))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch.num_rows, at_once(len(pivots))):
                given = columns_of(batch, part)
                gaps = np.sqrt(squared_distances(vectors(given["vector"]), pivots))
                lowest = lowest_distances(gaps, between_all[gaps.argmin(axis=1)], reach)
                q, c = np.nonzero(lowest <= numbers(given["limit"])[:, None] + SLACK)
                for some in steps(len(q), ROWS_OUT):
                    at = pa.array(q[some])
                    yield record_batch({name: v.take(at) for name, v in given.items()} | {"cell": names[c[some]].astype(np.int32)})

    def within(gaps, lowest, limit, own):
        return lowest <= limit[:, None] + SLACK

    return visits_of(tree, limited.mapInArrow(others, f"{rows}, cell int"), n_queries, within)


def plan_visits(tree: PivotTree, queries: DataFrame, k: int, key: str = "id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """The leaves every query has to visit after a first look into its own, and how many queries there are."""
    started, n_queries = start_queries(tree, queries, k, key, vector)
    return visits_after(tree, started, n_queries, k), n_queries


def visited_pairs(tree: PivotTree, visits: DataFrame) -> int:
    """How many (query, training row) pairs the visits compare."""
    sizes = tree.cells.select("cell", F.explode("leaves").alias("l")).select("cell", "l.leaf", "l.n")
    seen = visits.select("cell", F.explode("leaves").alias("leaf")).groupBy("cell", "leaf").count()
    return seen.join(sizes, ["cell", "leaf"]).agg(F.sum(F.col("count") * F.col("n"))).first()[0] or 0


def search_tree(tree: PivotTree, queries: DataFrame, k: int = 5, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(id, neighbour, distance, label, rank) for the k Euclidean neighbours of every query row."""
    started, n_queries = start_queries(tree, queries, k, key, vector)
    rank = F.row_number().over(W.partitionBy("id").orderBy("distance", "neighbour"))
    # A query's vector goes to every block that it visits, which may be all. So queries go in rounds, and
    # what a round has moved goes before the next.
    rounds = max(1, math.ceil(n_queries / QUERIES_OF_A_ROUND))
    found = []
    for i in range(rounds):
        some = started.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == i) if rounds > 1 else started
        size = math.ceil(n_queries / rounds)
        hits = search_blocks(tree, visits_after(tree, some, size, k), size, k)
        found.append(durable(hits.withColumn("rank", rank).where(F.col("rank") <= k)))
    return reduce(DataFrame.unionAll, found)


def nearest_neighbours(
    queries: DataFrame,
    train: DataFrame,
    label: str,
    k: int = 5,
    key: str = "id",
    vector: str = "embedding",
    seed: int = 42,
    block_rows: int = ROWS_OF_A_BLOCK,
) -> DataFrame:
    """(id, neighbour, distance, label, rank) for the k Euclidean neighbours of every query row.

    Rows without a vector have no neighbours and are none. With fewer than k training rows
    all of them are returned; without any an error is raised.
    """
    tree = build_tree(train, label, key, vector, seed, block_rows=block_rows)
    return search_tree(tree, queries, k, key, vector)


def knn_classify(queries: DataFrame, train: DataFrame, label: str, k: int = 5, **names) -> DataFrame:
    """Share of the k neighbours with label 1 as `p`, and the majority label."""
    near = nearest_neighbours(queries, train, label, k, **names)
    return near.groupBy("id").agg(F.avg("label").alias("p")).withColumn(
        "prediction", (F.col("p") > 0.5).cast("int")
    )


def knn_regress(queries: DataFrame, train: DataFrame, label: str, k: int = 5, **names) -> DataFrame:
    """Mean label of the k neighbours as `score`."""
    near = nearest_neighbours(queries, train, label, k, **names)
    return near.groupBy("id").agg(F.avg("label").alias("score"))
