"""Boosted trees of second order, grown leaf by leaf.

Each round fits a tree to the gradients and curvatures of the loss. One pass over the rows adds them
up by (leaf, feature, bin) for all leaves that are open, the task that has the sums of a feature
finds its best split, and the driver sees one candidate per leaf and feature. The leaf with the
largest gain is split first, until there are `leaves`; leaves that can't get their turn any more are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from answerflow.plans.learned import LearnedClassifier, LearnedEstimator, LearnedRegressor, numbers_of, pieces_of, rows_of, summed
from answerflow.session import durable

# Rounds after which the margins of the rows are written, so that passes apply few trees.
ROUNDS_WRITTEN = 10


@dataclass
class Node:
    """A leaf, or a split at `feature` <= `cut` (bin `place`) with two children."""

    gradient: float = 0.0
    curvature: float = 0.0
    rows: float = 0.0
    depth: int = 0
    priority: float = np.inf  # the least gain on the way here: when best-first growth reaches it
    gain: float = 0.0
    feature: int = -1
    place: int = -1
    children: list["Node"] = field(default_factory=list)


def flat(root: Node, split: set[int], cuts: list[np.ndarray], rate: float, ridge: float) -> np.ndarray:
    """A tree as rows (feature or -1, bin, cut, left, right, value)."""
    rows: list[list[float]] = []

    def add(node: Node) -> int:
        at = len(rows)
        rows.append([-1, 0, 0.0, 0, 0, -rate * node.gradient / (node.curvature + ridge) if node.curvature + ridge > 0 else 0.0])
        if id(node) in split:
            left, right = add(node.children[0]), add(node.children[1])
            rows[at] = [node.feature, node.place, cuts[node.feature][node.place], left, right, 0.0]
        return at

    add(root)
    return np.array(rows)


def leaf_of(tree: np.ndarray, values: np.ndarray, column: int, rows: np.ndarray | None = None) -> np.ndarray:
    """The row of the tree in which each row of `values` (or of its `rows`) ends; compares with `column`
    (1: bins, 2: cuts). Quickest if the values of a feature lie next to each other."""
    rows = np.arange(len(values)) if rows is None else rows
    at = np.zeros(len(rows), np.int64)
    todo = [(0, np.arange(len(rows)))]
    while todo:
        place, here = todo.pop()
        if tree[place, 0] < 0:
            at[here] = place
        elif len(here):
            cut = int(tree[place, 1]) if column == 1 else float(tree[place, column])
            goes_left = values[:, int(tree[place, 0])][rows[here]] <= cut
            todo += [(int(tree[place, 3]), here[goes_left]), (int(tree[place, 4]), here[~goes_left])]
    return at


def bins_of(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The bins of a batch as a matrix in which those of a feature lie next to each other."""
    return np.asfortranarray(np.frombuffer(b"".join(batch.column("bins").to_pylist()), "<u2").reshape(batch.num_rows, width))


def best_split(sums: np.ndarray, bins: int, ridge: float, least_weight: float, least_rows: float) -> np.ndarray:
    """(gain, bin, gradient, curvature, rows of the left side, and of the whole) of the best cut of a feature."""
    g, h, n = sums.reshape(3, bins)
    left = np.cumsum([g, h, n], axis=1)[:, :-1]
    whole = np.array([g.sum(), h.sum(), n.sum()])
    right = whole[:, None] - left

    def worth(s):
        return s[0] ** 2 / np.maximum(s[1] + ridge, 1e-300)

    allowed = (np.minimum(left[1], right[1]) >= least_weight) & (np.minimum(left[2], right[2]) >= max(least_rows, 1))
    gains = np.where(allowed, worth(left) + worth(right) - worth(whole), -np.inf)
    at = int(gains.argmax()) if len(gains) else 0
    if not len(gains) or not np.isfinite(gains[at]):
        return np.array([0.0, -1, 0, 0, 0, *whole])
    return np.array([gains[at], at, *left[:, at], *whole])


def derivatives(f: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: bool) -> tuple[np.ndarray, np.ndarray]:
    if not classes:
        return weight * (f - y), weight
    p = 1 / (1 + np.exp(-np.clip(f, -700, 700)))
    return weight * (p - y), weight * p * (1 - p)


class BoostedTrees(LearnedEstimator):
    """`leaves` and `depth` 0 stand for no limit; `least_weight` and `least_rows` are what a side of a
    split needs at least in curvature and rows. A feature is cut at up to `bins` - 1 of its values,
    as evenly spread over the rows as a sketch tells."""

    settings = {
        "rounds": 100, "rate": 0.1, "leaves": 31, "depth": 0, "bins": 64, "ridge": 0.0, "least_weight": 1e-3, "least_rows": 20,
    }
    classes = True

    def feature_cuts(self, rows: DataFrame) -> list[np.ndarray]:
        """The values at which each feature may be cut, ascending."""
        shares = [i / self.value("bins") for i in range(1, self.value("bins"))]
        each = rows.select(F.posexplode("x").alias("feature", "v")).where(~F.isnan("v"))
        found = each.groupBy("feature").agg(F.percentile_approx("v", shares, 10_000).alias("cuts")).collect()
        wide = rows.select(F.size("x")).first()
        if wide is None:
            raise ValueError("no training rows")
        by = {r["feature"]: np.unique(np.array(r["cuts"], np.float64)) for r in found}
        return [by.get(i, np.empty(0)) for i in range(wide[0])]

    def binned(self, rows: DataFrame, cuts: list[np.ndarray], pieces: int) -> DataFrame:
        """Written rows (bins, y, weight) in so many files: features as bin numbers, two bytes each."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = rows_of(batch)
                    bins = np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)], axis=1).astype("<u2")
                    packed = pa.array([b.tobytes() for b in bins], pa.binary())
                    yield pa.RecordBatch.from_arrays([packed, batch.column("y"), batch.column("weight")], names=["bins", "y", "weight"])

        made = rows.select("x", "y", "weight").mapInArrow(run, "bins binary, y double, weight double")
        return durable(made.repartition(pieces))

    def grow(self, rows: DataFrame, trees: list[np.ndarray], start: float, cuts: list[np.ndarray], tasks: int) -> np.ndarray:
        """The next tree, given those that the rows' margins `f` lack."""
        width, bins, classes = len(cuts), max([len(c) for c in cuts], default=0) + 1, self.classes
        ridge, least_weight, least_rows = self.value("ridge"), self.value("least_weight"), self.value("least_rows")
        most = self.value("leaves") - 1 if self.value("leaves") else None
        deepest = self.value("depth") or np.inf
        root = Node()
        known, frontier, split = [root], [root], set()
        while frontier:
            # The tree so far, with the open leaves numbered by their place in it.
            tree = flat(root, split, cuts, 1.0, 1.0)
            order: list[Node] = []

            def listed(node: Node) -> None:
                order.append(node)
                for child in node.children if id(node) in split else []:
                    listed(child)

            listed(root)
            number = np.full(len(order), -1)
            open_ids = {id(n): i for i, n in enumerate(frontier)}
            for place, node in enumerate(order):
                number[place] = open_ids.get(id(node), -1)
            n_open = len(frontier)

            def work(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
                sums = np.zeros((3, n_open, width, bins))
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    values = bins_of(batch, width)
                    of = number[leaf_of(tree, values, 1)]
                    inside = np.flatnonzero(of >= 0)
                    f = numbers_of(batch, "f")[inside] + start
                    for t in trees:
                        f = f + t[leaf_of(t, values, 1, inside), 5]
                    g, h = derivatives(f, numbers_of(batch, "y")[inside], numbers_of(batch, "weight")[inside], classes)
                    first = of[inside] * bins
                    for j in range(width):
                        at = first + values[:, j][inside]
                        for i, v in enumerate((g, h, None)):
                            sums[i, :, j] += np.bincount(at, v, n_open * bins).reshape(n_open, bins)
                by_feature = sums.reshape(3, n_open * width, bins)
                return {k: by_feature[:, k] for k in range(n_open * width)}

            def finish(sums: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
                return {k: best_split(v, bins, ridge, least_weight, least_rows) for k, v in sums.items()}

            found = summed(rows, work, finish, tasks)
            for i, node in enumerate(frontier):
                # The first feature wins among equal gains.
                best = max(range(width), key=lambda j: (found[i * width + j][0], -j))
                gain, place, g, h, n, all_g, all_h, all_n = found[i * width + best]
                if node is root:
                    node.gradient, node.curvature, node.rows = all_g, all_h, all_n
                if gain > 1e-12 and place >= 0:
                    node.gain, node.feature, node.place = gain, best, int(place)
                    node.priority = min(node.priority, gain)
                    node.children = [
                        Node(g, h, n, node.depth + 1, node.priority),
                        Node(all_g - g, all_h - h, all_n - n, node.depth + 1, node.priority),
                    ]
            able = [n for n in known if n.children]
            able.sort(key=lambda n: (-n.priority, n.depth))
            split = {id(n) for n in able[:most]}
            frontier = [
                c for n in able[:most] for c in n.children
                if not any(c is k for k in known) and c.depth < deepest and c.rows >= 2 * max(least_rows, 1)
            ]
            known += frontier
        return flat(root, split, cuts, self.value("rate"), ridge)

    def learn(self, df: DataFrame) -> dict[str, np.ndarray]:
        rows = self.training_rows(df)
        cuts = self.feature_cuts(rows)
        total, y, n = rows.agg(F.sum("weight"), F.sum(F.col("weight") * F.col("y")), F.count(F.lit(1))).first()
        mean = y / total if total else 0.0
        if self.classes:
            mean = min(max(mean, 1e-9), 1 - 1e-9)
        start = float(np.log(mean / (1 - mean))) if self.classes else mean
        table = self.binned(rows, cuts, pieces_of(rows.sparkSession, n)).withColumn("f", F.lit(0.0)).persist()
        tasks, trees, fresh = table.rdd.getNumPartitions(), [], []
        try:
            for _ in range(self.value("rounds")):
                tree = self.grow(table, list(fresh), start, cuts, tasks)
                trees.append(tree)
                fresh.append(tree)
                if len(fresh) == ROUNDS_WRITTEN:
                    moved = advanced(table, fresh, len(cuts)).persist()
                    table.unpersist()
                    table, fresh = moved, []
        finally:
            table.unpersist()
        offsets = np.cumsum([0, *(len(t) for t in trees)])
        return {"start": start, "trees": np.concatenate(trees) if trees else np.empty((0, 6)), "offsets": offsets}


def advanced(rows: DataFrame, trees: list[np.ndarray], width: int) -> DataFrame:
    """The rows with their margins moved by the trees, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = bins_of(batch, width)
                f = numbers_of(batch, "f") + sum(t[leaf_of(t, values, 1), 5] for t in trees)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("bins"), batch.column("y"), batch.column("weight"), pa.array(f)], names=["bins", "y", "weight", "f"]
                )

    return durable(rows.mapInArrow(run, "bins binary, y double, weight double, f double"))


def margins(learned: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    f = np.full(len(x), float(learned["start"]))
    for a, b in zip(learned["offsets"], learned["offsets"][1:]):
        tree = learned["trees"][a:b]
        f += tree[leaf_of(tree, x, 2), 5]
    return f


class BoostedClassifierModel(LearnedClassifier):
    def outputs(self, learned):
        def apply(x: np.ndarray) -> np.ndarray:
            p = 1 / (1 + np.exp(-np.clip(margins(learned, x), -700, 700)))
            return np.stack([p, (p > 0.5).astype(float)], axis=1)

        return apply


class BoostedRegressorModel(LearnedRegressor):
    def outputs(self, learned):
        return lambda x: margins(learned, x)[:, None]


class BoostedClassifier(BoostedTrees):
    """Labels 0 and 1, logistic loss."""

    def _fit(self, df: DataFrame) -> BoostedClassifierModel:
        return BoostedClassifierModel.of(self.getFeaturesCol(), **self.learn(df))


class BoostedRegressor(BoostedTrees):
    """Squared error."""

    classes = False

    def _fit(self, df: DataFrame) -> BoostedRegressorModel:
        return BoostedRegressorModel.of(self.getFeaturesCol(), **self.learn(df))
