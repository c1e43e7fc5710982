"""Support vector machines with a kernel, for classes (with fitted probabilities) and for numbers.

Rows are mapped to their kernel values at a bounded number of landmark rows, turned so that dot products
of the mapped rows are the kernel between them (exactly so on the span of the landmarks, hence for all
rows if every distinct row is a landmark). In that space the machine is linear and is fitted by
reweighted least squares: each pass over all rows adds up one weighted product matrix per model.
The folds' models, whose held-out margins the probabilities are fitted on, are learned in the same
passes as the model of all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from answerflow.plans.learned import LearnedClassifier, LearnedEstimator, LearnedRegressor, numbers_of, rows_of, summed
from answerflow.session import durable

# Violations below this weigh like it, which bounds the weights of the least squares.
LEAST_VIOLATION = 1e-4


def kernel(name: str, degree: int, gamma: float, coef0: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    if name == "poly":
        return lambda a, b: (gamma * (a @ b.T) + coef0) ** degree
    if name == "rbf":
        return lambda a, b: np.exp(-gamma * np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0))
    raise ValueError(f"unknown kernel {name!r}; known: poly, rbf")


def mapper(learned: dict[str, np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """Features to mapped rows, with a last column of ones for the intercept."""
    k = kernel(str(learned["kernel"]), int(learned["degree"]), float(learned["gamma"]), float(learned["coef0"]))
    marks, turn = learned["landmarks"], learned["turn"]
    return lambda x: np.hstack([k(x, marks) @ turn, np.ones((len(x), 1))])


def violations(f: np.ndarray, y: np.ndarray, epsilon: float | None) -> tuple[np.ndarray, np.ndarray]:
    """How far each value is on the wrong side, and the target at which it would not be.

    Without `epsilon` y is -1 or 1 and the margin 1; with it, y may be missed by epsilon.
    """
    if epsilon is None:
        return np.maximum(1 - y * f, 0), y
    off = y - f
    return np.maximum(np.abs(off) - epsilon, 0), y - epsilon * np.sign(off)


def fold_of(row: np.ndarray, folds: int) -> np.ndarray:
    return (row.astype(np.int64).view(np.uint64) >> np.uint64(17)) % np.uint64(max(folds, 1))


def solve(
    rows: DataFrame, learned: dict[str, np.ndarray], penalty: float, epsilon: float | None, folds: int, passes: int, tolerance: float
) -> tuple[np.ndarray, list[float]]:
    """Weights of the folds' models and, last, of the model of all rows; and the latter's objective
    by pass.

    A pass returns the objective of the weights it was given and the next least squares. Where the
    objective rose, the step is halved.
    """
    to_mapped, models, size = mapper(learned), folds + 1, learned["turn"].shape[1] + 1
    rows = rows.select("row", "x", "y", "weight")
    tasks = rows.rdd.getNumPartitions()

    def one_pass(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def work(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
            sums = np.zeros((models, size, size + 1))
            loss = np.zeros(models)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y, w = to_mapped(rows_of(batch)), numbers_of(batch, "y"), numbers_of(batch, "weight")
                fold = fold_of(batch.column("row").to_numpy(), folds)
                for m in range(models):
                    inside = (fold != m) if m < folds else np.ones(len(y), bool)
                    far, target = violations(x @ weights[m], y, epsilon)
                    loss[m] += (w * far)[inside].sum()
                    pull = np.where(inside & (far > 0), w / np.maximum(far, LEAST_VIOLATION), 0.0)
                    sums[m, :, :size] += x.T @ (pull[:, None] * x)
                    sums[m, :, size] += x.T @ (pull * target)
            out = {m * size + i: sums[m, i] for m in range(models) for i in range(size)}
            out[models * size] = loss
            return out

        found = summed(rows, work, tasks=tasks)
        products = np.stack([np.stack([found[m * size + i] for i in range(size)]) for m in range(models)])
        norms = (weights[:, :-1] ** 2).sum(1) / 2
        return products, norms + penalty * found[models * size]

    weights = np.zeros((models, size))
    best, lowest, history = weights, np.full(models, np.inf), []
    products = np.zeros((models, size, size + 1))
    ridge = np.eye(size)
    ridge[-1, -1] = 1e-9  # the intercept is free
    for _ in range(passes):
        new_products, objective = one_pass(weights)
        better = objective < lowest
        gain = np.where(better, (lowest - objective) / np.maximum(objective, 1e-12), 0.0)
        best = np.where(better[:, None], weights, best)
        lowest = np.where(better, objective, lowest)
        products[better] = new_products[better]
        history.append(float(lowest[-1]))
        if (better & (gain < tolerance)).all() or not better.any() and np.abs(weights - best).max() < 1e-9:
            break
        target = np.stack([np.linalg.solve(ridge + penalty * p[:, :size], penalty * p[:, size]) for p in products])
        step = np.where(better, 1.0, 0.0)[:, None]
        weights = np.where(step > 0, target, (weights + best) / 2)
    return best, history


def landmark_rows(rows: DataFrame, wanted: int) -> np.ndarray:
    """Up to `wanted` different feature rows, those of the smallest hashes."""
    n = rows.count()
    if n == 0:
        raise ValueError("no training rows")
    share = min(1.0, 4.0 * wanted / n)
    low = (F.shiftrightunsigned(F.xxhash64("row"), 1) / F.lit(float(1 << 63))) <= F.lit(share)
    some = rows.where(low).groupBy("row").agg(F.first("x").alias("x")).orderBy(F.xxhash64("row"), "row").limit(wanted).collect()
    return np.array([r["x"] for r in (some or rows.select("x").limit(1).collect())], np.float64)


class KernelMachine(LearnedEstimator):
    """`gamma` 0 stands for 1 / (features x variance of all their values)."""

    settings = {
        "kernel": "rbf", "degree": 3, "gamma": 0.0, "coef0": 0.0, "penalty": 1.0, "landmarks": 256, "passes": 40, "tolerance": 1e-4,
    }

    def mapped(self, rows: DataFrame) -> dict[str, np.ndarray]:
        marks = landmark_rows(rows, self.value("landmarks"))
        gamma = self.value("gamma")
        if not gamma:
            spread = rows.select(F.explode("x").alias("v")).agg(F.var_pop("v")).first()[0]
            gamma = 1.0 / (marks.shape[1] * spread) if spread else 1.0
        learned = {
            "kernel": np.array(self.value("kernel")), "degree": self.value("degree"), "gamma": gamma, "coef0": self.value("coef0"),
            "landmarks": marks,
        }
        within = kernel(self.value("kernel"), self.value("degree"), gamma, self.value("coef0"))(marks, marks)
        values, vectors = np.linalg.eigh(within)
        kept = values > 1e-10 * max(values.max(), 1e-300)
        learned["turn"] = vectors[:, kept] / np.sqrt(values[kept])
        return learned


class KernelClassifierModel(LearnedClassifier):
    def outputs(self, learned):
        to_mapped, weights, (slope, start) = mapper(learned), learned["weights"], learned["sigmoid"]

        def apply(x: np.ndarray) -> np.ndarray:
            margin = to_mapped(x) @ weights
            return np.stack([1 / (1 + np.exp(-np.clip(slope * margin + start, -700, 700))), (margin > 0).astype(float)], axis=1)

        return apply


class KernelClassifier(KernelMachine):
    """Hinge loss, labels 0 and 1. Probabilities are a sigmoid of the margin, fitted on the margins
    of held-out folds; with fewer than two rows of a label in sight it falls back to the margin."""

    settings = KernelMachine.settings | {"kernel": "poly", "folds": 5}

    def _fit(self, df: DataFrame) -> KernelClassifierModel:
        rows = self.training_rows(df)
        folds = self.value("folds")
        signed = rows.withColumn("y", F.when(F.col("y") > 0, 1.0).otherwise(-1.0))
        learned = self.mapped(rows)
        weights, history = solve(signed, learned, self.value("penalty"), None, folds, self.value("passes"), self.value("tolerance"))
        learned["weights"], learned["history"] = weights[-1], history
        learned["sigmoid"] = self.sigmoid(signed, learned, weights, folds)
        return KernelClassifierModel.of(self.getFeaturesCol(), **learned)

    @staticmethod
    def sigmoid(rows: DataFrame, learned: dict[str, np.ndarray], weights: np.ndarray, folds: int) -> np.ndarray:
        to_mapped = mapper(learned)

        def held_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    fold = fold_of(batch.column("row").to_numpy(), folds).astype(np.int64)
                    margin = (to_mapped(rows_of(batch)) * weights[fold]).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(margin), batch.column("y"), batch.column("weight")], names=["margin", "y", "weight"])

        margins = durable(rows.mapInArrow(held_out, "margin double, y double, weight double"))
        good, bad = margins.agg(F.count_if(F.col("y") > 0), F.count_if(F.col("y") < 0)).first()
        if not good or not bad:
            return np.array([1.0, 0.0])
        # Targets a little inside 0 and 1, as if each label had one row more of the other kind.
        high, low = (good + 1.0) / (good + 2.0), 1.0 / (bad + 2.0)
        target = F.when(F.col("y") > 0, high).otherwise(low)
        both = margins.select("margin", F.explode(F.array(
            F.struct(F.lit(1.0).alias("label"), (target * F.col("weight")).alias("weight")),
            F.struct(F.lit(0.0).alias("label"), ((1 - target) * F.col("weight")).alias("weight")),
        )).alias("t")).select(array_to_vector(F.array("margin")).alias("features"), "t.*")
        fitted = LogisticRegression(weightCol="weight", maxIter=50).fit(both)
        return np.array([fitted.coefficients[0], fitted.intercept])


class KernelRegressorModel(LearnedRegressor):
    def outputs(self, learned):
        to_mapped, weights = mapper(learned), learned["weights"]
        return lambda x: (to_mapped(x) @ weights)[:, None]


class KernelRegressor(KernelMachine):
    """Errors up to `epsilon` cost nothing, larger ones what they exceed it by."""

    settings = KernelMachine.settings | {"epsilon": 0.1}

    def _fit(self, df: DataFrame) -> KernelRegressorModel:
        rows = self.training_rows(df)
        learned = self.mapped(rows)
        weights, history = solve(
            rows, learned, self.value("penalty"), self.value("epsilon"), 0, self.value("passes"), self.value("tolerance")
        )
        learned["weights"], learned["history"] = weights[-1], history
        return KernelRegressorModel.of(self.getFeaturesCol(), **learned)
