"""A feed-forward classifier trained on all rows in step: dropout, L2 penalty, early stopping.

A step takes the rows of one batch, which a hash of the row and the epoch decides. For an epoch the
rows are held in the order of their batches, so that a step reads little but its own. Every task returns
the gradient of its rows, layer by layer, and the sums of all tasks move the weights (Adam). A row's
dropout mask depends on the row, the epoch and the layer only. So a step has the same gradient however
the rows are partitioned, and a lost executor repeats exactly what it did. Held-out rows end the
training when their loss stops falling; the weights of the best epoch are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from answerflow.plans.learned import LearnedClassifier, LearnedEstimator, numbers_of, pieces_of, rows_of, summed
from answerflow.session import durable

Weights = list[tuple[np.ndarray, np.ndarray]]
ROWS_AT_ONCE = 4_096
# Products of a row and a weight that are worth a task of their own.
WORTH_A_TASK = 1 << 29


def mixed(values: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit numbers from any (the finalizer of splitmix64)."""
    z = values + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def uniform(rows: np.ndarray, *salt: int) -> np.ndarray:
    """A number in [0, 1) for each row, decided by the row and the salt."""
    z = rows.astype(np.int64).view(np.uint64)
    for s in salt:
        z = mixed(z ^ mixed(np.full(1, s, np.uint64)))
    return (z >> np.uint64(11)) / float(1 << 53)


def uniform_column(*salt: int) -> Column:
    """`uniform` of the column `row`."""

    @F.pandas_udf("double")
    def of(rows: pd.Series) -> pd.Series:
        return pd.Series(uniform(rows.to_numpy(), *salt))

    return of("row")


def mask(rows: np.ndarray, width: int, rate: float, *salt: int) -> np.ndarray:
    """Kept units (scaled so that their expected sum stays), 0 for those dropped."""
    z = mixed(uniform(rows, *salt).view(np.uint64)[:, None] + np.arange(width, dtype=np.uint64)[None, :])
    return np.where((z >> np.uint64(11)) / float(1 << 53) < rate, 0.0, 1.0 / (1.0 - rate))


def first_weights(inputs: int, hidden: list[int], seed: int) -> Weights:
    rng = np.random.default_rng(seed)
    sizes = [inputs, *hidden, 1]
    made = []
    for a, b in zip(sizes, sizes[1:]):
        limit = np.sqrt(6.0 / (a + b))
        made.append((rng.uniform(-limit, limit, (a, b)), np.zeros(b)))
    return made


def forward(weights: Weights, x: np.ndarray, masks: list[np.ndarray | None]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Logits, and what enters each layer."""
    entered = []
    for i, (w, b) in enumerate(weights):
        entered.append(x)
        x = x @ w + b
        if i < len(weights) - 1:
            x = np.maximum(x, 0)
            if masks[i] is not None:
                x = x * masks[i]
    return x[:, 0], entered


def loss_of(logit: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, logit) - y * logit


def gradient(weights: Weights, x: np.ndarray, y: np.ndarray, weight: np.ndarray, masks: list[np.ndarray | None]) -> tuple[float, Weights]:
    """Weighted loss and its gradient, summed over the rows."""
    logit, entered = forward(weights, x, masks)
    back = (weight * (1 / (1 + np.exp(-np.clip(logit, -700, 700))) - y))[:, None]
    out: Weights = []
    for i in range(len(weights) - 1, -1, -1):
        out.append((entered[i].T @ back, back.sum(axis=0)))
        if i:
            # What entered is positive exactly where a unit was on and kept.
            back = (back @ weights[i][0].T) * (entered[i] > 0)
            if masks[i - 1] is not None:
                back = back * masks[i - 1]
    return float((weight * loss_of(logit, y)).sum()), out[::-1]


def masks_of(rows: np.ndarray, hidden: list[int], dropout: list[float], *salt: int) -> list[np.ndarray | None]:
    return [mask(rows, n, r, *salt, i) if r > 0 else None for i, (n, r) in enumerate(zip(hidden, dropout))]


class DenseClassifierModel(LearnedClassifier):
    def outputs(self, learned):
        layers = int(learned["layers"])
        weights = [(learned[f"w{i}"], learned[f"b{i}"]) for i in range(layers)]

        def apply(x: np.ndarray) -> np.ndarray:
            p = 1 / (1 + np.exp(-np.clip(forward(weights, x, [None] * layers)[0], -700, 700)))
            return np.stack([p, (p >= 0.5).astype(float)], axis=1)

        return apply


class DenseClassifier(LearnedEstimator):
    """Labels 0 and 1. `dropout` is the share of units dropped after each hidden layer, `penalty` the L2
    penalty on the hidden layers' weights, `held_out` the share of rows that watch. The rate is
    halved after `slower_after` epochs without progress, training ends after `patience`."""

    settings = {
        "hidden": [1024, 512, 64], "dropout": [0.3, 0.2, 0.0], "penalty": 1e-4, "rate": 1e-3, "epochs": 50, "batch_rows": 8_192,
        "held_out": 0.1, "patience": 10, "slower_after": 4,
    }

    def one_pass(self, rows: DataFrame, weights: Weights, watching: bool, epoch: int, tasks: int) -> dict[int, np.ndarray]:
        """Loss, rows' weight and gradient sums: without gradient if `watching`."""
        hidden, dropout, seed = self.value("hidden"), self.value("dropout"), self.getSeed()
        shared = rows.sparkSession.sparkContext.broadcast(weights)

        def work(given: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
            now, sums, totals = shared.value, None, np.zeros(2)
            for part in given:
                if not part.num_rows:
                    continue
                row, x, y, w = part.column("row").to_numpy(), rows_of(part), numbers_of(part, "y"), numbers_of(part, "weight")
                for at in range(0, len(row), ROWS_AT_ONCE):
                    i = slice(at, at + ROWS_AT_ONCE)
                    totals[1] += w[i].sum()
                    if watching:
                        totals[0] += (w[i] * loss_of(forward(now, x[i], [None] * len(now))[0], y[i])).sum()
                        continue
                    loss, grads = gradient(now, x[i], y[i], w[i], masks_of(row[i], hidden, dropout, seed, 2, epoch))
                    totals[0] += loss
                    sums = grads if sums is None else [(a + c, b + d) for (a, b), (c, d) in zip(sums, grads)]
            out = {0: totals}
            for n, (w, b) in enumerate(sums or []):
                # A layer's rows are keys of their own, so that many tasks add them up.
                out |= {(n + 1) << 32 | j: v for j, v in enumerate(np.vstack([w, b]))}
            return out

        try:
            return summed(rows, work, tasks=tasks, numbers=2 + sum(w.size + b.size for w, b in weights))
        finally:
            shared.unpersist()

    def parted(self, rows: DataFrame, n: int, weights: Weights) -> tuple[DataFrame, DataFrame]:
        """The rows that train and those that watch, written, and held while they are used."""
        share, held = uniform_column(self.getSeed()), self.value("held_out")
        least = max(ROWS_AT_ONCE // 16, WORTH_A_TASK // sum(w.size for w, _ in weights))
        spark = rows.sparkSession
        return (
            durable(rows.where(share >= held).repartition(pieces_of(spark, int(n * (1 - held)), least))).persist(),
            durable(rows.where(share < held).repartition(pieces_of(spark, int(n * held), least))).persist(),
        )

    def _fit(self, df: DataFrame) -> DenseClassifierModel:
        rows = self.training_rows(df).select("row", "x", "y", "weight")
        first = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
        if not first[0]:
            raise ValueError("no training rows")
        n, inputs = first
        if len(self.value("dropout")) != len(self.value("hidden")):
            raise ValueError("one share of dropped units for each hidden layer")
        weights = first_weights(inputs, self.value("hidden"), self.getSeed())
        training, watching = self.parted(rows, n, weights)
        try:
            return self.trained(training, watching, n, weights)
        finally:
            training.unpersist()
            watching.unpersist()

    def trained(self, training: DataFrame, watching: DataFrame, n: int, weights: Weights) -> DenseClassifierModel:
        hidden, penalty, rate = self.value("hidden"), self.value("penalty"), self.value("rate")
        # What a pass over an empty table says.
        nothing = np.zeros(2)
        tasks, watchers = training.rdd.getNumPartitions(), watching.rdd.getNumPartitions()
        batches = max(1, round(n * (1 - self.value("held_out")) / self.value("batch_rows")))
        moments = [[np.zeros_like(v) for v in layer] for layer in weights], [[np.zeros_like(v) for v in layer] for layer in weights]
        best, lowest, waited, slow, steps, history = weights, np.inf, 0, 0, 0, []
        for epoch in range(self.value("epochs")):
            losses, dealt = [], training
            if batches > 1:
                # Held in order: what a step's rows do not lie in is skipped.
                batch = F.floor(uniform_column(self.getSeed(), 1, epoch) * batches)
                dealt = training.withColumn("batch", batch).sortWithinPartitions("batch").persist()
            for batch in range(batches):
                step_rows = dealt.where(F.col("batch") == batch) if batches > 1 else dealt
                found = self.one_pass(step_rows.select("row", "x", "y", "weight"), weights, False, epoch, tasks)
                total = found.get(0, nothing)[1]
                if total <= 0 or len(found) == 1:
                    continue
                losses.append(found[0][0] / total)
                steps += 1
                moved = []
                for i, (w, b) in enumerate(weights):
                    sums = np.stack([found[(i + 1) << 32 | j] for j in range(len(w) + 1)]) / total
                    grads = [sums[:-1] + (2 * penalty * w if i < len(hidden) else 0.0), sums[-1]]
                    layer = []
                    for k, (v, g) in enumerate(zip((w, b), grads)):
                        m, s = moments[0][i], moments[1][i]
                        m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.999 * s[k] + 0.001 * g * g
                        layer.append(v - rate * (m[k] / (1 - 0.9**steps)) / (np.sqrt(s[k] / (1 - 0.999**steps)) + 1e-7))
                    moved.append(tuple(layer))
                weights = moved
            if batches > 1:
                dealt.unpersist()
            watched = self.one_pass(watching, weights, True, epoch, watchers).get(0, nothing)
            # Without held-out rows the training loss is watched.
            now = watched[0] / watched[1] if watched[1] > 0 else (np.mean(losses) if losses else 0.0)
            history.append([np.mean(losses) if losses else 0.0, now, rate])
            if now < lowest - 1e-12:
                best, lowest, waited, slow = weights, now, 0, 0
                continue
            waited, slow = waited + 1, slow + 1
            if slow >= self.value("slower_after"):
                rate, slow = rate / 2, 0
            if waited >= self.value("patience"):
                break
        named = {f"w{i}": w for i, (w, _) in enumerate(best)} | {f"b{i}": b for i, (_, b) in enumerate(best)}
        return DenseClassifierModel.of(self.getFeaturesCol(), layers=len(best), history=np.array(history), **named)
