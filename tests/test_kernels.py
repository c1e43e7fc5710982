"""Kernel machines against a plain solver, and on labels that no line can tell apart."""

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from answerflow.plans.features import vector_column
from answerflow.plans.kernels import KernelClassifier, KernelRegressor, kernel, mapper
from answerflow.plans.models import fit_model, load_model, save_model, score
from answerflow.session import scratch_path


def frame(spark, x, y, first=0):
    rows = [(first + i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y))]
    return vector_column(spark.createDataFrame(rows, "id long, embedding array<double>, label double"))


def objective(k, alpha, bias, y, epsilon):
    f = k @ alpha + bias
    far = np.maximum(1 - y * f, 0) if epsilon is None else np.maximum(np.abs(y - f) - epsilon, 0)
    return alpha @ k @ alpha / 2 + far.sum()


def plain(k, y, epsilon, steps=60_000):
    """Subgradient descent on the coefficients of all rows."""
    alpha, bias, best = np.zeros(len(y)), 0.0, np.inf
    for t in range(steps):
        f = k @ alpha + bias
        g = np.where(1 - y * f > 0, -y, 0.0) if epsilon is None else np.where(np.abs(y - f) > epsilon, -np.sign(y - f), 0.0)
        rate = 0.5 / (1 + t / 50)
        alpha, bias = alpha - rate * (alpha + g), bias - rate * 0.02 * g.sum()
        best = min(best, objective(k, alpha, bias, y, epsilon)) if t % 10 == 0 else best
    return best


@pytest.mark.parametrize("name, epsilon", [("poly", None), ("rbf", None), ("rbf", 0.1), ("poly", 0.1)])
def test_objective_is_that_of_a_plain_solver(spark, name, epsilon):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 3))
    y = np.sign(x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=80)) if epsilon is None else np.sin(2 * x[:, 0]) + 0.2 * rng.normal(size=80)
    if epsilon is None:
        machine = KernelClassifier(kernel=name, gamma=0.5, coef0=1.0, folds=2, labelCol="label")
        fitted = machine.fit(frame(spark, x, (y > 0).astype(float)))
    else:
        fitted = KernelRegressor(kernel=name, gamma=0.5, coef0=1.0, epsilon=epsilon, labelCol="label").fit(frame(spark, x, y))
    learned = fitted.arrays()
    assert learned["landmarks"].shape == (80, 3) and (np.diff(learned["history"]) <= 0).all()
    k = kernel(name, 3, 0.5, 1.0)(x, x)
    mapped = mapper(learned)(x)
    # Every row is a landmark: dot products of mapped rows are the kernel.
    assert np.allclose(mapped[:, :-1] @ mapped[:, :-1].T, k, atol=1e-6)
    w = learned["weights"]
    f = mapped @ w
    far = np.maximum(1 - y * f, 0) if epsilon is None else np.maximum(np.abs(y - f) - epsilon, 0)
    mine = w[:-1] @ w[:-1] / 2 + far.sum()
    assert mine == pytest.approx(learned["history"][-1], rel=1e-6)
    assert mine <= 1.01 * plain(k, y, epsilon)


def test_a_product_label_with_probabilities(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 4))
    chance = 1 / (1 + np.exp(-3 * x[:, 0] * x[:, 1]))
    y = (rng.random(900) < chance).astype(float)
    train, test = frame(spark, x[:600], y[:600]), frame(spark, x[600:], y[600:], 600)
    model = fit_model(train, KernelClassifier(kernel="poly", coef0=1.0, landmarks=120, labelCol="label"))
    rows = sorted(score(model, test, "classifier", ["id", "label"]).collect())
    right = np.mean([r.prediction == r.label for r in rows])
    line = fit_model(train, LinearSVC(labelCol="label", maxIter=50))
    straight = np.mean([r.prediction == r.label for r in score(line, test, "classifier", ["id", "label"]).collect()])
    best = np.mean((chance > 0.5)[600:] == (y[600:] > 0))
    assert right > best - 0.06 and straight < right - 0.1
    # Among rows said to have a chance of about p, about p have the label.
    p, label = np.array([r.p for r in rows]), np.array([r.label for r in rows])
    bins = (p * 5).astype(int).clip(0, 4)
    error = sum(abs(p[bins == b].sum() - label[bins == b].sum()) for b in range(5)) / len(p)
    assert error < 0.1
    path = scratch_path(spark, "machine")
    save_model(model, path)
    again = sorted(score(load_model(path), test, "classifier", ["id", "label"]).collect())
    assert rows == again


def test_curves(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(-2, 2, size=(500, 2))
    y = np.sin(2 * x[:, 0]) * 0.5 + 0.5
    train, test = frame(spark, x[:400], y[:400]), frame(spark, x[400:], y[400:], 400)
    off = {}
    for name, estimator in (("svr", KernelRegressor(labelCol="label", landmarks=100)), ("line", LinearRegression(labelCol="label"))):
        scored = estimator.fit(train).transform(test)
        off[name] = scored.agg(F.avg(F.abs(F.col("prediction") - F.col("label")))).first()[0]
    assert off["svr"] < 0.1 < off["line"]


def test_awkward_rows(spark):
    one = frame(spark, np.ones((5, 2)), np.ones(5))
    model = KernelClassifier(labelCol="label").fit(one)
    assert {r.prediction for r in model.transform(one).collect()} == {1.0}
    assert model.transform(one.where("id > 9")).count() == 0
    with pytest.raises(ValueError, match="no training rows"):
        KernelRegressor(labelCol="label").fit(one.where("id > 9"))
    unlabelled = one.unionByName(one.withColumn("label", F.lit(None).cast("double")))
    assert KernelRegressor(labelCol="label").fit(unlabelled).transform(one).count() == 5


def test_weights_count_rows(spark):
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(60, 2)), rng.random(60)
    weights = rng.integers(1, 4, 60)
    weighted = frame(spark, x, y).join(spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "id long, w double"), "id")
    repeated = frame(spark, np.repeat(x, weights, axis=0), np.repeat(y, weights))
    settings = {"labelCol": "label", "gamma": 0.5, "landmarks": 60}
    a = KernelRegressor(weightCol="w", **settings).fit(weighted).transform(frame(spark, x, y)).select("id", "prediction").collect()
    b = KernelRegressor(**settings).fit(repeated).transform(frame(spark, x, y)).select("id", "prediction").collect()
    assert np.allclose([r.prediction for r in sorted(a)], [r.prediction for r in sorted(b)], atol=1e-6)
