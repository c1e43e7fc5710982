"""Models learn, repeat themselves and survive storage."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerflow.operators.metrics import classification_metrics
from answerflow.operators.prep import augment_minority
from answerflow.plans.features import encode, fit_pca, text_features, vector_column
from answerflow.plans.models import (
    build_estimator,
    ensemble,
    fit_model,
    load_model,
    save_model,
    score,
    sweep,
    train_difficulty_model,
)
from answerflow.session import scratch_path, shared_dir


@pytest.fixture(scope="module")
def halves(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        y = i % 2
        v = rng.normal(size=6) + (1.5 if y else -1.5)
        rows.append((i, [float(x) for x in v], y, 0.8 if y else 0.2, 1 - y))
    df = vector_column(spark.createDataFrame(rows, "id int, embedding array<double>, complex int, difficulty double, slm_correct int"))
    return df.where("id < 300").cache(), df.where("id >= 300").cache()


@pytest.mark.parametrize("name", ["logreg", "rf", "svm", "linear_svm", "dt", "nb", "gb", "xgb", "lgb"])
def test_classifiers_separate(halves, name):
    settings = {"rf": {"numTrees": 10}, "gb": {"maxIter": 5}, "xgb": {"rounds": 5}, "lgb": {"rounds": 10}}.get(name, {})
    _, scored = train_difficulty_model(*halves, "classifier", name, "complex", **settings)
    rows = scored.collect()
    assert len(rows) == 100 and all(0 <= r.p <= 1 for r in rows)
    assert classification_metrics(scored, "complex", "prediction").first().accuracy > 0.9


@pytest.mark.parametrize("name", ["linear", "ridge", "huber", "svr", "dt"])
def test_regressors_stay_in_range(halves, name):
    _, scored = train_difficulty_model(*halves, "regressor", name, "difficulty")
    assert scored.where("score < 0 OR score > 1").count() == 0
    assert scored.agg(F.avg(F.abs(F.col("score") - F.col("difficulty")))).first()[0] < 0.2


def test_penalties_weigh_as_much_as_one_row(halves):
    rows = halves[0].select("embedding", "difficulty", "complex").collect()
    x = np.array([r.embedding for r in rows])
    y = np.array([r.difficulty for r in rows])
    z = np.array([r.complex for r in rows])
    centred = x - x.mean(axis=0)
    ridge, _ = train_difficulty_model(*halves, "regressor", "ridge", "difficulty")
    want = np.linalg.solve(centred.T @ centred + np.eye(x.shape[1]), centred.T @ (y - y.mean()))
    assert np.allclose(ridge.stages[-1].coefficients.toArray(), want, atol=1e-8)

    logreg, _ = train_difficulty_model(*halves, "classifier", "logreg", "complex")
    w, b = logreg.stages[-1].coefficients.toArray(), logreg.stages[-1].intercept
    # At the optimum of sum(log loss) + |w|^2 / 2 the gradient vanishes.
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.allclose(x.T @ (p - z) + w, 0, atol=0.05) and abs((p - z).sum()) < 0.05


def test_storage(spark, halves):
    model = fit_model(halves[0], build_estimator("classifier", "logreg", label="complex"))
    path = scratch_path(spark, "model")
    save_model(model, path)
    a = {r.id: r.p for r in score(model, halves[1], "classifier").collect()}
    b = {r.id: r.p for r in score(load_model(path), halves[1], "classifier").collect()}
    assert a == b


def test_sweep_rows(halves):
    rows = sweep({"e": halves}, ["linear", "dt"], "regressor", "difficulty").collect()
    assert {(r.encoder, r.model) for r in rows} == {("e", "linear"), ("e", "dt")}
    assert all(r.routing_accuracy > 0.9 and r.threshold in (0.5, 0.55, 0.6) for r in rows)


def test_sweep_leaves_nothing_behind(spark, halves):
    """What a model of a sweep was made from goes with it, and the rows of an encoder with the encoder."""
    def written():
        return {p.name for p in Path(shared_dir(spark).removeprefix("file:")).glob("rows-*")}

    before = written()
    lines = sweep({"e": halves}, ["logreg", "svm", "knn"], "classifier", "complex")
    assert written() == before
    rows = {r.model: r for r in lines.collect()}
    assert set(rows) == {"logreg", "svm", "knn"} and all(r.n == halves[1].count() and r.accuracy > 0.8 for r in rows.values())


def test_sweep_keeps_the_columns_of_its_settings(halves):
    train, test = halves
    train = train.drop("slm_correct").withColumn("w", F.when(F.col("difficulty") > 0.5, 1.0).otherwise(0.0))
    (row,) = sweep({"e": (train, test)}, ["linear"], "regressor", "difficulty", weightCol="w").collect()
    # Only rows of one label count, so all are predicted to be it.
    assert row.mae == pytest.approx(test.agg(F.avg(0.8 - F.col("difficulty"))).first()[0], abs=1e-3)


def test_balanced_training(halves):
    train = halves[0].where("complex = 0 OR id < 30")
    _, scored = train_difficulty_model(train, halves[1], "classifier", "logreg", "complex", balance=True)
    assert classification_metrics(scored, "complex", "prediction").first().recall > 0.9


def test_projection_is_centred(halves):
    projected = fit_pca(halves[0], 2).transform(halves[0])
    from pyspark.ml.functions import vector_to_array

    means = projected.select(vector_to_array("pca_features").alias("v")).agg(
        F.avg(F.col("v")[0]), F.avg(F.col("v")[1])
    ).first()
    assert np.allclose(means, 0, atol=1e-9)


def test_text_features_have_unit_length(spark):
    df = spark.createDataFrame([(1, "One two three"), (2, "two THREE four"), (3, "")], "id int, question string")
    rows = {r.id: r.features for r in text_features(dims=64).fit(df).transform(df).collect()}
    assert np.isclose(np.linalg.norm(rows[1].toArray()), 1.0)
    assert rows[3].numNonzeros() == 0


def test_encoder_is_batched_and_normalized(spark):
    def make():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([("abc",), ("",)], "question string")
    rows = {r.question: r.embedding for r in encode(df, "question", make).collect()}
    assert np.allclose(rows["abc"], np.array([3, 1]) / np.sqrt(10))
    assert np.allclose(rows[""], [0, 1])


def test_noise_is_normal_and_repeatable(spark):
    df = spark.range(200).select("id", F.lit(0).alias("y"), F.array_repeat(F.lit(0.0), 50).alias("embedding"))
    grown = augment_minority(df, "y", "embedding", "id", factor=2, noise_std=2.0).where("copy = 1")
    a = {r.id: r.embedding for r in grown.collect()}
    b = {r.id: r.embedding for r in augment_minority(df.repartition(5), "y", "embedding", "id", factor=2, noise_std=2.0).where("copy = 1").collect()}
    assert a == b
    values = np.array(list(a.values())).ravel()
    assert abs(values.mean()) < 0.1 and abs(values.std() - 2.0) < 0.1
    assert abs(np.mean(np.abs(values) < 2.0) - 0.6827) < 0.02


def test_ensemble_is_the_mean_of_its_members(halves):
    members = [build_estimator("classifier", n, label="complex") for n in ("logreg", "nb")]
    together = {r.id: r.p for r in ensemble(*halves, members, "classifier").collect()}
    single = [{r.id: r.p for r in score(fit_model(halves[0], m), halves[1], "classifier").collect()} for m in members]
    assert all(np.isclose(p, (single[0][i] + single[1][i]) / 2) for i, p in together.items())
    assert len(together) == 100
