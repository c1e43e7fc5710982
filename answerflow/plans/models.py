"""Difficulty models on Spark MLlib: a catalogue, training, cross-validation and sweeps."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import DataFrame, functions as F

from answerflow.operators.neighbours import knn_classify, knn_regress
from answerflow.operators.metrics import classification_metrics, regression_metrics
from answerflow.operators.ordering import row_hash
from answerflow.operators.prep import augment_minority, downsample_majority, with_class_weights
from answerflow.operators.replay import threshold_sweep
from answerflow.operators.scores import score_to_probability
from answerflow.plans.boosting import BoostedClassifier, BoostedRegressor
from answerflow.plans.kernels import KernelClassifier, KernelRegressor
from answerflow.plans.network import DenseClassifier
from answerflow.session import durable, passing

SEED = 42
# Models whose penalty weighs as much as one row (C = 1, alpha = 1), on unscaled features.
UNIT_PENALTY = ("logreg", "linear_svm", "ridge")

# Model settings (trees 200, iterations 100, learning rates, kernels and their settings,
# leaves and least rows of a leaf, hidden layers 1024-512-64 with their dropout and penalty).
LEVEL_WISE = {"rate": 0.3, "leaves": 64, "depth": 6, "ridge": 1.0, "least_weight": 1.0, "least_rows": 1}
LEAF_WISE = {"rate": 0.1, "leaves": 31, "depth": 0, "ridge": 0.0, "least_weight": 1e-3, "least_rows": 20}
CLASSIFIERS: dict[str, Callable[..., Estimator]] = {
    "logreg": lambda **kw: LogisticRegression(maxIter=100, **kw),
    "rf": lambda **kw: RandomForestClassifier(numTrees=200, seed=SEED, **kw),
    "svm": lambda **kw: KernelClassifier(kernel="poly", degree=3, penalty=1.0, folds=5, **kw),
    "linear_svm": lambda **kw: LinearSVC(maxIter=100, **kw),
    "dt": lambda **kw: DecisionTreeClassifier(seed=SEED, **kw),
    "nb": lambda **kw: NaiveBayes(modelType="gaussian", **kw),
    "gb": lambda **kw: GBTClassifier(maxIter=100, maxDepth=3, seed=SEED, **kw),
    "xgb": lambda **kw: BoostedClassifier(rounds=100, **LEVEL_WISE, **kw),
    "lgb": lambda **kw: BoostedClassifier(rounds=100, **LEAF_WISE, **kw),
}
REGRESSORS: dict[str, Callable[..., Estimator]] = {
    "linear": lambda **kw: LinearRegression(**kw),
    "ridge": lambda **kw: LinearRegression(elasticNetParam=0.0, **kw),
    "huber": lambda **kw: LinearRegression(loss="huber", maxIter=100, **kw),
    "rf": lambda **kw: RandomForestRegressor(numTrees=200, seed=SEED, **kw),
    "dt": lambda **kw: DecisionTreeRegressor(seed=SEED, **kw),
    "gb": lambda **kw: GBTRegressor(maxIter=100, maxDepth=3, seed=SEED, **kw),
    "svr": lambda **kw: KernelRegressor(kernel="rbf", penalty=1.0, epsilon=0.1, **kw),
    "xgb": lambda **kw: BoostedRegressor(rounds=100, **LEVEL_WISE, **kw),
    "lgb": lambda **kw: BoostedRegressor(rounds=100, **LEAF_WISE, **kw),
}


def dense_classifier(hidden: Sequence[int] = (1024, 512, 64), features: str = "features", label: str = "label", **settings) -> Estimator:
    """Feed-forward network with the given hidden layers; dropout after the first two."""
    dropout = [{0: 0.3, 1: 0.2}.get(i, 0.0) for i in range(len(hidden))]
    return DenseClassifier(featuresCol=features, labelCol=label, **({"hidden": list(hidden), "dropout": dropout, "penalty": 1e-4} | settings))


def build_estimator(
    kind: str, name: str, features: str = "features", label: str = "label", weight: str | None = None,
    **settings,
) -> Estimator:
    """A catalogue model; `kind` is `classifier` or `regressor`. `settings` override the defaults."""
    catalogue = {"classifier": CLASSIFIERS, "regressor": REGRESSORS}[kind]
    if name not in catalogue:
        raise ValueError(f"unknown {kind} {name!r}; known: {sorted(catalogue)}")
    estimator = catalogue[name](featuresCol=features, labelCol=label)
    if weight:
        estimator.set(estimator.getParam("weightCol"), weight)
    for key, value in settings.items():
        estimator.set(estimator.getParam(key), value)
    return estimator


def unit_penalty(train: DataFrame, name: str, label: str) -> dict:
    """Settings that make the penalty of a linear model weigh as much as one training row.

    The optimizer averages the loss over the rows and, for linear regression, measures the
    label in standard deviations.
    """
    if name not in UNIT_PENALTY:
        return {}
    rows, spread = train.agg(F.count(F.lit(1)), F.stddev_pop(label)).first()
    return {"regParam": (spread if name == "ridge" else 1.0) / max(rows, 1), "standardization": False}


def fit_model(
    train: DataFrame, estimator: Estimator, stages: Sequence[Estimator] = (), written: bool | str = False
) -> PipelineModel:
    """Fit the stages and the estimator.

    Training passes over the rows many times. They are written out first, so that every pass
    starts from the rows and not from the plan that made them (unless they are `written`
    already), and then cached (unless the caller has done so: `written` is "cached").
    """
    if written == "cached":
        return Pipeline(stages=[*stages, estimator]).fit(train)
    cached = (train if written else durable(train)).persist()
    try:
        return Pipeline(stages=[*stages, estimator]).fit(cached)
    finally:
        cached.unpersist()


def score(model: Model, df: DataFrame, kind: str, keep: Sequence[str] = ("id",)) -> DataFrame:
    """`p` and `prediction` for classifiers, `score` clipped to [0, 1] for regressors."""
    scored = model.transform(df)
    if kind == "classifier":
        return score_to_probability(scored).select(*keep, "p", F.col("prediction").cast("int").alias("prediction"))
    clipped = F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0))
    return scored.select(*keep, clipped.alias("score"))


def train_difficulty_model(
    train: DataFrame,
    test: DataFrame,
    kind: str,
    name: str,
    label: str,
    features: str = "features",
    balance: bool | str = False,
    key: str = "id",
    keep: Sequence[str] = ("id",),
    written: bool | str = False,
    **settings,
) -> tuple[PipelineModel, DataFrame]:
    """Fit one catalogue model and score the test rows.

    `balance` evens out the classes of the training rows: "weights" (or True) by class weights,
    "downsample" by cutting the rows of label 1 to those of label 0, "augment" by adding a noisy
    copy of the rows of the rarer label. `key` identifies the training rows.
    """
    weight = None
    if balance in (True, "weights"):
        train, weight = with_class_weights(train, label), "weight"
    elif balance == "downsample":
        train = downsample_majority(train, label, key)
    elif balance == "augment":
        share = train.agg(F.avg(label)).first()[0] or 0.0
        arrays = train.withColumn(features, vector_to_array(features))
        more = augment_minority(arrays, label, features, key, minority=int(share < 0.5))
        train = more.withColumn(features, array_to_vector(features))
    elif balance:
        raise ValueError(f"unknown way to balance {balance!r}")
    settings = unit_penalty(train, name, label) | settings
    estimator = build_estimator(kind, name, features, label, weight, **settings)
    model = fit_model(train, estimator, written=False if balance else written)
    return model, score(model, test, kind, [*keep, label])


def ensemble(
    train: DataFrame, test: DataFrame, estimators: Sequence[Estimator], kind: str, keep: Sequence[str] = ("id",)
) -> DataFrame:
    """Fit several models and combine them: mean probability, or mean score for regressors.

    All models score the same rows one after the other, so nothing is joined.
    """
    train, scored = durable(train), test
    columns = []
    for i, estimator in enumerate(estimators):
        transformed = fit_model(train, estimator, written=True).transform(scored)
        name = f"_m{i}"
        if kind == "classifier":
            scored = score_to_probability(transformed, name)
        else:
            scored = transformed.withColumn(name, F.col("prediction"))
        scored = scored.drop("rawPrediction", "probability", "prediction")
        columns.append(F.col(name))
    mean = sum(columns, F.lit(0.0)) / F.lit(float(len(columns)))
    if kind == "classifier":
        return scored.select(*keep, mean.alias("p"), (mean > 0.5).cast("int").alias("prediction"))
    return scored.select(*keep, F.least(F.greatest(mean, F.lit(0.0)), F.lit(1.0)).alias("score"))


def grid_search(
    train: DataFrame, estimator: Estimator, grid: list, kind: str, key: str, label: str = "label", folds: int = 5,
    parallelism: int = 4,
) -> CrossValidatorModel:
    """Cross-validated choice by accuracy or by mean absolute error. Folds are fixed by the row key."""
    evaluator = (
        MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
        if kind == "classifier"
        else RegressionEvaluator(labelCol=label, metricName="mae")
    )
    fold = F.pmod(F.conv(F.substring(row_hash(key, SEED), 1, 8), 16, 10).cast("bigint"), F.lit(folds))
    folded = durable(train.withColumn("_fold", fold.cast("int"))).persist()
    try:
        return CrossValidator(
            estimator=estimator, estimatorParamMaps=grid, evaluator=evaluator, numFolds=folds,
            parallelism=parallelism, foldCol="_fold", seed=SEED,
        ).fit(folded)
    finally:
        folded.unpersist()


def sweep(
    encoders: dict[str, tuple[DataFrame, DataFrame]],
    models: Iterable[str],
    kind: str,
    label: str,
    thresholds: Sequence[float] = (0.5, 0.55, 0.6),
    side_by_side: int = 4,
    **settings,
) -> DataFrame:
    """One metrics row per encoder and model over (train, test) frames with `features`.

    `knn` stands for the five nearest neighbours besides the catalogue. Regressors need `slm_correct` in the test frame for the best routing threshold.
    """
    models = list(models)
    keep = ("id",) if kind == "classifier" else ("id", "slm_correct")

    def metrics(train: DataFrame, test: DataFrame, name: str) -> DataFrame:
        if name == "knn":
            scored = neighbours_score(train, test, kind, label, keep)
        else:
            known = {k: v for k, v in settings.items() if build_estimator(kind, name).hasParam(k)}
            _, scored = train_difficulty_model(train, test, kind, name, label, keep=keep, written="cached", **known)
        if kind == "classifier":
            return classification_metrics(scored, label, "prediction").select("n", "accuracy", "f1")
        scored = durable(scored)
        best = threshold_sweep(scored, thresholds).where("is_best = 1")
        return regression_metrics(scored, label, "score").select(
            "n", "mae", "r2",
            best.select("threshold").scalar().alias("threshold"),
            best.select("routing_accuracy").scalar().alias("routing_accuracy"),
        )

    def line(encoder: str, train: DataFrame, test: DataFrame, name: str) -> DataFrame:
        # One row; what the model was made from goes with it.
        with passing(train.sparkSession):
            found = metrics(train, test, name).select(F.lit(encoder).alias("encoder"), F.lit(name).alias("model"), "*")
            return train.sparkSession.createDataFrame(found.collect(), found.schema)

    used, lines = {*keep, label, "features", *(v for v in settings.values() if isinstance(v, str))}, []
    for encoder, (train, test) in encoders.items():
        # The rows are written and held once for all models, which are trained side by side.
        with passing(train.sparkSession):
            train, test = (durable(df.select(*[c for c in df.columns if c in used])) for df in (train, test))
            train.persist()
            try:
                with ThreadPoolExecutor(side_by_side) as pool:
                    lines += pool.map(lambda name: line(encoder, train, test, name), models)
            finally:
                train.unpersist()
    return reduce(DataFrame.unionByName, lines)


def neighbours_score(train: DataFrame, test: DataFrame, kind: str, label: str, keep: Sequence[str]) -> DataFrame:
    """The test rows scored by their nearest training rows."""
    arrays = [df.withColumn("embedding", vector_to_array("features")) for df in (test, train)]
    found = (knn_classify if kind == "classifier" else knn_regress)(*arrays, label)
    return test.select(*keep, label).join(found, "id")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
