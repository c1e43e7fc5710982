from __future__ import annotations

from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, functions as F

from answerflow.operators.metrics import (
    classification_metrics,
    confusion_matrix,
    prediction_spread,
    regression_metrics,
)
from answerflow.operators.prep import random_split
from answerflow.operators.neighbours import knn_classify, knn_regress
from answerflow.operators.scores import score_to_probability, vote
from answerflow.plans.features import fit_pca, vector_column
from answerflow.plans.gaussian import gaussian_bayes
from answerflow.plans.models import (
    CLASSIFIERS,
    REGRESSORS,
    build_estimator,
    dense_classifier,
    fit_model,
    grid_search,
    load_model,
    save_model,
    score,
    sweep,
    train_difficulty_model,
)
from answerflow.session import durable, scratch_path
from checks.registry import query
from checks.views import run_sql, view

# One row in five is held out, by hash.
HELD = "CAST('0x' || substr(md5(concat('42|', CAST(id AS STRING))), 1, 8) AS BIGINT) / 4294967296e0 < 2e-1"
NEAR = f"""
t AS (SELECT id, CAST(embedding AS DOUBLE[]) AS e, {{label}} AS y FROM fx_vectors WHERE NOT {HELD}),
q AS (SELECT id, CAST(embedding AS DOUBLE[]) AS e FROM fx_vectors WHERE {HELD}),
r AS (SELECT q.id, t.y, row_number() OVER (PARTITION BY q.id ORDER BY round(list_distance(q.e, t.e), 9), t.id) AS rk FROM q, t)
"""


def parts(spark, sf_dir):
    """Training and held-out vectors."""
    v = random_split(view(spark, sf_dir, "fx_vectors"), "id")
    return v.where("split = 'train'").drop("split"), v.where("split = 'test'").drop("split")


@query(f"WITH {NEAR.format(label='complex')} SELECT id, avg(y) AS p, CASE WHEN avg(y) > 5e-1 THEN 1 ELSE 0 END AS prediction FROM r WHERE rk <= 5 GROUP BY id",
       rounded=["p"], ints=["prediction"])
def knn_classifier(spark, sf_dir):
    train, held = parts(spark, sf_dir)
    return knn_classify(held, train, "complex")


@query(f"WITH {NEAR.format(label='difficulty')} SELECT id, avg(y) AS score FROM r WHERE rk <= 5 GROUP BY id", rounded=["score"])
def knn_regressor(spark, sf_dir):
    train, held = parts(spark, sf_dir)
    return knn_regress(held, train, "difficulty")


@query(f"""
WITH x AS (SELECT id, complex, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM fx_vectors),
train AS (SELECT * FROM x WHERE NOT {HELD}),
eps AS (SELECT max(v) * 1e-9 AS eps FROM (SELECT var_pop(x) AS v FROM train GROUP BY i)),
m AS (SELECT complex, i, avg(x) AS mu, var_pop(x) + (SELECT eps FROM eps) AS v FROM train GROUP BY complex, i),
prior AS (SELECT complex, ln(count(*) / CAST((SELECT count(DISTINCT id) FROM train) AS DOUBLE)) AS lp
          FROM (SELECT DISTINCT id, complex FROM train) GROUP BY complex),
ll AS (SELECT x.id, m.complex, -5e-1 * sum(ln(2e0 * pi() * m.v) + (x.x - m.mu) * (x.x - m.mu) / m.v) AS ll
       FROM x JOIN m ON x.i = m.i WHERE x.id IN (SELECT id FROM fx_vectors WHERE {HELD}) GROUP BY x.id, m.complex),
j AS (SELECT a.id, (a.ll + p0.lp) - (b.ll + p1.lp) AS gap FROM ll a JOIN ll b ON a.id = b.id AND a.complex = 0 AND b.complex = 1
      JOIN prior p0 ON p0.complex = 0 JOIN prior p1 ON p1.complex = 1)
SELECT id, 1e0 / (1e0 + exp(least(gap, 700e0))) AS p, CASE WHEN gap < 0 THEN 1 ELSE 0 END AS prediction FROM j
""", rounded=["p"], ints=["prediction"])
def gaussian_bayes_classifier(spark, sf_dir):
    train, held = parts(spark, sf_dir)
    return gaussian_bayes(train, held, "complex")


def halves(spark, sf_dir):
    """Training and held-out vectors with labels that can be learned from them (those of the table
    are unrelated)."""
    lean = F.col("embedding")[0].cast("double") + F.col("embedding")[1].cast("double") / 2
    labels = {
        "complex": (lean > 0).cast("int"),
        "difficulty": F.least(F.greatest(0.5 + 2 * lean, F.lit(0.0)), F.lit(1.0)),
        "slm_correct": (lean <= 0).cast("int"),
    }
    return tuple(vector_column(part).withColumns(labels) for part in parts(spark, sf_dir))


# What can be said of a model in SQL: every held-out row is scored, within range, and the model does
# no worse than the commonest class, or the mean.
CHECKED = f"SELECT id, true AS in_range, true AS learned FROM fx_vectors WHERE {HELD}"


def checked(scored, kind: str, label: str):
    if kind == "classifier":
        in_range = F.col("p").between(0, 1) & F.col("prediction").isin(0, 1)
        better = F.avg((F.col("prediction") == F.col(label)).cast("double")) >= F.greatest(F.avg(label), 1 - F.avg(label))
    else:
        in_range = F.col("score").between(0, 1)
        better = F.avg(F.pow(F.col("score") - F.col(label), F.lit(2))) <= F.var_pop(label)
    # The scores are looked at twice.
    scored = durable(scored)
    return scored.select("id", in_range.alias("in_range"), scored.agg(better).scalar().alias("learned"))


TRAINED = f"SELECT *, CAST(embedding AS DOUBLE[]) AS e FROM fx_vectors WHERE NOT {HELD}"
COUNTS = {"n_train": f"SELECT count(*) FROM ({TRAINED})", "n_held": f"SELECT count(*) FROM fx_vectors WHERE {HELD}"}
COUNTS |= {"n_in_range": COUNTS["n_held"], "learned": "SELECT 1"}
# The labels of `halves` in SQL.
LEAN = "CASE WHEN e[1] + e[2] / 2e0 > 0 THEN 1 ELSE 0 END"
DIFFICULTY = "least(greatest(5e-1 + 2e0 * (e[1] + e[2] / 2e0), 0e0), 1e0)"


def first_split(label: str, curvature: str, ridge: float, least_weight: float, least_rows: int) -> str:
    """Feature (from 0) and cut of the split with the largest gain for the first tree, over all cuts."""
    return f"""
WITH t AS (SELECT e, {label} AS y FROM ({TRAINED})),
m AS (SELECT avg(y) AS p, count(*) AS n FROM t),
x AS (SELECT unnest(e) AS v, generate_subscripts(e, 1) - 1 AS f, m.p - y AS g, {curvature} AS h FROM t, m),
q AS (SELECT f, unnest(list_distinct(quantile_disc(v, [{", ".join(f"{i} / 64e0" for i in range(1, 64))}]))) AS cut FROM x GROUP BY f),
s AS (SELECT f, sum(g) AS g, sum(h) AS h, count(*) AS n FROM x GROUP BY f),
l AS (SELECT q.f, cut, sum(x.g) AS g, sum(x.h) AS h, count(*) AS n FROM q JOIN x ON x.f = q.f AND x.v <= q.cut GROUP BY q.f, cut),
w AS (
  SELECT l.f, cut, l.g * l.g / (l.h + {ridge}) + (s.g - l.g) * (s.g - l.g) / (s.h - l.h + {ridge}) - s.g * s.g / (s.h + {ridge}) AS gain
  FROM l JOIN s ON s.f = l.f
  WHERE l.n >= {least_rows} AND s.n - l.n >= {least_rows} AND l.h >= {least_weight} AND s.h - l.h >= {least_weight})
SELECT {{}} FROM w ORDER BY round(gain, 9) DESC, f, cut LIMIT 1"""


LEVEL, LEAF = (1.0, 1.0, 1), (0.0, 1e-3, 20)  # ridge, least curvature, least rows
# What is read back from a fitted model, and what SQL says it must be.
SETTINGS: dict[tuple[str, str], dict[str, str]] = {
    ("classifier", "rf"): {"trees": "SELECT 200"}, ("regressor", "rf"): {"trees": "SELECT 200"},
    ("classifier", "gb"): {"trees": "SELECT 100"}, ("regressor", "gb"): {"trees": "SELECT 100"},
    ("classifier", "dt"): {"features": "SELECT 64"}, ("regressor", "dt"): {"features": "SELECT 64"},
    ("classifier", "logreg"): {"coefficients": "SELECT 64"}, ("classifier", "linear_svm"): {"coefficients": "SELECT 64"},
    ("regressor", "linear"): {"coefficients": "SELECT 64"}, ("regressor", "ridge"): {"coefficients": "SELECT 64"},
    ("regressor", "huber"): {"coefficients": "SELECT 64"},
}
for _name, _settings in (("xgb", LEVEL), ("lgb", LEAF)):
    for _kind, _split in (("classifier", first_split(LEAN, "m.p * (1 - m.p)", *_settings)), ("regressor", first_split(DIFFICULTY, "1e0", *_settings))):
        SETTINGS[_kind, _name] = {"trees": "SELECT 100", "first_feature": _split.format("f"), "first_cut": _split.format("cut")}
MACHINE = {
    "landmarks": f"SELECT least(count(*), 256) FROM (SELECT DISTINCT e FROM ({TRAINED}))",
    "gamma": f"SELECT 1e0 / (64 * var_pop(v)) FROM (SELECT unnest(e) AS v FROM ({TRAINED}))",
}
SETTINGS["classifier", "svm"] = MACHINE | {"degree": "SELECT 3"}
SETTINGS["regressor", "svr"] = MACHINE


def read_back(model) -> dict[str, float]:
    """What a fitted model says of itself."""
    if hasattr(model, "arrays"):
        learned = model.arrays()
        if "trees" in learned:
            return {"trees": len(learned["offsets"]) - 1, "first_feature": learned["trees"][0][0], "first_cut": learned["trees"][0][2]}
        if "landmarks" in learned:
            return {"landmarks": len(learned["landmarks"]), "gamma": learned["gamma"], "degree": learned["degree"]}
        return {f"layer_{i}": learned[f"w{i}"].shape[1] for i in range(int(learned["layers"]))}
    if hasattr(model, "getNumTrees"):
        return {"trees": model.getNumTrees}
    return {"coefficients": len(model.coefficients)} if hasattr(model, "coefficients") else {"features": model.numFeatures}


def as_items(items: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS item, CAST(({v}) AS DOUBLE) AS value" for k, v in (COUNTS | items).items())


def described(spark, train, model, scored, kind: str, label: str, wanted) -> DataFrame:
    """Rows (item, value): counts, what the model says of itself, and whether it learned."""
    looked = checked(scored, kind, label)
    n, inside, learned = looked.agg(F.count(F.lit(1)), F.count_if(F.col("in_range")), F.min(F.col("learned").cast("int"))).first()
    said = read_back(model.stages[-1])
    items = {"n_train": train.count(), "n_held": n, "n_in_range": inside, "learned": learned} | {k: said[k] for k in wanted}
    return spark.createDataFrame([(k, float(v)) for k, v in items.items()], "item string, value double")


# Models of which every held-out row is returned, with what the model says of itself beside it.
EVERY_ROW = {
    ("classifier", "rf"),
    ("regressor", "linear"),
    ("regressor", "ridge"),
    ("regressor", "huber"),
    ("regressor", "rf"),
    ("regressor", "gb"),
}


def numbers_beside(items: dict[str, str]) -> dict[str, str]:
    return {k: v for k, v in (COUNTS | items).items() if k != "learned"}


def as_columns(items: dict[str, str]) -> str:
    numbers = ", ".join(f"CAST(({v}) AS DOUBLE) AS {k}" for k, v in numbers_beside(items).items())
    return f"SELECT id, true AS in_range, true AS learned, {numbers} FROM fx_vectors WHERE {HELD}"


def every_row(train, model, scored, kind: str, label: str, wanted) -> DataFrame:
    """The rows of `checked` with the numbers of `described` beside each."""
    looked = durable(checked(scored, kind, label))
    n, inside = looked.agg(F.count(F.lit(1)), F.count_if(F.col("in_range"))).first()
    said = read_back(model.stages[-1])
    numbers = {"n_train": train.count(), "n_held": n, "n_in_range": inside} | {k: said[k] for k in wanted}
    return looked.select("*", *[F.lit(float(v)).alias(k) for k, v in numbers.items()])


def register_model(kind: str, name: str, label: str) -> None:
    wanted = SETTINGS.get((kind, name))
    if wanted is None:
        def run(spark, sf_dir):
            train, test = halves(spark, sf_dir)
            _, scored = train_difficulty_model(train, test, kind, name, label)
            return checked(scored, kind, label)

        sql, rounded = CHECKED, []
    else:
        def run(spark, sf_dir):
            train, test = halves(spark, sf_dir)
            model, scored = train_difficulty_model(
                train, test, kind, name, label, balance=kind == "classifier" and name == "logreg"
            )
            if (kind, name) in EVERY_ROW:
                return every_row(train, model, scored, kind, label, wanted)
            return described(spark, train, model, scored, kind, label, wanted)

        sql, rounded = as_items(wanted), ["value"]
        if (kind, name) in EVERY_ROW:
            sql, rounded = as_columns(wanted), list(numbers_beside(wanted))
    run.__name__ = f"{name}_{kind}"
    query(sql, rounded=rounded)(run)


for _name in CLASSIFIERS:
    register_model("classifier", _name, "complex")
for _name in REGRESSORS:
    register_model("regressor", _name, "difficulty")


def register_balanced(balance: str) -> None:
    def run(spark, sf_dir):
        train, test = halves(spark, sf_dir)
        # Two of three rows of label 0 go, so there is something to even out.
        train = train.where((F.col("complex") == 1) | (F.col("id") % 3 == 0))
        _, scored = train_difficulty_model(train, test, "classifier", "logreg", "complex", balance=balance)
        return checked(scored, "classifier", "complex")

    run.__name__ = f"classifier_balanced_by_{balance}"
    query(CHECKED)(run)


for _balance in ("weights", "downsample", "augment"):
    register_balanced(_balance)


LAYERS = {f"layer_{i}": f"SELECT {n}" for i, n in enumerate((1024, 512, 64, 1))}


@query(as_columns(LAYERS), rounded=list(numbers_beside(LAYERS)))
def dense_network_classifier(spark, sf_dir):
    train, test = halves(spark, sf_dir)
    model = fit_model(train, dense_classifier(label="complex"))
    scored = score(model, test, "classifier", ["id", "complex"])
    return every_row(train, model, scored, "classifier", "complex", LAYERS)


@query(CHECKED)
def cross_validated_grid(spark, sf_dir):
    train, test = halves(spark, sf_dir)
    estimator = build_estimator("classifier", "logreg", label="complex")
    grid = ParamGridBuilder().addGrid(estimator.regParam, [0.0, 0.01, 0.1, 1.0]).build()
    best = grid_search(train, estimator, grid, "classifier", "id", "complex")
    return checked(score(best.bestModel, test, "classifier", ["id", "complex"]), "classifier", "complex")


def two_encoders(spark, sf_dir):
    """The given vectors, and half as many dimensions of them."""
    train, test = halves(spark, sf_dir)
    projection = fit_pca(train, 32)

    def projected(df):
        return projection.transform(df).drop("features").withColumnRenamed("pca_features", "features")

    return {"given": (train, test), "projected": (projected(train), projected(test))}


def swept(kind: str, names) -> str:
    rows = " UNION ALL ".join(f"SELECT '{e}' AS encoder, '{n}' AS model" for e in ("given", "projected") for n in names)
    return f"SELECT encoder, model, (SELECT count(*) FROM fx_vectors WHERE {HELD}) AS n, true AS in_range FROM ({rows})"


# All models but the presets of boosted trees, which take as long as all others together.
SWEPT_CLASSIFIERS = ("logreg", "rf", "svm", "dt", "nb", "gb", "knn")
SWEPT_REGRESSORS = ("linear", "ridge", "huber", "rf", "dt", "gb", "knn")


@query(swept("classifier", SWEPT_CLASSIFIERS))
def classifier_sweep(spark, sf_dir):
    lines = sweep(two_encoders(spark, sf_dir), SWEPT_CLASSIFIERS, "classifier", "complex")
    return lines.select("encoder", "model", "n", (F.col("accuracy").between(0, 1) & F.col("f1").between(0, 1)).alias("in_range"))


@query(swept("regressor", SWEPT_REGRESSORS))
def regressor_sweep(spark, sf_dir):
    lines = sweep(two_encoders(spark, sf_dir), SWEPT_REGRESSORS, "regressor", "difficulty")
    right = F.col("mae").between(0, 1) & (F.col("r2") <= 1) & F.col("threshold").isin(0.5, 0.55, 0.6) & F.col("routing_accuracy").between(0, 1)
    return lines.select("encoder", "model", "n", right.alias("in_range"))


@query(f"SELECT id, true AS same FROM fx_vectors WHERE {HELD}")
def stored_model(spark, sf_dir):
    train, test = halves(spark, sf_dir)
    path = scratch_path(spark, "model")
    kept = fit_model(train, build_estimator("classifier", "dt", label="complex"))
    save_model(kept, path)
    a, b = score(kept, test, "classifier"), score(load_model(path), test, "classifier")
    b = b.select(F.col("id").alias("of"), F.col("p").alias("q"), F.col("prediction").alias("again"))
    return a.join(b, F.col("id") == F.col("of")).select(
        "id", ((F.col("p") == F.col("q")) & (F.col("prediction") == F.col("again"))).alias("same")
    )


# Three score tables per question, all derived from the pair view.
SCORES = "SELECT id, p AS p1, 1e0 - p AS p2, slm_latency / 5e0 AS p3 FROM fx_pairs"


@query(f"""
SELECT id, (p1 + p2 + p3) / 3e0 AS p, CASE WHEN (p1 + p2 + p3) / 3e0 > 5e-1 THEN 1 ELSE 0 END AS soft,
       CASE WHEN (CASE WHEN p1 > 5e-1 THEN 1 ELSE 0 END) + (CASE WHEN p2 > 5e-1 THEN 1 ELSE 0 END)
               + (CASE WHEN p3 > 5e-1 THEN 1 ELSE 0 END) >= 2 THEN 1 ELSE 0 END AS hard,
       (p1 + p2) / 2e0 AS mean
FROM ({SCORES})
""", rounded=["p", "mean"], ints=["soft", "hard"])
def voted_scores(spark, sf_dir):
    # Written once: the tables would each make the pairs again, all in the tasks of the last join.
    scores = durable(run_sql(spark, sf_dir, SCORES))
    tables = [scores.select("id", F.col(f"p{i}").alias("p")) for i in (1, 2, 3)]
    soft = vote(tables, "soft").withColumnRenamed("prediction", "soft")
    hard = vote(tables, "hard").withColumnRenamed("prediction", "hard")
    mean = vote(tables[:2], "mean").withColumnRenamed("score", "mean")
    return soft.join(hard, "id").join(mean, "id")


@query("""
SELECT id, 1e0 / (1e0 + exp(-(slm_latency - 25e-1))) AS from_margin, CAST(slm_correct AS DOUBLE) AS from_label FROM fx_pairs
""", rounded=["from_margin", "from_label"])
def probabilities_from_scores(spark, sf_dir):
    pairs = view(spark, sf_dir, "fx_pairs").select(
        "id", (F.col("slm_latency") - 2.5).alias("margin"), F.col("slm_correct").alias("prediction")
    )
    margins = score_to_probability(pairs.select("id", "margin"), "from_margin").drop("margin")
    labels = score_to_probability(pairs.select("id", "prediction"), "from_label").drop("prediction")
    return margins.join(labels, "id")


PREDICTED = "SELECT id, dataset_name, 1 - slm_correct AS y, CASE WHEN p >= 5e-1 THEN 1 ELSE 0 END AS z FROM fx_pairs"


@query(f"""
WITH c AS (SELECT dataset_name, count(*) AS n, sum(CASE WHEN y = z THEN 1 ELSE 0 END) AS ok,
           sum(CASE WHEN y = 1 AND z = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y = 0 AND z = 1 THEN 1 ELSE 0 END) AS fp,
           sum(CASE WHEN y = 1 AND z = 0 THEN 1 ELSE 0 END) AS fn FROM ({PREDICTED}) GROUP BY dataset_name)
SELECT dataset_name, n, ok / CAST(n AS DOUBLE) AS accuracy, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS precision,
       coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS recall,
       coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0) AS f1
FROM c
""", rounded=["accuracy", "precision", "recall", "f1"])
def classification_quality(spark, sf_dir):
    return classification_metrics(run_sql(spark, sf_dir, PREDICTED), "y", "z", ["dataset_name"])


@query(f"""
WITH g AS (SELECT a.x AS actual, b.x AS predicted FROM (SELECT unnest([0, 1, 2]) AS x) a, (SELECT unnest([0, 1, 2]) AS x) b),
c AS (SELECT y, z, count(*) AS n FROM ({PREDICTED}) GROUP BY y, z)
SELECT actual, predicted, coalesce(n, 0) AS n,
       coalesce(coalesce(n, 0) * 1e2 / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY actual), 0), 0) AS row_pct
FROM g LEFT JOIN c ON y = actual AND z = predicted
""", rounded=["row_pct"], ints=["actual", "predicted", "n"])
def confusion_cells(spark, sf_dir):
    return confusion_matrix(run_sql(spark, sf_dir, PREDICTED), "y", "z", [0, 1, 2])


ESTIMATED = """
SELECT f.id AS id, round(1e0 - f.slm_accuracy_fraction, 2) AS actual, o.latency / 4e0 - 1e-1 AS predicted
FROM fx_fraction f JOIN fx_outcomes o ON o.id = f.id WHERE o.model = 'm1'
"""


@query(f"""
WITH c AS (SELECT actual, least(greatest(predicted, 0e0), 1e0) AS z FROM ({ESTIMATED}))
SELECT count(*) AS n, avg(abs(actual - z)) AS mae,
       1e0 - sum((actual - z) * (actual - z)) / (var_pop(actual) * count(*)) AS r2 FROM c
""", rounded=["mae", "r2"])
def regression_quality(spark, sf_dir):
    return regression_metrics(run_sql(spark, sf_dir, ESTIMATED), "actual", "predicted")


@query(f"""
WITH e AS ({ESTIMATED}),
b AS (SELECT actual, count(*) AS n, quantile_cont(predicted, 25e-2) AS q1, quantile_cont(predicted, 5e-1) AS median,
             quantile_cont(predicted, 75e-2) AS q3 FROM e GROUP BY actual)
SELECT b.actual, any_value(n) AS n, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
       min(CASE WHEN predicted >= q1 - 15e-1 * (q3 - q1) THEN predicted END) AS low,
       max(CASE WHEN predicted <= q3 + 15e-1 * (q3 - q1) THEN predicted END) AS high
FROM b JOIN e ON b.actual = e.actual GROUP BY b.actual
""", rounded=["actual", "q1", "median", "q3", "low", "high"])
def prediction_boxes(spark, sf_dir):
    return prediction_spread(run_sql(spark, sf_dir, ESTIMATED), "actual", "predicted")


@query(f"""
WITH two AS (SELECT id, 'one' AS set_name, p FROM fx_pairs UNION ALL SELECT id, 'two', 1e0 - p FROM fx_pairs)
SELECT id, set_name, (p + p / 2e0) / 2e0 AS p, CASE WHEN (p + p / 2e0) / 2e0 > 5e-1 THEN 1 ELSE 0 END AS prediction FROM two
""", rounded=["p"], ints=["prediction"])
def voted_scores_of_two_sets(spark, sf_dir):
    two = durable(run_sql(spark, sf_dir, """
        SELECT id, 'one' AS set_name, p FROM fx_pairs UNION ALL SELECT id, 'two', 1e0 - p FROM fx_pairs"""))
    return vote([two, two.withColumn("p", F.col("p") / 2)], "soft", ["id", "set_name"])
