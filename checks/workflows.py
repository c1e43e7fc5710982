"""Several operators in a row, as they are used together."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerflow.functions.costs import PROFILES, route_by_utility
from answerflow.operators.grading import grade_responses, run_summary
from answerflow.operators.labels import label_complex, label_high_cost
from answerflow.operators.merge import ensemble_accuracy, pairs_from_outcomes
from answerflow.operators.metrics import classification_metrics, confusion_matrix
from answerflow.operators.neighbours import build_tree, knn_classify
from answerflow.operators.ordering import ordered_totals
from answerflow.operators.prep import random_split, stratified_split, with_class_weights
from answerflow.operators.replay import calibrate, calibrated, replay_policies
from answerflow.plans.features import text_features
from answerflow.plans.models import build_estimator, dense_classifier, ensemble, fit_model, score, unit_penalty
from answerflow.session import durable, scratch_path
from answerflow.streaming.jobs import append_available, stream_table
from answerflow.streaming.prompts import route_prompts
from answerflow.streaming.selection import publish_index, select_models
from checks.models import CHECKED, HELD, NEAR, halves, parts
from checks.policy import MODEL, UTILITY
from checks.registry import query
from checks.replay import REPLAY_DOUBLES, replay_sql
from checks.views import table, view

SCORED = replay_sql(f"{UTILITY} = 'llm'").replace(
    "FROM fx_pairs)",
    "FROM (SELECT f.* EXCLUDE (p, kn), k.p AS p FROM (SELECT *, id % (SELECT count(*) FROM k) AS kn FROM fx_pairs) f JOIN k ON k.n = f.kn))",
    1,
)


@query(f"WITH {NEAR.format(label='complex')}, k AS (SELECT row_number() OVER (ORDER BY id) - 1 AS n, avg(y) AS p FROM r WHERE rk <= 5 GROUP BY id),{SCORED[4:]}",
       rounded=REPLAY_DOUBLES)
def replay_with_neighbour_scores(spark, sf_dir):
    train, held = parts(spark, sf_dir)
    pairs = pairs_from_outcomes(view(spark, sf_dir, "fx_outcomes"), "m1", "m2").withColumn(
        "llm_latency", F.col("llm_latency") * 7.0
    )
    # Questions take the scores of the held-out vectors in turn.
    scores = durable(knn_classify(held, train, "complex").select(F.col("id").alias("vector"), "p"))
    scores = ordered_totals(scores, [F.col("vector").asc()], {"n": F.lit(1)}).select("p", (F.col("n") - 1).alias("n"))
    scored = pairs.join(scores, F.col("id") % scores.count() == F.col("n")).drop("n")
    return replay_policies(scored, MODEL, router=route_by_utility(F.col("p"), MODEL))


VECTORS = "vec_id bigint, embedding array<float>, label int"


@query(f"""
WITH {NEAR.format(label='complex')}, k AS (SELECT id, avg(y) AS p FROM r WHERE rk <= 5 GROUP BY id)
SELECT id, p, CASE WHEN p >= 5e-1 THEN 'llm' ELSE 'slm' END AS route FROM k
""", rounded=["p"])
def neighbour_routed_stream(spark, sf_dir):
    train, _ = parts(spark, sf_dir)
    index = scratch_path(spark, "index")
    publish_index(build_tree(train, "complex"), index)
    vectors = stream_table(spark, f"{sf_dir}/embeddings.parquet", VECTORS).withColumnRenamed("vec_id", "id")
    live = random_split(vectors, "id").where("split = 'test'").drop("split")
    return select_models(live, index, use_utility=False).select("id", "p", "route")


VALIDATION = f"(SELECT * FROM fx_pairs WHERE {HELD})"
RATES = f"""
r AS (SELECT avg(slm_correct) FILTER (WHERE p < 5e-1) AS qss, avg(slm_correct) FILTER (WHERE p >= 5e-1) AS qsc,
             avg(llm_correct) FILTER (WHERE p < 5e-1) AS qls, avg(llm_correct) FILTER (WHERE p >= 5e-1) AS qlc,
             avg(slm_latency) AS ls, avg(llm_latency) AS ll, avg(llm_input_tokens) AS ti, avg(llm_output_tokens) AS t_o
      FROM {VALIDATION})
"""
FITTED = """
(SELECT (ti * 125e-8 + t_o * 1e-5) * 1e2 + 13e-2 * ll + 13e0 * (1e0 - ((1e0 - p) * qls + p * qlc))
        < 13e-2 * ls + 13e0 * (1e0 - ((1e0 - p) * qss + p * qsc)) FROM r)
"""


@query(f"WITH {RATES},{replay_sql(FITTED)[4:].replace('FROM fx_pairs)', f'FROM fx_pairs WHERE NOT {HELD})', 1)}", rounded=REPLAY_DOUBLES)
def replay_with_calibrated_costs(spark, sf_dir):
    rows = random_split(view(spark, sf_dir, "fx_pairs"), "id")
    validation, test = rows.where("split = 'test'"), rows.where("split = 'train'")
    rates = calibrate(validation, (F.col("p") >= 0.5).cast("int"), 1 - F.col("slm_correct"))
    # One calibration row becomes the constants of the cost model.
    found = rates.first()
    names = calibrated(MODEL)
    model = MODEL.with_(**{k: found[k] for k in vars(names) if k in rates.columns})
    return replay_policies(test, MODEL, router=route_by_utility(F.col("p"), model))


@query("""
WITH f AS (SELECT id, CASE WHEN slm_accuracy_fraction < 75e-2 THEN 1 ELSE 0 END AS complex, n_correct FROM fx_fraction),
r AS (SELECT *, row_number() OVER (PARTITION BY complex ORDER BY md5('42|' || CAST(id AS STRING))) AS k, count(*) OVER (PARTITION BY complex) AS n FROM f)
SELECT id, complex, n_correct, CASE WHEN k <= round_even(n * 2e-1, 0) THEN 'test' ELSE 'train' END AS split FROM r
""", ints=["complex"])
def labelled_questions(spark, sf_dir):
    runs = view(spark, sf_dir, "fx_outcomes").where(F.col("model").isin("m1", "m2", "m3", "m4"))
    labelled = label_complex(ensemble_accuracy(runs, 4))
    return stratified_split(labelled, ["complex"], "id").select("id", "complex", "n_correct", "split")


def labelled_text(spark, sf_dir):
    """Documents with their quality flag as the label, split by hash."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("question"))
    flags = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("complex"))
    return random_split(docs.join(flags, "id"), "id")


def text_model(train):
    weighted = with_class_weights(train, "complex")
    settings = unit_penalty(train, "logreg", "complex")
    estimator = build_estimator("classifier", "logreg", label="complex", weight="weight", **settings)
    return fit_model(weighted, estimator, text_features().getStages())


@query(f"""
SELECT quality AS actual, count(*) AS n, true AS f1_in_range
FROM (SELECT doc_id AS id, quality FROM documents JOIN labels USING (doc_id)) WHERE {HELD} GROUP BY quality
""", ints=["actual", "n"])
def text_difficulty_metrics(spark, sf_dir):
    rows = labelled_text(spark, sf_dir)
    model = text_model(rows.where("split = 'train'"))
    scored = durable(score(model, rows.where("split = 'test'"), "classifier", ["id", "complex"]))
    cells = confusion_matrix(scored, "complex", "prediction")
    f1 = classification_metrics(scored, "complex", "prediction").select("f1").scalar()
    return cells.groupBy("actual").agg(F.sum("n").alias("n")).where("n > 0").withColumn("f1_in_range", f1.between(0, 1))


@query("SELECT conv_id, turn, true AS routed FROM conversations WHERE role = 'user'")
def live_prompt_routes(spark, sf_dir):
    model = text_model(labelled_text(spark, sf_dir))
    chats = stream_table(spark, f"{sf_dir}/conversations.parquet", "conv_id bigint, turn bigint, role string, text string")
    asked = chats.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    scored = score(model, asked, "classifier", ["conv_id", "turn"])
    routes = append_available(route_prompts(scored, PROFILES["live"]), "live-routes")
    return routes.select("conv_id", "turn", F.col("route").isin("slm", "llm").alias("routed"))


@query(CHECKED)
def high_cost_ensemble(spark, sf_dir):
    """Long answers go with difficult vectors."""
    tokens = F.floor(F.col("difficulty") * 1000).alias("llm_output_tokens")
    train, test = label_high_cost(*[h.select("id", "features", tokens) for h in halves(spark, sf_dir)], percentile=0.95)
    weighted = with_class_weights(train, "high_cost")
    members = [
        build_estimator("classifier", "logreg", label="high_cost", weight="weight", **unit_penalty(train, "logreg", "high_cost")),
        build_estimator("classifier", "svm", label="high_cost", weight="weight", **unit_penalty(train, "svm", "high_cost")),
        dense_classifier((100,), label="high_cost"),
    ]
    scored = durable(ensemble(weighted, test, members, "classifier", ["id", "high_cost"]))
    in_range = F.col("p").between(0, 1) & F.col("prediction").isin(0, 1)
    # The commonest class has 95 of 100 rows: here the rare rows must score higher than the others.
    mean = lambda y: F.avg(F.when(F.col("high_cost") == y, F.col("p")))
    return scored.select("id", in_range.alias("in_range"), scored.agg(mean(1) > mean(0)).scalar().alias("learned"))


@query("""
WITH g AS (SELECT model, category, CASE WHEN error IS NOT NULL THEN 0 ELSE 1 END AS called,
                  CASE WHEN error IS NOT NULL THEN 0e0 ELSE latency END AS latency FROM fx_responses)
SELECT model, count(*) AS n, avg(latency) AS avg_latency, count(*) - sum(called) AS n_failed FROM g GROUP BY model
""", rounded=["avg_latency"], ints=["n_failed"])
def math_run_summary(spark, sf_dir):
    responses = view(spark, sf_dir, "fx_responses").withColumns({"input_tokens": F.lit(1), "output_tokens": F.lit(1)})
    graded = grade_responses(responses, "math", "gold_math")
    return run_summary(graded, ["model"]).select("model", "n", "avg_latency", "n_failed")
