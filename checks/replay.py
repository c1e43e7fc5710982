from __future__ import annotations

from pyspark.sql import functions as F

from answerflow.functions.costs import route_by_score, route_by_utility
from answerflow.operators.replay import (
    actual_cost_fit,
    average_quality,
    baseline_errors,
    by_decision_summary,
    calibrate,
    calibrated,
    conditional_means,
    cost_curve,
    curve_crossing,
    plotted_points,
    policy_detail,
    predicted_error,
    replay_policies,
    routing_confusion,
    score_histogram,
    slm_routing_accuracy,
    subset_counterfactual,
    threshold_sweep,
)
from checks.policy import LLM_ERROR, MEAN_USD, MODEL, P_STAR, Q_LLM, Q_SLM, SLM_ERROR, USD, UTILITY, rates
from checks.registry import query
from checks.views import view

PAIRS = f"c AS (SELECT *, {USD} AS usd, {SLM_ERROR} AS se, {LLM_ERROR} AS le FROM fx_pairs)"


def policy_sql(policy: str, big: str) -> str:
    def pick(llm: str, slm: str) -> str:
        return f"avg(CASE WHEN {big} THEN {llm} ELSE {slm} END)"

    return f"""
    SELECT dataset_name, '{policy}' AS policy, count(*) AS n, count(*) FILTER (WHERE {big}) AS n_llm,
           count(*) FILTER (WHERE {big}) * 1e2 / count(*) AS llm_pct, {pick('llm_correct', 'slm_correct')} AS accuracy,
           {pick('llm_latency', 'slm_latency')} AS avg_latency, {pick('usd', '0e0')} * 1e2 AS avg_cents,
           {pick('le', 'se')} AS avg_error
    FROM c GROUP BY dataset_name"""


def replay_sql(router: str) -> str:
    rules = {
        "router": router, "oracle": "slm_correct = 0", "oracle_cost": "NOT se <= le", "all_slm": "false", "all_llm": "true",
    }
    return f"WITH {PAIRS}\n" + "\nUNION ALL\n".join(policy_sql(p, big) for p, big in rules.items())


REPLAY_DOUBLES = ["llm_pct", "accuracy", "avg_latency", "avg_cents", "avg_error"]


@query(replay_sql("p > 5e-1"), rounded=REPLAY_DOUBLES)
def policy_replay(spark, sf_dir):
    return replay_policies(view(spark, sf_dir, "fx_pairs"), MODEL)


@query(replay_sql(f"{UTILITY} = 'llm'"), rounded=REPLAY_DOUBLES)
def policy_replay_by_utility(spark, sf_dir):
    return replay_policies(view(spark, sf_dir, "fx_pairs"), MODEL, router=route_by_utility(F.col("p"), MODEL))


@query(f"""
WITH {PAIRS}
SELECT dataset_name, count(*) FILTER (WHERE slm_correct = 1 AND p <= 5e-1) AS slm_slm,
       count(*) FILTER (WHERE slm_correct = 1 AND p > 5e-1) AS slm_llm,
       count(*) FILTER (WHERE slm_correct = 0 AND p <= 5e-1) AS llm_slm,
       count(*) FILTER (WHERE slm_correct = 0 AND p > 5e-1) AS llm_llm,
       count(*) FILTER (WHERE slm_correct = 0 AND p <= 5e-1) AS missed_escalations,
       count(*) FILTER (WHERE slm_correct = 1 AND p > 5e-1) AS failed_escalations,
       coalesce(sum(usd) FILTER (WHERE slm_correct = 1 AND p > 5e-1), 0) * 1e2 AS wasted_cents,
       coalesce(sum(llm_latency - slm_latency) FILTER (WHERE slm_correct = 1 AND p > 5e-1), 0) AS wasted_seconds
FROM c GROUP BY dataset_name
""", rounded=["wasted_cents", "wasted_seconds"], digits=4)
def routing_confusion_per_domain(spark, sf_dir):
    return routing_confusion(view(spark, sf_dir, "fx_pairs"), MODEL)


def sides():
    """Predicted and actual complexity."""
    return (F.col("p") >= 0.5).cast("int"), 1 - F.col("slm_correct")


def mean(x: str, where: str) -> str:
    return f"coalesce(avg({x}) FILTER (WHERE {where}), 0)"


@query(f"""
SELECT dataset_name, count(*) AS n, count(*) FILTER (WHERE p < 5e-1) AS n_simple, count(*) FILTER (WHERE p >= 5e-1) AS n_complex,
       {mean('slm_correct', 'p < 5e-1')} AS q_slm_simple, {mean('slm_correct', 'p >= 5e-1')} AS q_slm_complex,
       {mean('llm_correct', 'p < 5e-1')} AS q_llm_simple, {mean('llm_correct', 'p >= 5e-1')} AS q_llm_complex,
       avg(slm_latency) AS slm_latency, avg(slm_input_tokens) AS slm_input_tokens, avg(slm_output_tokens) AS slm_output_tokens,
       avg(llm_latency) AS llm_latency, avg(llm_input_tokens) AS llm_input_tokens, avg(llm_output_tokens) AS llm_output_tokens,
       count(*) FILTER (WHERE slm_correct = 1 AND p < 5e-1) AS simple_as_simple,
       count(*) FILTER (WHERE slm_correct = 1 AND p >= 5e-1) AS simple_as_complex,
       count(*) FILTER (WHERE slm_correct = 0 AND p < 5e-1) AS complex_as_simple,
       count(*) FILTER (WHERE slm_correct = 0 AND p >= 5e-1) AS complex_as_complex
FROM fx_pairs GROUP BY dataset_name
""", rounded=["q_slm_simple", "q_slm_complex", "q_llm_simple", "q_llm_complex", "slm_latency", "slm_input_tokens",
              "slm_output_tokens", "llm_latency", "llm_input_tokens", "llm_output_tokens"])
def calibration(spark, sf_dir):
    return calibrate(view(spark, sf_dir, "fx_pairs"), *sides(), ["dataset_name"])


@query("\nUNION ALL\n".join(f"""
SELECT '{side}_{name}' AS scenario, count(*) AS n, avg({side}_latency) AS avg_latency, avg({side}_input_tokens) AS avg_input_tokens,
       avg({side}_output_tokens) AS avg_output_tokens
FROM fx_pairs WHERE {side}_correct = 1 AND p {op} 5e-1""" for side in ("slm", "llm") for name, op in (("complex", ">="), ("simple", "<"))),
       rounded=["avg_latency", "avg_input_tokens", "avg_output_tokens"])
def means_where_solved(spark, sf_dir):
    return conditional_means(view(spark, sf_dir, "fx_pairs"), sides()[0])


@query("SELECT dataset_name, avg(slm_correct) AS avg_q_slm, avg(llm_correct) AS avg_q_llm FROM fx_pairs GROUP BY dataset_name",
       rounded=["avg_q_slm", "avg_q_llm"])
def mean_quality(spark, sf_dir):
    rows = calibrate(view(spark, sf_dir, "fx_pairs"), *sides(), ["dataset_name"])
    return average_quality(rows, ["dataset_name"])


def trace_sql(decision: str) -> str:
    def pick(llm: str, slm: str) -> str:
        return f"CASE WHEN decision = 'llm' THEN {llm} ELSE {slm} END"

    return f"""
    SELECT id, dataset_name, p, decision, {pick('llm_correct', 'slm_correct')} AS correct, {pick('llm_latency', 'slm_latency')} AS latency,
           {pick('llm_input_tokens', 'slm_input_tokens')} AS input_tokens, {pick('llm_output_tokens', 'slm_output_tokens')} AS output_tokens,
           {pick('usd', '0e0')} AS actual_usd, {pick(MEAN_USD, '0e0')} AS predicted_usd,
           {pick('23.806206206190154e0', '3.1007189569935947e0')} AS predicted_latency, {pick('le', 'se')} AS error,
           {pick(Q_LLM, Q_SLM)} AS quality
    FROM (SELECT *, {decision} AS decision FROM (SELECT *, {USD} AS usd, {SLM_ERROR} AS se, {LLM_ERROR} AS le FROM fx_pairs))"""


TRACE_DOUBLES = ["p", "latency", "actual_usd", "predicted_usd", "predicted_latency", "error", "quality"]


@query(trace_sql(UTILITY), rounded=TRACE_DOUBLES, ints=["correct"], digits=9)
def routing_trace(spark, sf_dir):
    return policy_detail(view(spark, sf_dir, "fx_pairs"), MODEL)


@query(trace_sql(f"CASE WHEN llm_output_tokens > 6000 THEN 'slm' ELSE {UTILITY} END"), rounded=TRACE_DOUBLES, ints=["correct"], digits=9)
def routing_trace_high_cost(spark, sf_dir):
    return policy_detail(
        view(spark, sf_dir, "fx_pairs"), MODEL, "high_cost", (F.col("llm_output_tokens") > 6000).cast("int")
    )


@query(trace_sql("CASE WHEN se <= le THEN 'slm' ELSE 'llm' END"), rounded=TRACE_DOUBLES, ints=["correct"], digits=9)
def routing_trace_oracle_cost(spark, sf_dir):
    return policy_detail(view(spark, sf_dir, "fx_pairs"), MODEL, "oracle_cost")


@query(f"""
WITH t AS ({trace_sql(UTILITY)})
SELECT CASE WHEN grouping(decision) = 1 THEN 'all' ELSE decision END AS decision, count(*) AS n, avg(correct) AS accuracy,
       avg(latency) AS avg_latency, avg(actual_usd) * 1e2 AS avg_cents, avg(input_tokens) AS avg_input_tokens,
       avg(output_tokens) AS avg_output_tokens, avg(error) AS avg_error, count(*) / CAST((SELECT count(*) FROM t) AS DOUBLE) AS share
FROM t GROUP BY ROLLUP (decision)
""", rounded=["accuracy", "avg_latency", "avg_cents", "avg_input_tokens", "avg_output_tokens", "avg_error", "share"])
def decision_summary(spark, sf_dir):
    return by_decision_summary(policy_detail(view(spark, sf_dir, "fx_pairs"), MODEL))


@query(f"WITH {PAIRS} SELECT dataset_name, avg(se) AS all_slm_error, avg(le) AS all_llm_error FROM c GROUP BY dataset_name",
       rounded=["all_slm_error", "all_llm_error"])
def single_model_errors(spark, sf_dir):
    return baseline_errors(view(spark, sf_dir, "fx_pairs"), MODEL, ["dataset_name"])


@query("""
SELECT dataset_name, avg(llm_latency) FILTER (WHERE p > 5e-1) AS llm_latency_on_llm,
       avg(slm_latency) FILTER (WHERE p <= 5e-1) AS slm_latency_on_slm,
       (avg(llm_input_tokens) FILTER (WHERE p > 5e-1) * 125e-8 + avg(llm_output_tokens) FILTER (WHERE p > 5e-1) * 1e-5) * 1e2 AS llm_cents_on_llm
FROM fx_pairs GROUP BY dataset_name
""", rounded=["llm_latency_on_llm", "slm_latency_on_slm", "llm_cents_on_llm"])
def routed_subsets(spark, sf_dir):
    return subset_counterfactual(view(spark, sf_dir, "fx_pairs"), route_by_score(F.col("p")), ["dataset_name"])


@query(f"""
WITH t AS ({trace_sql(UTILITY)})
SELECT avg(predicted_usd) * 1e2 + 13e-2 * avg(predicted_latency) + 13e0 * (1e0 - avg(quality)) AS router_error,
       (SELECT 13e-2 * avg(slm_latency) + 13e0 * (1e0 - avg(slm_correct)) FROM fx_pairs) AS slm_error,
       (SELECT (avg(llm_input_tokens) * 125e-8 + avg(llm_output_tokens) * 1e-5) * 1e2 + 13e-2 * avg(llm_latency)
               + 13e0 * (1e0 - avg(llm_correct)) FROM fx_pairs) AS llm_error
FROM t
""", rounded=["router_error", "slm_error", "llm_error"])
def predicted_errors(spark, sf_dir):
    pairs = view(spark, sf_dir, "fx_pairs")
    return predicted_error(policy_detail(pairs, MODEL), calibrate(pairs, *sides()), MODEL)


# Both cost lines of a calibrated domain.
LINES = """
(13e-2 * ls + 13e0 * (1e0 - ((1e0 - p) * qss + p * qsc))) AS slm_error,
((ti * 125e-8 + t_o * 1e-5) * 1e2 + 13e-2 * ll + 13e0 * (1e0 - ((1e0 - p) * qls + p * qlc))) AS llm_error
"""


@query(f"""
WITH r AS ({rates('dataset_name')})
SELECT dataset_name, step, p, {LINES} FROM (SELECT r.*, s.step, s.step / 1000e0 AS p FROM r, (SELECT unnest(range(1001)) AS step) s)
""", rounded=["p", "slm_error", "llm_error"], ints=["step"])
def cost_curves(spark, sf_dir):
    rows = calibrate(view(spark, sf_dir, "fx_pairs"), *sides(), ["dataset_name"])
    return cost_curve(rows, calibrated(MODEL), by=["dataset_name"])


@query(f"""
WITH r AS ({rates('dataset_name')}),
g AS (SELECT dataset_name, step, p, {LINES} FROM (SELECT r.*, s.step, s.step / 1000e0 AS p FROM r, (SELECT unnest(range(1001)) AS step) s)),
x AS (SELECT dataset_name, p AS grid_p FROM (SELECT *, row_number() OVER (PARTITION BY dataset_name
         ORDER BY round(abs(llm_error - slm_error), 9), step) AS rn FROM g) WHERE rn = 1),
u AS (SELECT r.*, x.grid_p, {P_STAR} AS p_star FROM r JOIN x ON r.dataset_name = x.dataset_name),
w AS (SELECT *, CASE WHEN p_star BETWEEN 0 AND 1 THEN p_star ELSE grid_p END AS p FROM u)
SELECT dataset_name, grid_p, p_star, p AS p_used,
       (ti * 125e-8 + t_o * 1e-5) * 1e2 + 13e-2 * ll + 13e0 * (1e0 - ((1e0 - p) * qls + p * qlc)) AS cost_at_p,
       least(greatest(coalesce(p_star, p), 0e0), 1e0) AS p_clipped
FROM w
""", rounded=["grid_p", "p_star", "p_used", "cost_at_p", "p_clipped"])
def cost_curve_crossings(spark, sf_dir):
    rows = calibrate(view(spark, sf_dir, "fx_pairs"), *sides(), ["dataset_name"])
    return curve_crossing(rows, calibrated(MODEL), ["dataset_name"])


def fit_sql(model: str, error: str, where: str) -> str:
    return f"""
    SELECT dataset_name, '{model}' AS model, count(*) FILTER (WHERE {where}) AS n,
           CASE WHEN count(*) FILTER (WHERE {where}) >= 2 THEN regr_slope({error}, p) FILTER (WHERE {where}) END AS slope,
           CASE WHEN count(*) FILTER (WHERE {where}) >= 2 THEN regr_intercept({error}, p) FILTER (WHERE {where}) END AS intercept,
           CASE WHEN count(*) FILTER (WHERE {where}) >= 2 THEN corr({error}, p) FILTER (WHERE {where}) END AS r
    FROM c GROUP BY dataset_name"""


@query(f"WITH {PAIRS} {fit_sql('slm', 'se', 'p <= 5e-1')} UNION ALL {fit_sql('llm', 'le', 'p > 5e-1')}",
       rounded=["slope", "intercept", "r"])
def cost_fit_by_decision(spark, sf_dir):
    return actual_cost_fit(view(spark, sf_dir, "fx_pairs"), MODEL, route_by_score(F.col("p")), ["dataset_name"])


@query(f"WITH {PAIRS} {fit_sql('slm', 'se', 'true')} UNION ALL {fit_sql('llm', 'le', 'true')}", rounded=["slope", "intercept", "r"])
def cost_fit_all_rows(spark, sf_dir):
    return actual_cost_fit(view(spark, sf_dir, "fx_pairs"), MODEL, by=["dataset_name"])


@query(f"""
WITH {PAIRS}, d AS (SELECT *, {UTILITY} AS decision FROM c)
SELECT id, dataset_name, p, decision, CASE WHEN decision = 'llm' THEN le ELSE se END AS error
FROM d WHERE (decision = 'slm' AND p <= 4e-1) OR (decision = 'llm' AND p >= 4e-1)
""", rounded=["p", "error"])
def plotted_cost_points(spark, sf_dir):
    return plotted_points(view(spark, sf_dir, "fx_pairs"), MODEL, 0.4)


def histogram_sql(bins: int, place: str) -> str:
    return f"""
    WITH k AS (SELECT dataset_name, CAST({place} AS INT) AS bin, count(*) AS n FROM fx_pairs GROUP BY 1, 2),
    g AS (SELECT dataset_name, bin FROM (SELECT DISTINCT dataset_name FROM fx_pairs), (SELECT unnest(range({bins})) AS bin))
    SELECT g.dataset_name, g.bin, g.bin / {bins}e0 AS left_edge, coalesce(k.n, 0) AS n
    FROM g LEFT JOIN k ON g.dataset_name = k.dataset_name AND g.bin = k.bin"""


@query(histogram_sql(20, "least(floor(p * 20), 19)"), rounded=["left_edge"], ints=["bin"])
def score_histograms(spark, sf_dir):
    return score_histogram(view(spark, sf_dir, "fx_pairs"), 20, ["dataset_name"])


@query(histogram_sql(30, "greatest(ceil(p * 30) - 1, 0)"), rounded=["left_edge"], ints=["bin"])
def score_histograms_right_closed(spark, sf_dir):
    return score_histogram(view(spark, sf_dir, "fx_pairs"), 30, ["dataset_name"], right_closed=True)


@query("""
SELECT dataset_name, count(*) FILTER (WHERE p < 55e-2 AND slm_correct = 1) AS tp, count(*) FILTER (WHERE p < 55e-2 AND slm_correct = 0) AS fp,
       count(*) FILTER (WHERE p >= 55e-2 AND slm_correct = 1) AS fn, count(*) FILTER (WHERE p >= 55e-2 AND slm_correct = 0) AS tn,
       avg(CASE WHEN (p < 55e-2) = (slm_correct = 1) THEN 1e0 ELSE 0e0 END) AS routing_accuracy
FROM fx_pairs GROUP BY dataset_name
""", rounded=["routing_accuracy"])
def slm_routing_quality(spark, sf_dir):
    return slm_routing_accuracy(view(spark, sf_dir, "fx_pairs"), 0.55, "p", ["dataset_name"])


@query("""
WITH g AS (SELECT unnest(range(21)) / 20e0 AS threshold),
a AS (SELECT dataset_name, threshold, avg(CASE WHEN (p < threshold) = (slm_correct = 1) THEN 1e0 ELSE 0e0 END) AS routing_accuracy
      FROM fx_pairs, g GROUP BY dataset_name, threshold)
SELECT dataset_name, threshold, routing_accuracy,
       CASE WHEN row_number() OVER (PARTITION BY dataset_name ORDER BY round(routing_accuracy, 12) DESC, threshold) = 1 THEN 1 ELSE 0 END AS is_best
FROM a
""", rounded=["threshold", "routing_accuracy"], ints=["is_best"])
def threshold_sweeps(spark, sf_dir):
    return threshold_sweep(view(spark, sf_dir, "fx_pairs"), [i / 20 for i in range(21)], "p", ["dataset_name"])
