from __future__ import annotations

from pyspark.sql import functions as F

from answerflow.functions.costs import (
    PROFILES,
    adjust_by_text_features,
    break_even,
    choose_model,
    error_cost,
    llm_quality,
    override_high_cost,
    route_by_score,
    route_by_utility,
    settings_with_overrides,
    slm_quality,
    token_cost,
)
from answerflow.operators.replay import calibrate, calibrated
from checks.registry import query
from checks.views import run_sql, table, view

MODEL = PROFILES["classifier"]

# The same model in SQL.
USD = "(llm_input_tokens * 125e-8 + llm_output_tokens * 1e-5)"
MEAN_USD = "(154.00091508052708e0 * 125e-8 + 1897.1786237188874e0 * 1e-5)"
Q_SLM = "((1e0 - p) * 76e-2 + p * 39e-2)"
Q_LLM = "((1e0 - p) * 93e-2 + p * 83e-2)"
SLM_ERROR = "(13e-2 * slm_latency + 13e0 * (1e0 - slm_correct))"
LLM_ERROR = f"({USD} * 1e2 + 13e-2 * llm_latency + 13e0 * (1e0 - llm_correct))"
E_SLM = f"(13e-2 * 3.1007189569935947e0 + 13e0 * (1e0 - {Q_SLM}))"
E_LLM = f"({MEAN_USD} * 1e2 + 13e-2 * 23.806206206190154e0 + 13e0 * (1e0 - {Q_LLM}))"
UTILITY = f"CASE WHEN {E_LLM} < {E_SLM} THEN 'llm' ELSE 'slm' END"


@query(f"SELECT id, {USD} AS usd FROM fx_pairs", rounded=["usd"], digits=9)
def answer_cost(spark, sf_dir):
    return view(spark, sf_dir, "fx_pairs").select(
        "id", token_cost(F.col("llm_input_tokens"), F.col("llm_output_tokens")).alias("usd")
    )


@query(f"SELECT id, {SLM_ERROR} AS slm_error, {LLM_ERROR} AS llm_error FROM fx_pairs", rounded=["slm_error", "llm_error"])
def error_costs(spark, sf_dir):
    usd = token_cost(F.col("llm_input_tokens"), F.col("llm_output_tokens"))
    return view(spark, sf_dir, "fx_pairs").select(
        "id", error_cost(0.0, F.col("slm_latency"), F.col("slm_correct"), MODEL).alias("slm_error"),
        error_cost(usd, F.col("llm_latency"), F.col("llm_correct"), MODEL).alias("llm_error"),
    )


@query(f"SELECT id, {Q_SLM} AS slm, {Q_LLM} AS llm FROM fx_pairs", rounded=["slm", "llm"])
def expected_qualities(spark, sf_dir):
    return view(spark, sf_dir, "fx_pairs").select(
        "id", slm_quality(F.col("p"), MODEL).alias("slm"), llm_quality(F.col("p"), MODEL).alias("llm")
    )


@query(f"""
SELECT id, {UTILITY} AS by_means,
       CASE WHEN {USD} * 1e2 + 13e-2 * llm_latency + 13e0 * (1e0 - {Q_LLM}) < 13e-2 * slm_latency + 13e0 * (1e0 - {Q_SLM})
            THEN 'llm' ELSE 'slm' END AS by_row
FROM fx_pairs
""")
def utility_routes(spark, sf_dir):
    by_row = route_by_utility(
        F.col("p"), MODEL, slm_latency=F.col("slm_latency"), llm_latency=F.col("llm_latency"),
        llm_usd=token_cost(F.col("llm_input_tokens"), F.col("llm_output_tokens")),
    )
    return view(spark, sf_dir, "fx_pairs").select(
        "id", route_by_utility(F.col("p"), MODEL).alias("by_means"), by_row.alias("by_row")
    )


def rates(by: str) -> str:
    return f"""
    SELECT {by}, avg(slm_correct) FILTER (WHERE p < 5e-1) AS qss, avg(slm_correct) FILTER (WHERE p >= 5e-1) AS qsc,
           avg(llm_correct) FILTER (WHERE p < 5e-1) AS qls, avg(llm_correct) FILTER (WHERE p >= 5e-1) AS qlc,
           avg(slm_latency) AS ls, avg(llm_latency) AS ll, avg(llm_input_tokens) AS ti, avg(llm_output_tokens) AS t_o
    FROM fx_pairs GROUP BY {by}"""


P_STAR = "(((ti * 125e-8 + t_o * 1e-5) * 1e2 + 13e-2 * (ll - ls)) / 13e0 - (qls - qss)) / nullif((qlc - qsc) - (qls - qss), 0e0)"


@query(f"WITH r AS ({rates('dataset_name')}) SELECT dataset_name, {P_STAR} AS p_star FROM r", rounded=["p_star"])
def break_even_per_domain(spark, sf_dir):
    pairs = view(spark, sf_dir, "fx_pairs")
    rows = calibrate(pairs, (F.col("p") >= 0.5).cast("int"), 1 - F.col("slm_correct"), ["dataset_name"])
    return rows.select("dataset_name", break_even(calibrated(MODEL)).alias("p_star"))


@query("""
SELECT id, CASE WHEN slm_correct > 5e-1 THEN 'llm' ELSE 'slm' END AS over_flag, CASE WHEN p > 5e-1 THEN 'llm' ELSE 'slm' END AS above,
       CASE WHEN slm_latency >= 25e-1 THEN 'llm' ELSE 'slm' END AS at_least
FROM fx_pairs
""")
def score_routes(spark, sf_dir):
    return view(spark, sf_dir, "fx_pairs").select(
        "id", route_by_score(F.col("slm_correct"), 0.5).alias("over_flag"), route_by_score(F.col("p")).alias("above"),
        route_by_score(F.col("slm_latency"), 2.5, inclusive=True).alias("at_least"),
    )


FEATURE_TEXT = """
SELECT doc_id AS id, (doc_id % 1000) / 999e0 AS p, doc_id % 20 AS input_tokens,
       CASE doc_id % 4 WHEN 0 THEN concat('Let a_1 be ', lang) WHEN 1 THEN concat('What is ', source, '?')
            WHEN 2 THEN concat('x^2 ', text) ELSE text END AS question
FROM documents
"""
SHIFT = "1e0 / (1e0 + exp(-(ln((p + 1e-8) / (1e0 - p + 1e-8)) + ({by}))))"
PLAIN = "(len(string_split_regex(trim(question, chr(9) || chr(10) || chr(13) || ' '), '\\s+')) <= 20 AND NOT regexp_matches(question, '[_^\\\\{}]'))"


@query(f"""
SELECT id, CASE WHEN {PLAIN} THEN {SHIFT.format(by='5e-1')} WHEN input_tokens < 12 THEN {SHIFT.format(by='6e-1')} ELSE p END AS for_slm,
       CASE WHEN regexp_matches(question, '\\b[a-zA-Z]_[a-zA-Z0-9]+\\b') THEN {SHIFT.format(by='-12e-1')} ELSE p END AS for_llm
FROM ({FEATURE_TEXT})
""", rounded=["for_slm", "for_llm"])
def text_adjusted_scores(spark, sf_dir):
    rows = run_sql(spark, sf_dir, FEATURE_TEXT)
    for_slm, for_llm = adjust_by_text_features(F.col("p"), F.col("question"), F.col("input_tokens"))
    return rows.select("id", for_slm.alias("for_slm"), for_llm.alias("for_llm"))


@query(f"""
SELECT id, CASE WHEN llm_output_tokens > 6000 THEN 'slm' ELSE {UTILITY} END AS route FROM fx_pairs
""")
def high_cost_overrides(spark, sf_dir):
    routed = route_by_utility(F.col("p"), MODEL)
    return view(spark, sf_dir, "fx_pairs").select(
        "id", override_high_cost((F.col("llm_output_tokens") > 6000).cast("int"), routed).alias("route")
    )


@query("""
SELECT o_orderkey AS id,
       CASE WHEN o_orderkey % 5 IN (1, 2) THEN CAST(o_custkey % 20 AS DOUBLE) ELSE 15e0 END AS error_weight,
       CASE WHEN o_orderkey % 5 = 2 THEN o_totalprice ELSE 154e0 END AS llm_input_tokens, 11e-2 AS latency_weight
FROM orders
""", rounded=["error_weight", "llm_input_tokens", "latency_weight"])
def overridden_settings(spark, sf_dir):
    five = F.col("o_orderkey") % 5
    given = (
        F.when(five == 0, F.lit(None))
        .when(five == 1, F.create_map(F.lit("C_ERR"), (F.col("o_custkey") % 20).cast("string")))
        .when(five == 2, F.create_map(
            F.lit("C_ERR"), (F.col("o_custkey") % 20).cast("string"),
            F.lit("LLM_AVG_IMPUT_TOKENS"), F.col("o_totalprice").cast("string"),
        ))
        .otherwise(F.create_map(F.lit("C_ERR"), F.col("o_orderpriority"), F.lit("OTHER"), F.lit("1")))
    )
    rows = table(spark, sf_dir, "orders").withColumn("settings", given.cast("map<string,string>"))
    model = settings_with_overrides(F.col("settings"))
    return rows.select(
        F.col("o_orderkey").alias("id"), model.error_weight.alias("error_weight"),
        model.llm_input_tokens.alias("llm_input_tokens"), model.latency_weight.alias("latency_weight"),
    )


@query(f"""
SELECT id, CASE id % 4 WHEN 0 THEN 'slm' WHEN 1 THEN 'llm' ELSE {UTILITY} END AS route FROM fx_pairs
""")
def requested_models(spark, sf_dir):
    asked = F.when(F.col("id") % 4 == 0, F.lit(" slm ")).when(F.col("id") % 4 == 1, F.lit("LLM")).when(
        F.col("id") % 4 == 2, F.lit("gpt")
    )
    return view(spark, sf_dir, "fx_pairs").select(
        "id", choose_model(asked, route_by_utility(F.col("p"), MODEL)).alias("route")
    )
