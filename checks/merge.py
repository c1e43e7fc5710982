from __future__ import annotations

from pyspark.sql import functions as F

from answerflow.operators.merge import (
    build_outcomes_wide,
    consensus_dataset,
    ensemble_accuracy,
    five_vote_ensemble,
    merge_runs,
    merge_runs_prefixed,
    pair_outcomes,
    pairs_from_outcomes,
    unpivot_outcomes,
    vote_table,
)
from checks.registry import query
from checks.views import run_sql, view

FIVE = ["m1", "m2", "m3", "m4", "m5"]

# Single tries: the flag becomes an answer letter that hits or misses the key.
SINGLES = """
SELECT id AS QID, model, category, concat(' ', lower(CASE WHEN correct = 1 THEN 'A' ELSE 'B' END)) AS model_answer,
       'A' AS correct_answer, latency
FROM fx_outcomes
"""
# Five tries per question: a share in fifths.
FIVES = "SELECT id, model, category, (output_tokens % 6) / 5e0 AS accuracy, latency FROM fx_outcomes"


@query("""
SELECT a.id, a.dataset_name, a.category, a.latency AS latency_qwen, b.latency AS latency_gpt5,
       a.correct AS correct_qwen, b.correct AS correct_gpt5
FROM fx_outcomes a JOIN fx_outcomes b ON a.id = b.id WHERE a.model = 'm1' AND b.model = 'm2'
""", rounded=["latency_qwen", "latency_gpt5"], ints=["correct_qwen", "correct_gpt5"])
def merged_runs(spark, sf_dir):
    runs = view(spark, sf_dir, "fx_outcomes").select("id", "model", "dataset_name", "category", "latency", "correct")
    left, right = runs.where("model = 'm1'").drop("model"), runs.where("model = 'm2'").drop("model")
    return merge_runs(left, right, ["id"], ["latency", "correct"], ("_qwen", "_gpt5"))


@query("""
SELECT a.id, a.dataset_name AS problem, a.latency AS slm_Latency, b.latency AS llm_Latency
FROM fx_outcomes a JOIN fx_outcomes b ON a.id = b.id AND a.dataset_name = b.dataset_name
WHERE a.model = 'm1' AND b.model = 'm2'
""", rounded=["slm_Latency", "llm_Latency"])
def merged_runs_prefixed(spark, sf_dir):
    runs = view(spark, sf_dir, "fx_outcomes").select(
        "model", F.col("id").alias("ID"), F.col("dataset_name").alias("Problem"), F.col("latency").alias("Latency")
    )
    return merge_runs_prefixed(
        runs.where("model = 'm1'").drop("model"), runs.where("model = 'm2'").drop("model"), ("slm_", "llm_")
    )


@query("""
SELECT id, slm_correct, slm_latency, slm_input_tokens, slm_output_tokens,
       llm_correct, llm_latency / 7e0 AS llm_latency, llm_input_tokens, llm_output_tokens
FROM fx_pairs
""", rounded=["slm_latency", "llm_latency"], ints=["slm_correct", "llm_correct"])
def outcome_pairs(spark, sf_dir):
    log = view(spark, sf_dir, "fx_outcomes").select(
        "model", F.col("id").alias("ID"), F.when(F.col("correct") == 1, F.lit(" True")).otherwise(F.lit("False")).alias("Correct"),
        F.col("latency").alias("Latency"), F.col("input_tokens").alias("Input Tokens"), F.col("output_tokens").alias("Output Tokens"),
    )
    return pair_outcomes(log.where("model = 'm1'"), log.where("model = 'm2'"))


@query("SELECT * EXCLUDE (p, llm_latency), llm_latency / 7e0 AS llm_latency FROM fx_pairs",
       rounded=["slm_latency", "llm_latency"], ints=["slm_correct", "llm_correct"])
def outcome_pairs_from_long(spark, sf_dir):
    return pairs_from_outcomes(view(spark, sf_dir, "fx_outcomes"), "m1", "m2")


@query("""
SELECT id, n_correct, slm_accuracy_fraction FROM fx_fraction
""", rounded=["slm_accuracy_fraction"])
def solve_fraction(spark, sf_dir):
    runs = view(spark, sf_dir, "fx_outcomes").where(F.col("model").isin("m1", "m2", "m3", "m4"))
    return ensemble_accuracy(runs, 4)


WIDE_CELLS = ",\n".join(
    f"max(CASE WHEN model = '{m}' THEN {c} END) AS {'is_correct' if c == 'correct' else c}_{m}"
    for m in FIVE
    for c in ("correct", "latency", "input_tokens", "output_tokens")
)


@query(f"""
SELECT id, min(dataset_name) AS dataset_name, min(category) AS category, {WIDE_CELLS},
       CASE WHEN count(*) FILTER (WHERE model IN ('m1', 'm2', 'm3')) = 3
            THEN sum(correct) FILTER (WHERE model IN ('m1', 'm2', 'm3')) / 3e0 END AS slm_accuracy_fraction
FROM fx_outcomes GROUP BY id
""", rounded=["slm_accuracy_fraction"] + [f"latency_{m}" for m in FIVE], ints=[f"is_correct_{m}" for m in FIVE])
def wide_outcomes(spark, sf_dir):
    return build_outcomes_wide(view(spark, sf_dir, "fx_outcomes"), FIVE, FIVE[:3])


@query("""
SELECT id, dataset_name, category, model, correct, latency, input_tokens, output_tokens
FROM fx_outcomes WHERE model IN ('m1', 'm2', 'm3', 'm4', 'm5')
""", rounded=["latency"], ints=["correct"])
def long_outcomes(spark, sf_dir):
    return unpivot_outcomes(build_outcomes_wide(view(spark, sf_dir, "fx_outcomes"), FIVE))


VOTE_FLAGS = ", ".join(f"max(CASE WHEN model = '{m}' THEN correct END) AS {m}_correct" for m in FIVE)


@query(f"""
WITH votes AS (
  SELECT id, min(category) AS category, {VOTE_FLAGS}, CAST(sum(correct) AS BIGINT) AS correct_models
  FROM fx_outcomes WHERE model IN ('m1', 'm2', 'm3', 'm4', 'm5') GROUP BY id HAVING count(*) = 5)
SELECT id AS QID, category, 'A' AS correct_answer, {", ".join(f"{m}_correct" for m in FIVE)}, correct_models,
       correct_models / 5e0 AS vote_accuracy, CASE WHEN correct_models <= 3 THEN 1 ELSE 0 END AS complex, 'first five' AS version
FROM votes
""", rounded=["vote_accuracy"], ints=["complex"] + [f"{m}_correct" for m in FIVE])
def votes(spark, sf_dir):
    return vote_table(run_sql(spark, sf_dir, SINGLES), FIVE, "first five", key="QID")


@query("""
WITH v AS (
  SELECT id, count(*) FILTER (WHERE (output_tokens % 6) / 5e0 >= 8e-1) AS votes_simple
  FROM fx_outcomes WHERE model IN ('m1', 'm2', 'm3', 'm4', 'm5') GROUP BY id HAVING count(*) = 5)
SELECT id, votes_simple, 5 - votes_simple AS votes_complex, CASE WHEN votes_simple < 4 THEN 1 ELSE 0 END AS complex,
       'first five' AS ensemble_version
FROM v
""", ints=["votes_complex", "complex"])
def five_try_votes(spark, sf_dir):
    return five_vote_ensemble(run_sql(spark, sf_dir, FIVES), FIVE, "first five")


@query("""
WITH raw AS (
  SELECT l_orderkey AS QID, concat('m', CAST(l_linenumber AS STRING)) AS model, l_returnflag,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice,
                            l_quantity, l_shipdate, l_returnflag) AS rn
  FROM lineitem)
SELECT QID, 'q' AS category, 'N' AS correct_answer,
       avg(CASE WHEN l_returnflag = 'N' THEN 1e0 ELSE 0e0 END) AS accuracy_fraction,
       CASE WHEN avg(CASE WHEN l_returnflag = 'N' THEN 1e0 ELSE 0e0 END) < 8e-1 THEN 1 ELSE 0 END AS complex
FROM raw WHERE rn = 1 GROUP BY QID HAVING count(*) = 7
""", rounded=["accuracy_fraction"], ints=["complex"])
def consensus(spark, sf_dir):
    singles = run_sql(spark, sf_dir, """
        SELECT l_orderkey AS QID, concat('m', CAST(l_linenumber AS STRING)) AS model, lower(l_returnflag) AS model_answer,
               'N' AS correct_answer, 'q' AS category, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_returnflag
        FROM lineitem""")
    order = ["l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_returnflag"]
    return consensus_dataset(singles, 7, order, "QID")


# Two data sets that share ids; the first model of the first set was run twice.
TWO_SETS = """
SELECT id, 'one' AS set_name, model, correct, category, output_tokens FROM fx_outcomes
UNION ALL SELECT id, 'two', model, 1 - correct, category, output_tokens FROM fx_outcomes
UNION ALL SELECT id, 'one', model, 0, category, output_tokens FROM fx_outcomes WHERE model = 'm1'
"""


@query(f"""
WITH runs AS ({TWO_SETS}), best AS (SELECT id, set_name, model, max(correct) AS correct FROM runs WHERE model IN ('m1', 'm2', 'm3', 'm4') GROUP BY ALL)
SELECT id, set_name, CAST(sum(correct) AS BIGINT) AS n_correct, sum(correct) / 4e0 AS slm_accuracy_fraction
FROM best GROUP BY id, set_name HAVING count(*) = 4
""", rounded=["slm_accuracy_fraction"])
def solve_fraction_of_two_sets(spark, sf_dir):
    runs = run_sql(spark, sf_dir, TWO_SETS).where(F.col("model").isin("m1", "m2", "m3", "m4"))
    return ensemble_accuracy(runs, 4, ["id", "set_name"])


@query(f"""
WITH runs AS ({TWO_SETS}),
v AS (SELECT id, set_name, model, max(correct) AS correct, min(category) AS category FROM runs WHERE model IN ('m1', 'm2', 'm3', 'm4', 'm5') GROUP BY ALL)
SELECT id, set_name, min(category) AS category, CAST(sum(correct) AS BIGINT) AS correct_models,
       CASE WHEN sum(correct) <= 3 THEN 1 ELSE 0 END AS complex
FROM v GROUP BY id, set_name HAVING count(*) = 5
""", ints=["complex"])
def votes_of_two_sets(spark, sf_dir):
    singles = run_sql(spark, sf_dir, f"""
        SELECT id, set_name, model, category, 'A' AS correct_answer, CASE WHEN correct = 1 THEN ' a' || chr(10) ELSE 'B' END AS model_answer
        FROM ({TWO_SETS})""")
    return vote_table(singles, FIVE, "two sets", ["id", "set_name"]).select("id", "set_name", "category", "correct_models", "complex")


@query(f"""
WITH runs AS ({TWO_SETS}),
own AS (SELECT id, set_name, model, min((output_tokens + correct) % 6) / 5e0 AS accuracy FROM runs WHERE model IN ('m1', 'm2', 'm3', 'm4', 'm5') GROUP BY ALL)
SELECT id, set_name, count(*) FILTER (WHERE accuracy >= 8e-1) AS votes_simple
FROM own GROUP BY id, set_name HAVING count(*) = 5
""")
def five_try_votes_of_two_sets(spark, sf_dir):
    fives = run_sql(spark, sf_dir, f"SELECT id, set_name, model, (output_tokens + correct) % 6 / 5e0 AS accuracy FROM ({TWO_SETS})")
    return five_vote_ensemble(fives, FIVE, "two sets", ["id", "set_name"]).select("id", "set_name", "votes_simple")


@query(f"""
WITH runs AS ({TWO_SETS}), first AS (
  SELECT *, row_number() OVER (PARTITION BY id, set_name, model ORDER BY correct DESC) AS rn FROM runs WHERE model IN ('m1', 'm2', 'm3'))
SELECT id, set_name, avg(correct) AS accuracy_fraction, CASE WHEN avg(correct) < 8e-1 THEN 1 ELSE 0 END AS complex
FROM first WHERE rn = 1 GROUP BY id, set_name HAVING count(*) = 3
""", rounded=["accuracy_fraction"], ints=["complex"])
def consensus_of_two_sets(spark, sf_dir):
    singles = run_sql(spark, sf_dir, f"""
        SELECT id, set_name, model, correct, 'X' AS correct_answer, CASE WHEN correct = 1 THEN 'x' ELSE 'y' END AS model_answer
        FROM ({TWO_SETS}) WHERE model IN ('m1', 'm2', 'm3')""")
    return consensus_dataset(singles, 3, [F.desc("correct")], ["id", "set_name"]).drop("correct_answer")
