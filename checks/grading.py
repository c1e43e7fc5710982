from __future__ import annotations

from pyspark.sql import functions as F

from answerflow.functions.text import extract_boxed, extract_choice, normalize_latex
from answerflow.operators.grading import (
    apply_call_failures,
    grade_choice,
    grade_math,
    grade_responses,
    regrade_exact,
    run_summary,
)
from checks.registry import query
from checks.views import view

# The same extraction in the other engine's regular expressions.
CHOICE = """
coalesce(nullif(regexp_extract(response, 'answer is \\(?([A-J])\\)?', 1), ''),
         nullif(regexp_extract(response, '.*[aA]nswer:\\s*([A-J])', 1), ''),
         nullif(regexp_extract(response, '(?s)^.*\\b([A-J])\\b', 1), ''))
"""
CHOICE_4 = """
coalesce(nullif(regexp_extract(response, 'answer is \\(?([A-D])\\)?', 1), ''),
         nullif(regexp_extract(response, '.*[aA]nswer:\\s*([A-D])', 1), ''),
         CASE WHEN regexp_extract(response, '(?s)^.*\\b([A-J])\\b', 1) IN ('A', 'B', 'C', 'D')
              THEN regexp_extract(response, '(?s)^.*\\b([A-J])\\b', 1) END)
"""
# Up to two levels of inner braces, which is what the responses contain.
BOXED = """
nullif(trim(regexp_extract(response, '\\\\boxed\\{((?:[^{}]|\\{[^{}]*\\})*)\\}', 1)), '')
"""


def latex(column: str) -> str:
    s = f"replace(replace(replace({column}, '\\tfrac', '\\frac'), '\\dfrac', '\\frac'), '\\textbf', '\\text')"
    s = f"regexp_replace({s}, '\\\\frac(\\d)(\\d)', '\\\\frac{{\\1}}{{\\2}}', 'g')"
    s = f"replace({s}, '$', '')"
    s = f"regexp_replace({s}, '\\s*(degrees?|radians?|units?|cm|km|m|ft|s|kg|g)\\s*$', '', 'i')"
    return f"trim(lower(replace({s}, ' ', '')))"


@query(f"SELECT id, {CHOICE} AS ten, {CHOICE_4} AS four FROM fx_responses")
def chosen_letters(spark, sf_dir):
    return view(spark, sf_dir, "fx_responses").select(
        "id", extract_choice(F.col("response")).alias("ten"), extract_choice(F.col("response"), "ABCD").alias("four")
    )


@query(f"SELECT id, {BOXED} AS boxed FROM fx_responses")
def boxed_answers(spark, sf_dir):
    return view(spark, sf_dir, "fx_responses").select("id", extract_boxed(F.col("response")).alias("boxed"))


@query(f"SELECT id, {latex(BOXED)} AS answer, {latex('gold_math')} AS gold FROM fx_responses")
def normalized_latex(spark, sf_dir):
    return view(spark, sf_dir, "fx_responses").select(
        "id", normalize_latex(extract_boxed(F.col("response"))).alias("answer"), normalize_latex(F.col("gold_math")).alias("gold")
    )


@query(f"""
SELECT id, {BOXED} AS extracted, CASE WHEN {latex(BOXED)} = {latex('gold_math')} THEN 1 ELSE 0 END AS correct
FROM fx_responses
""", ints=["correct"])
def math_grades(spark, sf_dir):
    return grade_math(view(spark, sf_dir, "fx_responses"), "gold_math").select("id", "extracted", "correct")


@query(f"""
SELECT id, {CHOICE} AS extracted, CASE WHEN {CHOICE} = gold_letter THEN 1 ELSE 0 END AS correct FROM fx_responses
""", ints=["correct"])
def choice_grades(spark, sf_dir):
    return grade_choice(view(spark, sf_dir, "fx_responses"), "gold_letter").select("id", "extracted", "correct")


@query("""
WITH a AS (
  SELECT id, CASE WHEN id % 3 = 0 THEN concat(' ', lower(letter)) WHEN id % 3 = 1 THEN letter END AS model_answer,
         CASE WHEN id % 2 = 0 THEN gold_letter ELSE letter END AS correct_answer
  FROM fx_responses)
SELECT id, CASE WHEN model_answer = correct_answer THEN 1 ELSE 0 END AS raw,
       CASE WHEN upper(trim(model_answer)) = upper(trim(correct_answer)) THEN 1 ELSE 0 END AS up,
       CASE WHEN lower(trim(model_answer)) = lower(trim(correct_answer)) THEN 1 ELSE 0 END AS low
FROM a
""", ints=["raw", "up", "low"])
def regraded(spark, sf_dir):
    third = F.col("id") % 3
    rows = view(spark, sf_dir, "fx_responses").select(
        "id",
        F.when(third == 0, F.concat(F.lit(" "), F.lower("letter"))).when(third == 1, F.col("letter")).alias("model_answer"),
        F.when(F.col("id") % 2 == 0, F.col("gold_letter")).otherwise(F.col("letter")).alias("correct_answer"),
    )
    raw = regrade_exact(rows, "raw").withColumnRenamed("correct", "raw")
    up = regrade_exact(raw, "upper").withColumnRenamed("correct", "up")
    return regrade_exact(up, "lower").withColumnRenamed("correct", "low").select("id", "raw", "up", "low")


@query("""
SELECT id, coalesce(error, response) AS response, CASE WHEN error IS NULL THEN letter END AS extracted,
       CASE WHEN error IS NULL THEN 1 ELSE 0 END AS correct, CASE WHEN error IS NULL THEN latency ELSE 0e0 END AS latency,
       CASE WHEN error IS NULL THEN 7 ELSE 0 END AS input_tokens, CASE WHEN error IS NULL THEN 9 ELSE 0 END AS output_tokens,
       CASE WHEN error IS NULL THEN 0 ELSE 1 END AS failed
FROM fx_responses
""", rounded=["latency"], ints=["correct", "input_tokens", "output_tokens", "failed"])
def failed_calls(spark, sf_dir):
    graded = view(spark, sf_dir, "fx_responses").select(
        "id", "response", F.col("letter").alias("extracted"), F.lit(1).alias("correct"), "latency",
        F.lit(7).alias("input_tokens"), F.lit(9).alias("output_tokens"), "error",
    )
    return apply_call_failures(graded).drop("error")


@query(f"""
WITH graded AS (
  SELECT model, category, CASE WHEN error IS NULL THEN latency ELSE 0e0 END AS latency,
         CASE WHEN error IS NULL THEN {CHOICE} END AS extracted,
         CASE WHEN error IS NULL AND {CHOICE} = gold_letter THEN 1 ELSE 0 END AS correct,
         CASE WHEN error IS NULL THEN 0 ELSE 1 END AS failed
  FROM fx_responses)
SELECT model, category, count(*) AS n, sum(correct) AS n_correct, avg(latency) AS avg_latency,
       count(*) FILTER (WHERE extracted IS NULL) AS n_unextracted, sum(failed) AS n_failed,
       count(*) + 5 AS n_expected, sum(correct) / CAST(count(*) + 5 AS DOUBLE) AS accuracy
FROM graded GROUP BY model, category
""", rounded=["avg_latency", "accuracy"], ints=["n_correct", "n_failed", "n_expected"])
def graded_run_summary(spark, sf_dir):
    responses = view(spark, sf_dir, "fx_responses").withColumns(
        {"input_tokens": F.lit(1), "output_tokens": F.lit(1)}
    )
    expected = responses.groupBy("model", "category").agg((F.count(F.lit(1)) + 5).alias("n_expected"))
    return run_summary(grade_responses(responses, "choice", "gold_letter"), ["model", "category"], expected)
