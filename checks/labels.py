from __future__ import annotations

from pyspark.sql import functions as F

from answerflow.operators.labels import (
    complexity_score,
    difficulty_score,
    high_cost_report,
    label_complex,
    label_distribution,
    label_high_cost,
    quantile_bins,
)
from answerflow.operators.merge import build_outcomes_wide
from checks.registry import query
from answerflow.operators.prep import random_split
from checks.models import HELD
from checks.views import view


@query("""
SELECT id, slm_accuracy_fraction, CASE WHEN slm_accuracy_fraction < 75e-2 THEN 1 ELSE 0 END AS complex FROM fx_fraction
""", rounded=["slm_accuracy_fraction"], ints=["complex"])
def complex_labels(spark, sf_dir):
    return label_complex(view(spark, sf_dir, "fx_fraction")).select("id", "slm_accuracy_fraction", "complex")


@query("""
SELECT id, round_even(1e0 - slm_accuracy_fraction, 1) AS rounded_score, 1e0 - slm_accuracy_fraction AS raw_score FROM fx_fraction
""", rounded=["rounded_score", "raw_score"])
def complexity_scores(spark, sf_dir):
    rows = complexity_score(view(spark, sf_dir, "fx_fraction")).withColumnRenamed("complexity_score", "rounded_score")
    return complexity_score(rows, None).select("id", "rounded_score", F.col("complexity_score").alias("raw_score"))


@query("""
SELECT id, 1e0 - least(greatest(sum(CASE model WHEN 'm1' THEN 3e-1 WHEN 'm2' THEN 5e-1 ELSE 4e-1 END * correct), 0e0), 1e0) AS difficulty
FROM (SELECT id, model, correct FROM fx_outcomes WHERE model IN ('m1', 'm2', 'm3')
      UNION ALL SELECT DISTINCT id, 'none', 0 FROM fx_outcomes)
GROUP BY id
""", rounded=["difficulty"])
def weighted_difficulty(spark, sf_dir):
    wide = build_outcomes_wide(view(spark, sf_dir, "fx_outcomes"), ["m1", "m2", "m3"])
    return difficulty_score(wide, {"is_correct_m1": 0.3, "is_correct_m2": 0.5, "is_correct_m3": 0.4}).select("id", "difficulty")


@query(f"""
WITH cut AS (SELECT quantile_cont(llm_output_tokens, 95e-2) AS c FROM fx_pairs WHERE NOT {HELD})
SELECT id, CASE WHEN {HELD} THEN 'test' ELSE 'train' END AS split, CASE WHEN llm_output_tokens > c THEN 1 ELSE 0 END AS high_cost
FROM fx_pairs, cut
""", ints=["high_cost"])
def high_cost_labels(spark, sf_dir):
    pairs = random_split(view(spark, sf_dir, "fx_pairs"), "id")
    train, test = label_high_cost(pairs.where("split = 'train'"), pairs.where("split = 'test'"))
    return train.select("id", F.lit("train").alias("split"), "high_cost").unionByName(
        test.select("id", F.lit("test").alias("split"), "high_cost")
    )


@query(f"""
WITH cut AS (SELECT quantile_cont(llm_output_tokens, 95e-2) AS c, avg(llm_input_tokens) AS i FROM fx_pairs WHERE NOT {HELD})
SELECT c AS cut_tokens, i * 125e-8 + c * 1e-5 AS usd_at_cut,
       (SELECT avg(CASE WHEN llm_output_tokens > c THEN 1e0 ELSE 0e0 END) FROM fx_pairs WHERE NOT {HELD}) AS train_share,
       (SELECT avg(CASE WHEN llm_output_tokens > c THEN 1e0 ELSE 0e0 END) FROM fx_pairs WHERE {HELD}) AS test_share
FROM cut
""", rounded=["cut_tokens", "usd_at_cut", "train_share", "test_share"])
def high_cost_summary(spark, sf_dir):
    pairs = random_split(view(spark, sf_dir, "fx_pairs"), "id")
    return high_cost_report(pairs.where("split = 'train'"), pairs.where("split = 'test'"))


@query("""
WITH e AS (SELECT list_sort(list_distinct(quantile_cont(latency, [0e0, 25e-2, 5e-1, 75e-2, 1e0]))) AS e FROM fx_outcomes)
SELECT id, model, CAST(len(list_filter(e[2:len(e) - 1], lambda x: x < latency)) AS BIGINT) AS bin FROM fx_outcomes, e
""", ints=["bin"])
def latency_quartiles(spark, sf_dir):
    return quantile_bins(view(spark, sf_dir, "fx_outcomes"), "latency").select("id", "model", "bin")


@query("""
SELECT slm_accuracy_fraction, count(*) AS n, count(*) * 1e2 / (SELECT count(*) FROM fx_fraction) AS pct
FROM fx_fraction GROUP BY slm_accuracy_fraction
""", rounded=["slm_accuracy_fraction", "pct"])
def fraction_counts(spark, sf_dir):
    return label_distribution(view(spark, sf_dir, "fx_fraction"), "slm_accuracy_fraction")
