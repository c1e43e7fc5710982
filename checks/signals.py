from __future__ import annotations

from pyspark.sql import functions as F

from answerflow.functions.routes import extract_route, route_bucket
from answerflow.operators.batches import raw_route_counts, routed_batch_summary
from answerflow.operators.signals import (
    Rule,
    apply_rules,
    category_action,
    contrast_signal,
    group_margin,
    nearest_prototype_signal,
    top_similarities,
)
from checks.registry import query
from checks.views import run_sql, view

ROUTE = """CASE id % 5 WHEN 0 THEN 'small' WHEN 1 THEN 'big' WHEN 2 THEN 'qwen-7b' WHEN 3 THEN 'gpt-5' END"""
BUCKET = """CASE id % 5 WHEN 0 THEN 'slm' WHEN 1 THEN 'llm' WHEN 2 THEN 'slm' WHEN 3 THEN 'llm' ELSE 'default' END"""


@query(f"SELECT id, {ROUTE} AS route FROM fx_replies")
def reply_routes(spark, sf_dir):
    return view(spark, sf_dir, "fx_replies").select("id", extract_route(F.col("reply")).alias("route"))


@query(f"SELECT id, {BUCKET} AS bucket, CASE WHEN id % 5 < 4 THEN {BUCKET} ELSE 'slm' END AS strict_bucket FROM fx_replies")
def route_buckets(spark, sf_dir):
    route = extract_route(F.col("reply"))
    return view(spark, sf_dir, "fx_replies").select(
        "id", route_bucket(route).alias("bucket"),
        route_bucket(F.coalesce(route, F.lit("Small")), strict=True).alias("strict_bucket"),
    )


# A batch of routed questions: the five kinds of replies in turn say where a pair went.
BATCH = "SELECT p.*, r.reply FROM fx_pairs p JOIN (SELECT DISTINCT id % 5 AS kind, reply FROM fx_replies) r ON r.kind = p.id % 5"


@query(f"""
WITH b AS (SELECT id AS i, dataset_name, {BUCKET} AS bucket, slm_correct AS sc, llm_correct AS lc, slm_latency, llm_latency,
                  llm_input_tokens AS ti, llm_output_tokens AS t_o FROM ({BATCH})),
s AS (SELECT dataset_name, count(*) AS n, count(*) FILTER (WHERE bucket = 'slm') AS n_slm, count(*) FILTER (WHERE bucket = 'llm') AS n_llm,
             count(*) FILTER (WHERE bucket = 'default') AS n_default, coalesce(sum(sc) FILTER (WHERE bucket = 'slm'), 0) AS slm_correct,
             coalesce(sum(lc) FILTER (WHERE bucket = 'llm'), 0) AS llm_correct,
             coalesce(sum(slm_latency) FILTER (WHERE bucket = 'slm'), 0) AS slm_seconds,
             coalesce(sum(llm_latency) FILTER (WHERE bucket = 'llm'), 0) AS llm_seconds,
             coalesce(sum(ti) FILTER (WHERE bucket = 'llm'), 0) AS llm_input_tokens,
             coalesce(sum(t_o) FILTER (WHERE bucket = 'llm'), 0) AS llm_output_tokens
      FROM b GROUP BY dataset_name)
SELECT *, n_slm + n_llm AS n_routed, n_slm / CAST(n AS DOUBLE) AS slm_share, n_llm / CAST(n AS DOUBLE) AS llm_share,
       coalesce((slm_correct + llm_correct) / nullif(CAST(n_slm + n_llm AS DOUBLE), 0), 0) AS accuracy,
       slm_seconds + llm_seconds AS total_seconds, coalesce((slm_seconds + llm_seconds) / nullif(n_slm + n_llm, 0), 0) AS avg_seconds,
       llm_input_tokens * 125e-8 + llm_output_tokens * 1e-5 AS usd,
       coalesce((llm_input_tokens * 125e-8 + llm_output_tokens * 1e-5) / nullif(n_slm + n_llm, 0), 0) AS usd_per_question
FROM s
""", rounded=["slm_share", "llm_share", "accuracy", "slm_seconds", "llm_seconds", "total_seconds", "avg_seconds", "usd", "usd_per_question"],
       ints=["slm_correct", "llm_correct", "llm_input_tokens", "llm_output_tokens", "n_routed"], digits=5)
def batch_summary(spark, sf_dir):
    routed = run_sql(spark, sf_dir, BATCH).withColumn("bucket", route_bucket(extract_route(F.col("reply"))))
    return routed_batch_summary(routed, by=["dataset_name"])


@query(f"SELECT {ROUTE} AS route, count(*) AS n FROM fx_replies GROUP BY 1")
def route_counts(spark, sf_dir):
    return raw_route_counts(view(spark, sf_dir, "fx_replies").select(extract_route(F.col("reply")).alias("route")))


# The two lowest ids of every cluster stand in for the candidate sentences of a signal.
PROTOTYPES = """
SELECT id, cluster, CASE WHEN cluster >= 5 THEN 'hard' ELSE 'easy' END AS signal, embedding FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY id) AS rn FROM fx_vectors) WHERE rn <= 2
"""
COSINES = f"""
c AS (SELECT v.id, p.signal, p.cluster,
             list_inner_product(CAST(v.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[]))
             / sqrt(list_inner_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])))
             / sqrt(list_inner_product(CAST(p.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[]))) AS s
      FROM fx_vectors v, ({PROTOTYPES}) p),
k AS (SELECT *, row_number() OVER (PARTITION BY id, signal ORDER BY s DESC) AS rk FROM c),
t AS (SELECT id, signal, max(s) AS best, 75e-2 * max(s) + 25e-2 * avg(s) FILTER (WHERE rk <= 2) AS blend FROM k GROUP BY id, signal),
h AS (SELECT a.id, a.best AS hard_best, b.best AS easy_best, a.blend - b.blend AS margin FROM t a JOIN t b ON a.id = b.id
      AND a.signal = 'hard' AND b.signal = 'easy')
"""


def scored(spark, sf_dir):
    return top_similarities(view(spark, sf_dir, "fx_vectors"), run_sql(spark, sf_dir, PROTOTYPES))


@query(f"""
WITH {COSINES} SELECT id, hard_best AS complex_score, CASE WHEN hard_best >= 68e-2 THEN 1 ELSE 0 END AS complex FROM h
""", rounded=["complex_score"], ints=["complex"])
def prototype_signal(spark, sf_dir):
    return nearest_prototype_signal(scored(spark, sf_dir), "hard", 0.68, "complex").select("id", "complex_score", "complex")


@query(f"""
WITH {COSINES}
SELECT id, margin AS task_margin, CASE WHEN margin >= 2e-1 THEN 'hard' WHEN margin <= -2e-1 THEN 'easy' ELSE 'medium' END AS task FROM h
""", rounded=["task_margin"])
def hard_easy_contrast(spark, sf_dir):
    return contrast_signal(scored(spark, sf_dir), threshold=0.2, name="task").drop("tops")


@query(f"""
WITH {COSINES}
SELECT id, CASE WHEN hard_best >= 68e-2 OR margin >= 2e-1 THEN 'big' WHEN easy_best >= 74e-2 AND margin <= -2e-1 THEN 'small' ELSE 'big' END AS big_first,
       CASE WHEN easy_best >= 74e-2 AND margin <= -2e-1 THEN 'small' WHEN hard_best >= 68e-2 OR margin >= 2e-1 THEN 'big' ELSE 'small' END AS small_first
FROM h
""")
def routing_rules(spark, sf_dir):
    rows = contrast_signal(scored(spark, sf_dir), threshold=0.2, name="task")
    rows = nearest_prototype_signal(rows, "hard", 0.68, "complex")
    rows = nearest_prototype_signal(rows, "easy", 0.74, "simple")
    big = [F.col("complex") == 1, F.col("task") == "hard"]
    small = [F.col("simple") == 1, F.col("task") == "easy"]
    return rows.select(
        "id",
        apply_rules([Rule("small", 100, small), Rule("big", 110, big, any_of=True)], "big").alias("big_first"),
        apply_rules([Rule("big", 100, big, any_of=True), Rule("small", 110, small)], "small").alias("small_first"),
    )


# Clusters as knowledge-base subjects.
SUBJECTS = ["biology", "history", "math", "other", "economics", "law", "physics", "health", "chemistry", "engineering"]
SUBJECT = "CASE cluster " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SUBJECTS)) + " END"


@query(f"""
WITH {COSINES},
g AS (SELECT id, max(s) FILTER (WHERE cluster < 5) - max(s) FILTER (WHERE cluster >= 5) AS m FROM c GROUP BY id)
SELECT g.id, m AS escalate_vs_keep_margin, CASE WHEN m > 0 THEN 'escalate' ELSE 'keep' END AS escalate_vs_keep,
       CASE WHEN v.cluster < 5 THEN 'escalate' ELSE 'keep' END AS listed
FROM g JOIN fx_vectors v ON v.id = g.id
""", rounded=["escalate_vs_keep_margin"])
def subject_margin(spark, sf_dir):
    subjects = run_sql(spark, sf_dir, f"SELECT {SUBJECT} AS signal, embedding FROM ({PROTOTYPES})")
    rows = group_margin(
        top_similarities(view(spark, sf_dir, "fx_vectors"), subjects, m=1), SUBJECTS[:5], SUBJECTS[5:]
    ).drop("tops")
    listed = run_sql(spark, sf_dir, f"SELECT id, {SUBJECT} AS subject FROM fx_vectors")
    return rows.join(listed.select("id", category_action(F.col("subject")).alias("listed")), "id")
