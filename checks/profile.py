from __future__ import annotations

from answerflow.operators.merge import vote_table
from answerflow.operators.profile import (
    accuracy_by_domain_and_model,
    accuracy_vs_latency,
    category_accuracy,
    category_vote_accuracy,
    macro_accuracy,
    pareto_curve,
    template_score_histogram,
    token_latency_correlation,
    token_latency_points,
    top_share,
    top_templates,
    vote_accuracy_by_model,
)
from answerflow.operators.prep import random_split
from checks.merge import FIVES, SINGLES
from checks.models import HELD
from checks.registry import query
from checks.views import run_sql, view

MODELS = [f"m{i}" for i in range(1, 8)]
DOMAINS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

# LLM tokens next to the consensus label; some counts are negative or missing.
TOKENS = """
SELECT f.id AS id, CASE WHEN f.id % 17 = 0 THEN -1 WHEN f.id % 19 = 0 THEN NULL ELSE o.output_tokens END AS output_tokens,
       f.slm_accuracy_fraction AS slm_accuracy_fraction
FROM fx_fraction f JOIN fx_outcomes o ON o.id = f.id WHERE o.model = 'm2'
"""
CURVE = f"""
WITH t AS ({TOKENS}),
c AS (SELECT id, output_tokens AS tokens, CASE WHEN slm_accuracy_fraction < 75e-2 THEN 1 ELSE 0 END AS complex
      FROM t WHERE output_tokens >= 0),
r AS (SELECT *, row_number() OVER w AS rank, sum(tokens) OVER w AS cum_tokens, sum(complex) OVER w AS cum_complex,
             count(*) OVER () AS n, sum(tokens) OVER () AS total
      FROM c WINDOW w AS (ORDER BY tokens DESC, id ROWS UNBOUNDED PRECEDING))
"""


@query(CURVE + """
SELECT id, tokens, complex, rank, cum_tokens, cum_tokens * 1e2 / total AS cum_tokens_pct, rank * 1e2 / n AS row_pct,
       cum_complex * 1e2 / rank AS cum_complex_pct, n
FROM r
""", rounded=["cum_tokens_pct", "row_pct", "cum_complex_pct"], ints=["tokens", "cum_tokens", "complex", "rank"])
def token_pareto_curve(spark, sf_dir):
    return pareto_curve(run_sql(spark, sf_dir, TOKENS))


@query(CURVE + """
SELECT n, rank AS rows, cum_tokens * 1e2 / total AS cum_tokens_pct, cum_complex * 1e2 / rank AS cum_complex_pct
FROM r WHERE rank = ceil(n * 2e-1)
""", rounded=["cum_tokens_pct", "cum_complex_pct"], ints=["rows"])
def token_top_share(spark, sf_dir):
    return top_share(pareto_curve(run_sql(spark, sf_dir, TOKENS)))


@query(f"""
SELECT model, {", ".join(f"avg(CASE WHEN dataset_name = '{d}' THEN correct END) * 1e2 AS p{d[0]}" for d in DOMAINS)},
       avg(correct) * 1e2 AS total
FROM fx_outcomes GROUP BY model
""", rounded=["total", *[f"p{i}" for i in range(1, 6)]])
def accuracy_by_domain(spark, sf_dir):
    wide = accuracy_by_domain_and_model(view(spark, sf_dir, "fx_outcomes"), DOMAINS, MODELS)
    return wide.withColumnsRenamed({d: f"p{d[0]}" for d in DOMAINS})


@query("SELECT model, avg(correct) * 1e2 AS total_accuracy, avg(latency) AS avg_latency FROM fx_outcomes GROUP BY model",
       rounded=["total_accuracy", "avg_latency"])
def accuracy_and_latency(spark, sf_dir):
    return accuracy_vs_latency(view(spark, sf_dir, "fx_outcomes"))


@query(f"""
SELECT category, {", ".join(f"avg(CASE WHEN model = '{m}' THEN correct END) AS {m}" for m in MODELS)}
FROM fx_outcomes GROUP BY category
""", rounded=MODELS)
def accuracy_by_category(spark, sf_dir):
    return category_accuracy(view(spark, sf_dir, "fx_outcomes"), MODELS)


@query("""
SELECT model, avg(a) AS macro_accuracy
FROM (SELECT model, category, avg(correct) AS a FROM fx_outcomes GROUP BY model, category) GROUP BY model
""", rounded=["macro_accuracy"])
def macro_average(spark, sf_dir):
    return macro_accuracy(view(spark, sf_dir, "fx_outcomes"))


@query(f"SELECT model, avg(CASE WHEN accuracy >= 8e-1 THEN 1e0 ELSE 0e0 END) AS accuracy FROM ({FIVES}) GROUP BY model",
       rounded=["accuracy"])
def vote_accuracy(spark, sf_dir):
    return vote_accuracy_by_model(run_sql(spark, sf_dir, FIVES))


def vote_means(models: list[str], version: str) -> str:
    names = ", ".join(f"'{m}'" for m in models)
    return f"""
    SELECT category, '{version}' AS version, avg(a) AS avg_vote_accuracy FROM (
      SELECT id, min(category) AS category, sum(correct) / {len(models)}e0 AS a FROM fx_outcomes
      WHERE model IN ({names}) GROUP BY id HAVING count(*) = {len(models)}) GROUP BY category"""


@query(vote_means(["m1", "m2", "m3", "m4", "m5"], "with m1") + " UNION ALL " + vote_means(["m2", "m3", "m4", "m5", "m6"], "with m6"),
       rounded=["avg_vote_accuracy"])
def vote_accuracy_by_category(spark, sf_dir):
    singles = run_sql(spark, sf_dir, SINGLES)
    first = vote_table(singles, ["m1", "m2", "m3", "m4", "m5"], "with m1", "QID")
    second = vote_table(singles, ["m2", "m3", "m4", "m5", "m6"], "with m6", "QID")
    columns = ["category", "version", "vote_accuracy"]
    return category_vote_accuracy(first.select(columns).unionByName(second.select(columns)))


# Every thirteenth question has an unreadable count, and its rows are dropped by the operator.
POINTS = """
SELECT CASE WHEN id % 13 = 0 THEN 'bad' ELSE CAST(input_tokens AS STRING) END AS input_tokens, output_tokens, latency FROM fx_outcomes
"""
READABLE = f"SELECT TRY_CAST(input_tokens AS DOUBLE) AS input_tokens, output_tokens, latency FROM ({POINTS})"


@query(f"""
SELECT input_tokens, CAST(output_tokens AS DOUBLE) AS output_tokens, latency FROM ({READABLE}) WHERE input_tokens IS NOT NULL
""", rounded=["input_tokens", "output_tokens", "latency"])
def token_points(spark, sf_dir):
    return token_latency_points(run_sql(spark, sf_dir, POINTS))


@query(f"""
SELECT count(*) AS n, corr(input_tokens, output_tokens) AS input_tokens_output_tokens,
       corr(input_tokens, latency) AS input_tokens_latency, corr(output_tokens, latency) AS output_tokens_latency
FROM ({READABLE}) WHERE input_tokens IS NOT NULL
""", rounded=["input_tokens_output_tokens", "input_tokens_latency", "output_tokens_latency"])
def token_correlation(spark, sf_dir):
    return token_latency_correlation(token_latency_points(run_sql(spark, sf_dir, POINTS)))


# Questions with a repeated template and a molecule part that differs.
ASKED = """
SELECT o.id AS id, concat('Which group of ', CAST(o.input_tokens % 23 AS STRING), '? SMILES: C', CAST(o.id AS STRING)) AS question,
       f.slm_accuracy_fraction AS slm_accuracy_fraction, ((o.id * 7919) % 1000) / 999e0 AS p
FROM fx_outcomes o JOIN fx_fraction f ON f.id = o.id WHERE o.model = 'm1'
"""
TOP = f"""
SELECT template, n, avg_fraction FROM (
  SELECT regexp_replace(question, '\\s+SMILES:.*$', '') AS template, count(*) AS n, avg(slm_accuracy_fraction) AS avg_fraction
  FROM ({ASKED}) GROUP BY regexp_replace(question, '\\s+SMILES:.*$', ''))
ORDER BY n DESC, template LIMIT 10
"""


@query(TOP, rounded=["avg_fraction"])
def frequent_templates(spark, sf_dir):
    return top_templates(run_sql(spark, sf_dir, ASKED))


@query(f"""
WITH top AS ({TOP}),
asked AS (SELECT regexp_replace(question, '\\s+SMILES:.*$', '') AS template,
                 CASE WHEN {HELD} THEN 'test' ELSE 'validation' END AS split, p FROM ({ASKED})),
counted AS (SELECT template, split, CAST(least(floor(p * 20), 19) AS INT) AS bin, count(*) AS n
            FROM asked WHERE template IN (SELECT template FROM top) GROUP BY 1, 2, 3),
grid AS (SELECT template, split, bin FROM (SELECT DISTINCT template, split FROM counted), (SELECT unnest(range(20)) AS bin))
SELECT g.template, g.split, g.bin, g.bin / 20e0 AS left_edge, coalesce(c.n, 0) AS n
FROM grid g LEFT JOIN counted c ON g.template = c.template AND g.split = c.split AND g.bin = c.bin
""", rounded=["left_edge"], ints=["bin", "n"])
def template_histograms(spark, sf_dir):
    asked = random_split(run_sql(spark, sf_dir, ASKED), "id")
    test, validation = asked.where("split = 'test'"), asked.where("split = 'train'")
    return template_score_histogram(test, validation, top_templates(asked))
