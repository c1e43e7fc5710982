from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from answerflow.functions.vectors import l2_normalize
from answerflow.operators.geometry import (
    davies_bouldin,
    distance_label_spearman,
    distance_label_spearman_estimate,
    embedding_report,
    mean_cosine_spread,
    sampled_silhouette,
    silhouette,
)
from answerflow.plans.features import encode, fit_pca, text_features, vector_column
from answerflow.plans.subspace import fit_components
from checks.registry import query
from checks.views import view

V = "v AS (SELECT id, cluster, complex, difficulty, CAST(embedding AS DOUBLE[]) AS e FROM fx_vectors)"
UNIT = "u AS (SELECT id, difficulty, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v)"


@query(f"""
WITH {V}, {UNIT} SELECT id, e[1] AS first, e[len(e)] AS last, sqrt(list_inner_product(e, e)) AS length FROM u
""", rounded=["first", "last", "length"])
def unit_vectors(spark, sf_dir):
    unit = view(spark, sf_dir, "fx_vectors").select("id", l2_normalize(F.col("embedding")).alias("e"))
    length = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))
    return unit.select("id", F.col("e")[0].alias("first"), F.element_at("e", -1).alias("last"), length.alias("length"))


@query(f"""
WITH {V}, {UNIT},
p AS (SELECT unnest(e) AS x, unnest(range(1, len(e) + 1)) AS i FROM u),
s AS (SELECT i, sum(x) AS t FROM p GROUP BY i)
SELECT (SELECT count(*) FROM u) AS n, 1e0 - sum(t * t) / power((SELECT count(*) FROM u), 2) AS mean_cosine_distance FROM s
""", rounded=["mean_cosine_distance"])
def cosine_spread(spark, sf_dir):
    return mean_cosine_spread(view(spark, sf_dir, "fx_vectors"))


DAVIES = """
p_{l} AS (SELECT {l} AS g, unnest(e) AS x, unnest(range(1, len(e) + 1)) AS i FROM {src}),
m_{l} AS (SELECT g, i, avg(x) AS x FROM p_{l} GROUP BY g, i),
c_{l} AS (SELECT g, list(x ORDER BY i) AS c FROM m_{l} GROUP BY g),
s_{l} AS (SELECT {l} AS g, c, avg(list_distance(e, c)) AS s FROM {src} JOIN c_{l} ON {l} = g GROUP BY {l}, c),
w_{l} AS (SELECT a.g, max((a.s + b.s) / list_distance(a.c, b.c)) AS worst FROM s_{l} a JOIN s_{l} b ON a.g <> b.g GROUP BY a.g)
"""


@query(f"WITH {V}, {DAVIES.format(l='cluster', src='v')} SELECT count(*) AS clusters, avg(worst) AS davies_bouldin FROM w_cluster",
       rounded=["davies_bouldin"])
def davies_bouldin_index(spark, sf_dir):
    return davies_bouldin(view(spark, sf_dir, "fx_vectors"), "cluster")


# `pow` 2 for the squared distances of the silhouette over all rows, 1 for the sampled one.
SILHOUETTE = """
d_{l} AS (SELECT a.id, a.{l} AS own, b.{l} AS other, sum(power(list_distance(a.e, b.e), {pow})) AS t, count(*) AS n
      FROM {src} a, {src} b GROUP BY a.id, a.{l}, b.{l}),
r_{l} AS (SELECT id, max(CASE WHEN own = other THEN n END) AS size,
             max(CASE WHEN own = other AND n > 1 THEN t / (n - 1) END) AS a, min(CASE WHEN own <> other THEN t / n END) AS b
      FROM d_{l} GROUP BY id)
"""
SIL_VALUE = "avg(CASE WHEN size = 1 THEN 0e0 ELSE (b - a) / greatest(a, b) END)"
# Rows of the rank correlation and of the Euclidean silhouette, as the reference has them.
SAMPLE, SILHOUETTE_SAMPLE = 10_000, 5_000


def sampled(source: str, name: str = "s", rows: int = SAMPLE) -> str:
    """The rows with the smallest seeded hashes."""
    return f"{name} AS (SELECT * FROM {source} ORDER BY md5('42|' || CAST(id AS STRING)) LIMIT {rows})"


@query(f"WITH {V}, {SILHOUETTE.format(l='complex', src='v', pow=2)} SELECT count(*) AS n, {SIL_VALUE} AS silhouette FROM r_complex",
       rounded=["silhouette"])
def silhouette_index(spark, sf_dir):
    return silhouette(view(spark, sf_dir, "fx_vectors"), "complex")


@query(f"""
WITH {V}, {sampled('v', rows=SILHOUETTE_SAMPLE)}, {SILHOUETTE.format(l='complex', src='s', pow=1)}
SELECT count(*) AS rows_used, (SELECT count(*) FROM v) AS rows_total, {SIL_VALUE} AS silhouette FROM r_complex
""", rounded=["silhouette"])
def sampled_silhouette_index(spark, sf_dir):
    return sampled_silhouette(view(spark, sf_dir, "fx_vectors"), "complex", SILHOUETTE_SAMPLE)


SPEARMAN = """
pairs_{t} AS (SELECT round(1e0 - list_inner_product(a.e, b.e), 6) AS d, round(abs(a.difficulty - b.difficulty), 12) AS g
          FROM {src} a, {src} b WHERE a.id < b.id AND a.e <> b.e),
rk_{t} AS (SELECT rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2e0 AS rd,
              rank() OVER (ORDER BY g) + (count(*) OVER (PARTITION BY g) - 1) / 2e0 AS rg FROM pairs_{t})
"""


@query(f"""
WITH {V}, {UNIT}, {sampled('u')}, {SPEARMAN.format(t='all', src='s')}
SELECT count(*) AS n_pairs, (SELECT count(*) FROM s) AS rows_used, (SELECT count(*) FROM u) AS rows_total, corr(rd, rg) AS spearman FROM rk_all
""", rounded=["spearman"], digits=5)
def distance_label_correlation(spark, sf_dir):
    return distance_label_spearman(view(spark, sf_dir, "fx_vectors"), "difficulty", SAMPLE)


# Rows of a block of the estimate.
BLOCK = 256


@query(f"""
WITH {V}, {UNIT},
o AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || CAST(id AS STRING)), id) - 1 AS pos, count(*) OVER () AS total FROM u),
b AS (SELECT *, floor(pos * ((total + {BLOCK - 1}) // {BLOCK}) / total) AS block FROM o),
p AS (SELECT x.block, round(1e0 - list_inner_product(x.e, y.e), 6) AS d, round(abs(x.difficulty - y.difficulty), 12) AS g
      FROM b x JOIN b y ON x.block = y.block AND x.pos < y.pos WHERE x.e <> y.e),
k AS (SELECT block, rank() OVER (PARTITION BY block ORDER BY d) + (count(*) OVER (PARTITION BY block, d) - 1) / 2e0 AS rd,
             rank() OVER (PARTITION BY block ORDER BY g) + (count(*) OVER (PARTITION BY block, g) - 1) / 2e0 AS rg FROM p),
c AS (SELECT block, count(*) AS n, corr(rd, rg) AS r FROM k GROUP BY block),
m AS (SELECT sum(n * r) / sum(n) AS mean, CAST(count(*) AS DOUBLE) AS blocks FROM c)
SELECT sum(n) AS n_pairs, count(*) AS blocks, (SELECT count(*) FROM v) AS rows_used, (SELECT count(*) FROM v) AS rows_total,
       (SELECT mean FROM m) AS spearman,
       sqrt(sum(power(n * (r - (SELECT mean FROM m)), 2))) / sum(n) * sqrt((SELECT blocks / (blocks - 1) FROM m)) AS standard_error
FROM c
""", rounded=["spearman", "standard_error"], ints=["n_pairs"], digits=5)
def distance_label_estimate(spark, sf_dir):
    return distance_label_spearman_estimate(view(spark, sf_dir, "fx_vectors"), "difficulty", BLOCK)


# Rows of the first cluster play the simple questions (fraction 1).
def binned(source: str) -> str:
    q = [f"(SELECT quantile_cont(f, {p}) FROM {source})" for p in ("25e-2", "5e-1", "75e-2")]
    bins = " ".join(f"WHEN f <= {q} THEN {i}" for i, q in enumerate(q))
    return f"SELECT *, f AS difficulty, CASE {bins} ELSE 3 END AS bin FROM {source}"


REPORT = f"""
q AS (SELECT id, CASE WHEN cluster = 0 THEN 1e0 ELSE 1e0 - difficulty END AS f, cluster = 0 AS simple,
             CASE WHEN cluster = 0 THEN 0 ELSE complex END AS label, e FROM v),
qm AS (SELECT * FROM q WHERE NOT simple),
b AS ({binned('q')}),
bm AS (SELECT *, label AS label_m, bin AS bin_m FROM ({binned('qm')})),
bu AS (SELECT * REPLACE (list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e) FROM b),
bmu AS (SELECT * REPLACE (list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e) FROM bm)
"""


@query(f"""
WITH {V}, {REPORT}, {DAVIES.format(l='label', src='b')}, {SILHOUETTE.format(l='label', src='b', pow=2)},
{SILHOUETTE.format(l='bin', src='b', pow=2)}, {sampled('bu', 'bus')}, {SPEARMAN.format(t='all', src='bus')},
{DAVIES.format(l='label_m', src='bm')}, {SILHOUETTE.format(l='label_m', src='bm', pow=2)},
{SILHOUETTE.format(l='bin_m', src='bm', pow=2)}, {sampled('bmu', 'bmus')}, {SPEARMAN.format(t='main', src='bmus')},
sp AS (SELECT unnest(e) AS x, unnest(range(1, len(e) + 1)) AS i FROM bu WHERE simple),
ss AS (SELECT i, sum(x) AS t FROM sp GROUP BY i)
SELECT 'given' AS encoder, 'combined' AS subset, 'classification' AS task, (SELECT {SIL_VALUE} FROM r_label) AS silhouette,
       'davies_bouldin' AS measure, (SELECT avg(worst) FROM w_label) AS value
UNION ALL SELECT 'given', 'combined', 'regression', (SELECT {SIL_VALUE} FROM r_bin), 'spearman', (SELECT corr(rd, rg) FROM rk_all)
UNION ALL SELECT 'given', 'main', 'classification', (SELECT {SIL_VALUE} FROM r_label_m), 'davies_bouldin', (SELECT avg(worst) FROM w_label_m)
UNION ALL SELECT 'given', 'main', 'regression', (SELECT {SIL_VALUE} FROM r_bin_m), 'spearman', (SELECT corr(rd, rg) FROM rk_main)
UNION ALL SELECT 'given', 'simple', 'spread', NULL, 'mean_cosine_distance',
       1e0 - (SELECT sum(t * t) FROM ss) / power((SELECT count(*) FROM b WHERE simple), 2)
""", rounded=["silhouette", "value"], digits=5)
def embedding_quality_report(spark, sf_dir):
    simple = F.col("cluster") == 0
    rows = view(spark, sf_dir, "fx_vectors").select(
        "id", "embedding", simple.alias("is_simple"),
        F.when(simple, F.lit(0)).otherwise(F.col("complex")).alias("label"),
        F.when(simple, F.lit(1.0)).otherwise(1.0 - F.col("difficulty")).alias("slm_accuracy_fraction"),
    )
    return embedding_report({"given": rows}, SAMPLE)


@query("""
WITH c AS (SELECT id, list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''),
                  lambda c: CAST(length(lower(question)) - length(replace(lower(question), c, '')) AS DOUBLE)) AS e FROM fx_questions)
SELECT id, list_position(e, list_max(e)) AS commonest, len(list_filter(e, lambda x: x = 0e0)) AS unused, len(e) AS dims
FROM c
""", ints=["commonest", "unused", "dims"])
def encoded_questions(spark, sf_dir):
    def make():
        def letter_counts(texts: np.ndarray) -> np.ndarray:
            return np.array([[t.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts])

        return letter_counts

    encoded = encode(view(spark, sf_dir, "fx_questions"), "question", make)
    return encoded.select(
        "id", F.array_position("embedding", F.array_max("embedding")).alias("commonest"),
        F.size(F.filter("embedding", lambda x: x == 0)).alias("unused"), F.size("embedding").alias("dims"),
    )


# A hashed text has at most as many non-zeros as words, and unit length unless it has no words.
@query("""
SELECT id, true AS sparse, CASE WHEN question = '' THEN 0e0 ELSE 1e0 END AS length FROM fx_questions
""", rounded=["length"])
def hashed_text_features(spark, sf_dir):
    questions = view(spark, sf_dir, "fx_questions").select("id", "question")
    features = text_features().fit(questions).transform(questions)
    values = F.filter(vector_to_array("features"), lambda x: x != 0)
    words = F.size(F.split("question", r"[\s\p{Punct}]+"))
    return features.select(
        "id", (F.size(values) <= words * 2).alias("sparse"),
        F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x)).alias("length"),
    )


@query("SELECT count(*) AS n, 64 AS dims, true AS falling, sum(v) AS variance FROM (" + """
SELECT var_samp(x) AS v FROM (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM fx_vectors) GROUP BY i)
""".replace("SELECT var_samp", "SELECT var_samp"), rounded=["variance"], ints=["dims"])
def projected_vectors(spark, sf_dir):
    """A projection onto as many components as there are dimensions keeps the variance, and the
    components' variances fall."""
    vectors = vector_column(view(spark, sf_dir, "fx_vectors"))
    projected = fit_pca(vectors, 64).transform(vectors).select(vector_to_array("pca_features").alias("v"))
    spread = projected.agg(*[F.var_samp(F.col("v")[i]).alias(f"c{i}") for i in range(64)])
    every = F.array(*[f"c{i}" for i in range(64)])
    falling = F.forall(F.zip_with(every, F.slice(every, 2, 63), lambda a, b: F.coalesce(a >= b - 1e-9, F.lit(True))), lambda x: x)
    return spread.select(
        F.lit(64).cast("bigint").alias("n"), F.lit(64).alias("dims"), falling.alias("falling"),
        F.aggregate(every, F.lit(0.0), lambda a, x: a + x).alias("variance"),
    )


@query()
def leading_components(spark, sf_dir):
    """The 16 leading directions of all vectors by subspace iteration, with the spread along each.
    No SQL: eigenvectors can't be said in it; a test compares them with a decomposition of the
    covariance matrix."""
    vectors = view(spark, sf_dir, "fx_vectors")
    found = fit_components(vectors, 16)
    projected = found.transform(vectors).select(F.posexplode("components").alias("component", "x"))
    return projected.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.round(F.var_samp("x"), 6).alias("variance"))
