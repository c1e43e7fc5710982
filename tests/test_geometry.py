import numpy as np
import pytest
from pyspark.sql import functions as F

from answerflow.operators.geometry import distance_label_spearman, distance_label_spearman_estimate
from answerflow.plans.subspace import fit_components
from checks import QUERIES
from checks.views import view


def clustered(spark, n, seed, dims=12):
    rng = np.random.default_rng(seed)
    where = rng.integers(0, 6, n)
    vectors = rng.standard_normal((6, dims))[where] + 0.6 * rng.standard_normal((n, dims))
    labels = where / 5 + 0.2 * rng.standard_normal(n)
    rows = [(i, v.tolist(), float(x)) for i, (v, x) in enumerate(zip(vectors, labels))]
    return spark.createDataFrame(rows, "id long, embedding array<double>, label double").repartition(4)


def test_estimate_covers_the_exact_value(spark):
    """Over seeds the interval of two standard errors has the exact correlation about as often as
    it should, and more rows in a block narrow it."""
    df = clustered(spark, 1500, 1).cache()
    exact = distance_label_spearman(df, "label", 1500).first().spearman
    got = [distance_label_spearman_estimate(df, "label", 100, seed=s).first() for s in range(8)]
    assert all(r.rows_used == r.rows_total == 1500 and r.blocks == 15 and r.n_pairs == 15 * 4950 for r in got)
    assert sum(abs(r.spearman - exact) <= 2.2 * r.standard_error for r in got) >= 6
    assert all(0 < r.standard_error < 0.05 for r in got)


def test_estimate_in_one_block_is_exact(spark):
    df = clustered(spark, 200, 2)
    one = distance_label_spearman_estimate(df, "label", 1000).first()
    exact = distance_label_spearman(df, "label", 200).first()
    assert one.n_pairs == exact.n_pairs and one.spearman == pytest.approx(exact.spearman, abs=1e-9) and one.standard_error is None


def test_estimate_of_odd_rows(spark):
    """Nulls are left out, rows alike are cut into blocks too, without rows there is no value."""
    kind = "id long, embedding array<double>, label double"
    rows = [(1, [1.0, 0.0], 0.5)] * 300 + [(None, [0.0, 1.0], 0.1), (3, None, 0.2), (4, [1.0, 1.0], None), (5, [0.0, 0.0], 0.9)]
    got = distance_label_spearman_estimate(spark.createDataFrame(rows, kind), "label", 50).first()
    assert got.rows_used == 302 and got.rows_total == 304
    none = distance_label_spearman_estimate(spark.createDataFrame([], kind), "label").first()
    assert none.rows_used == none.n_pairs == 0 and none.spearman is None and none.standard_error is None


def covariance(vectors):
    values, directions = np.linalg.eigh(np.cov(vectors.T))
    return values[::-1], directions[:, ::-1]


def test_components_equal_the_exact_ones(spark):
    rng = np.random.default_rng(3)
    turn, _ = np.linalg.qr(rng.standard_normal((96, 96)))
    data = (rng.standard_normal((3000, 96)) * 0.9 ** np.arange(96)) @ turn.T + 5.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, embedding array<double>").repartition(7)
    found = fit_components(df, 20)
    values, directions = covariance(data)
    assert found.passes < 60 and np.allclose(found.variances, values[:20], rtol=1e-8)
    # The angle between the two subspaces, and each direction by itself.
    assert np.linalg.svd(directions[:, :20].T @ found.directions)[1].min() > 1 - 1e-8
    assert np.abs(np.sum(directions[:, :20] * found.directions, axis=0)).min() > 1 - 1e-5
    again = fit_components(df.repartition(2), 20)
    assert np.allclose(again.directions, found.directions, atol=1e-6)
    made = {r.id: r.components for r in found.transform(df).where("id < 5").collect()}
    assert all(np.allclose(made[i], (data[i] - data.mean(0)) @ found.directions, atol=1e-9) for i in range(5))


def test_components_of_odd_tables(spark):
    kind = "embedding array<double>"
    rows = [([1.0, 2.0],), (None,), ([3.0, 2.0],)]
    found = fit_components(spark.createDataFrame(rows, kind), 2)
    assert found.passes == 1 and np.allclose(found.variances, [2.0, 0.0])
    got = [r.components for r in found.transform(spark.createDataFrame(rows, kind)).collect()]
    assert got[1] is None and np.allclose(sorted(r[0] for r in got if r), [-1.0, 1.0])
    with pytest.raises(ValueError):
        fit_components(spark.createDataFrame([], kind), 1)
    with pytest.raises(ValueError):
        fit_components(spark.createDataFrame(rows, kind), 3)


def test_leading_components_query(spark, sf):
    vectors = np.array([r.embedding for r in view(spark, sf, "fx_vectors").select("embedding").collect()], np.float64)
    values, _ = covariance(vectors)
    got = QUERIES["leading_components"](spark, sf).orderBy("component").collect()
    assert len(got) == 16 and all(r.n == len(vectors) for r in got)
    assert np.allclose([r.variance for r in got], values[:16], rtol=1e-3)
