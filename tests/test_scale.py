"""Exactness when one key holds a large part of the rows, against brute force."""

import datetime as dt
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from answerflow.operators.geometry import (
    davies_bouldin,
    distance_label_spearman,
    mean_cosine_spread,
    sampled_silhouette,
    seeded_sample,
    silhouette,
)
from answerflow.operators.neighbours import nearest_neighbours
from answerflow.operators.ordering import SLICE, exact_percentiles, running_totals, slice_by_order
from answerflow.operators.prep import downsample_majority, stratified_sample, stratified_split
from answerflow.operators.profile import pareto_curve
from answerflow.operators.signals import top_similarities
from answerflow.streaming.cascade import resolve_cascades
from checks import QUERIES


@pytest.fixture(scope="module")
def skewed(spark):
    """9,000 rows: a third in one group, which also shares one value."""
    group = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7))
    value = F.when(F.col("id") % 3 == 0, 5.0).otherwise((F.col("id") * 37 % 101).cast("double"))
    return spark.range(9000).select("id", group.alias("g"), value.alias("x")).cache()


def test_running_totals_cut_a_value_held_by_a_third(skewed):
    order = [F.col("x").asc(), F.col("id").asc()]
    sliced = slice_by_order(skewed, order, 6)
    largest = sliced.groupBy(SLICE).count().agg(F.max("count")).first()[0]
    assert largest < 2500
    got = running_totals(sliced, order, {"rank": F.lit(1), "total": F.col("x")}).orderBy("rank").toPandas()
    want = skewed.toPandas().sort_values(["x", "id"])
    assert (got["id"].to_numpy() == want["id"].to_numpy()).all()
    assert np.allclose(got["total"], want["x"].cumsum())


@pytest.mark.parametrize("accuracy", [10_000, 100])
def test_percentiles_per_group(skewed, monkeypatch, accuracy):
    import answerflow.operators.ordering as ordering

    # With the coarser sketch the brackets are parts of the groups.
    monkeypatch.setattr(ordering, "SKETCH_ACCURACY", accuracy)
    got = exact_percentiles(skewed, "x", [0.0, 0.1, 0.5, 0.95, 1.0], ["g"]).toPandas().set_index("g")
    for g, rows in skewed.toPandas().groupby("g"):
        want = np.percentile(rows["x"], [0, 10, 50, 95, 100])
        assert np.allclose(got.loc[g, [f"q{i}" for i in range(5)]].astype(float), want)


def test_percentiles_keep_a_missing_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "g string, x double")
    got = {r.g: (r.n, r.q0) for r in exact_percentiles(df, "x", [0.5], ["g"]).collect()}
    assert got == {None: (2, 2.0), "a": (1, 2.0)}


def test_exact_sample_sizes(skewed):
    sizes = {r.g: r["count"] for r in skewed.groupBy("g").count().collect()}
    taken = {r.g: r["count"] for r in stratified_sample(skewed, ["g"], "id", 0.1).groupBy("g").count().collect()}
    assert taken == {g: round(0.1 * n) for g, n in sizes.items()}


def test_sample_does_not_depend_on_partitions(skewed):
    a = {r.id for r in stratified_sample(skewed.repartition(3), ["g"], "id", 0.1, seed=7).collect()}
    b = {r.id for r in stratified_sample(skewed.repartition(11), ["g"], "id", 0.1, seed=7).collect()}
    c = {r.id for r in stratified_sample(skewed, ["g"], "id", 0.1, seed=8).collect()}
    assert a == b and a != c


def test_split_covers_all_rows(spark):
    df = spark.createDataFrame([(i, None if i < 10 else "a") for i in range(30)], "id int, g string")
    rows = stratified_split(df, ["g"], "id", 0.2).groupBy("g", "split").count().collect()
    assert {(r.g, r.split): r["count"] for r in rows} == {
        (None, "test"): 2, (None, "train"): 8, ("a", "test"): 4, ("a", "train"): 16,
    }


def test_downsampling_only_cuts_the_majority(spark):
    more = spark.range(100).select("id", (F.col("id") < 70).cast("int").alias("y"))
    fewer = spark.range(100).select("id", (F.col("id") < 20).cast("int").alias("y"))
    count = lambda df: {r.y: r["count"] for r in downsample_majority(df, "y", "id").groupBy("y").count().collect()}
    assert count(more) == {0: 30, 1: 30}
    assert count(fewer) == {0: 80, 1: 20}


def test_sample_of_fixed_size(skewed):
    assert seeded_sample(skewed, "id", 100).count() == 100
    assert seeded_sample(skewed, "id", 10**6).count() == 9000


def test_pareto_curve_with_ties(skewed):
    df = skewed.select("id", F.col("x").alias("output_tokens"), F.lit(0.5).alias("slm_accuracy_fraction"))
    got = pareto_curve(df).orderBy("rank").toPandas()
    want = skewed.toPandas().sort_values(["x", "id"], ascending=[False, True])
    assert (got["id"].to_numpy() == want["id"].to_numpy()).all()
    assert np.allclose(got["cum_tokens_pct"], want["x"].cumsum() / want["x"].sum() * 100)
    assert got["cum_complex_pct"].eq(100).all()


def vectors(spark, n, d, seed, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d)) * 3
    which = rng.integers(0, 6, n)
    data = centres[which] + rng.normal(size=(n, d))
    data[:copies] = data[0]
    rows = [(i, [float(x) for x in v], int(c)) for i, (v, c) in enumerate(zip(data, which))]
    return spark.createDataFrame(rows, "id long, embedding array<double>, cluster int"), data, which


def test_neighbours_against_brute_force(spark):
    # A third of the training rows are one and the same vector.
    train, data, which = vectors(spark, 600, 8, 1, copies=200)
    queries, asked, _ = vectors(spark, 90, 8, 2, copies=3)
    asked = np.vstack([asked, data[:1]])
    queries = queries.unionByName(spark.createDataFrame([(90, [float(x) for x in data[0]], 0)], queries.schema))
    got = nearest_neighbours(queries, train, "cluster", k=5, block_rows=64).toPandas()
    gaps = np.round(np.sqrt(((asked[:, None, :] - data[None, :, :]) ** 2).sum(2)), 9)
    for q in range(len(asked)):
        order = np.lexsort((np.arange(len(data)), gaps[q]))[:5]
        mine = got[got["id"] == q].sort_values("rank")
        assert mine["neighbour"].tolist() == order.tolist()


def test_fewer_rows_than_neighbours(spark):
    train, _, _ = vectors(spark, 3, 4, 3)
    queries, _, _ = vectors(spark, 5, 4, 4)
    assert nearest_neighbours(queries, train, "cluster", k=5).groupBy("id").count().where("count <> 3").count() == 0


def brute_silhouette(gaps, which):
    scores = []
    for i in range(len(gaps)):
        own = which == which[i]
        a = gaps[i, own].sum() / (own.sum() - 1)
        b = min(gaps[i, which == c].mean() for c in set(which) - {which[i]})
        scores.append((b - a) / max(a, b))
    return np.mean(scores)


def test_silhouettes_against_brute_force(spark):
    df, data, which = vectors(spark, 300, 5, 5)
    squared = ((data[:, None, :] - data[None, :, :]) ** 2).sum(2)
    assert silhouette(df, "cluster").first().silhouette == pytest.approx(brute_silhouette(squared, which), abs=1e-6)
    got = sampled_silhouette(df, "cluster", 1000).first()
    assert got.silhouette == pytest.approx(brute_silhouette(np.sqrt(squared), which), abs=1e-6)
    assert (got.rows_used, got.rows_total) == (300, 300)
    assert sampled_silhouette(df, "cluster", 100).first().rows_used == 100


def test_silhouette_is_over_all_rows(spark):
    assert silhouette(vectors(spark, 6000, 3, 11)[0], "cluster").first().n == 6000


def test_coincident_centroids_and_single_clusters(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [3.0]), (1, [0.0]), (1, [4.0])], "cluster int, embedding array<double>")
    assert davies_bouldin(df, "cluster").first().davies_bouldin == 0
    with pytest.raises(Exception, match="two clusters"):
        davies_bouldin(df.where("cluster = 0"), "cluster").collect()


def test_long_lines_are_scanned_once(spark):
    from answerflow.functions.text import extract_choice

    text = "answer " * 60_000 + "\n" + " " * 200_000 + "x\nfinal answer: B " + "word " * 60_000
    start = time.time()
    row = spark.createDataFrame([(text,), ("w " * 200_000,)], "t string").select(extract_choice(F.col("t")).alias("c")).collect()
    assert [r.c for r in row] == ["B", None]
    assert time.time() - start < 30


def test_spread_equals_all_pairs(spark):
    df, data, _ = vectors(spark, 200, 5, 6)
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    assert mean_cosine_spread(df).first().mean_cosine_distance == pytest.approx((1 - unit @ unit.T).mean(), abs=1e-9)


def test_spearman_against_pandas(spark):
    df, data, which = vectors(spark, 120, 5, 7)
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    upper = np.triu_indices(len(data), 1)
    far = np.round(1 - unit @ unit.T, 6)[upper]
    gap = np.abs(which[:, None] - which[None, :])[upper]
    keep = np.ones(len(far), bool)
    want = np.corrcoef(pd.Series(far[keep]).rank(), pd.Series(gap[keep]).rank())[0, 1]
    assert distance_label_spearman(df, "cluster", 500).first().spearman == pytest.approx(want, abs=1e-5)


def test_spearman_of_a_sample(spark):
    got = distance_label_spearman(vectors(spark, 120, 5, 7)[0], "cluster", 40).first()
    assert (got.n_pairs, got.rows_used, got.rows_total) == (40 * 39 // 2, 40, 120)


def test_geometry_queries_use_all_given_rows(spark):
    from checks.geometry import distance_label_correlation, sampled_silhouette_index

    for query in (distance_label_correlation, sampled_silhouette_index):
        got = query(spark, "/root/testdata/sf0.1").first()
        assert got.rows_used == got.rows_total > 300


def test_vectors_are_numbered_in_ranges(spark, sf, monkeypatch):
    from checks import workflows

    monkeypatch.setattr(workflows, "replay_policies", lambda scored, *a, **b: scored)
    scored = workflows.replay_with_neighbour_scores(spark, sf)
    assert "windowspecdefinition(vector" not in scored._jdf.queryExecution().analyzed().toString()


def test_prototypes_against_brute_force(spark, monkeypatch):
    df, data, _ = vectors(spark, 80, 6, 8)
    protos, centres, which = vectors(spark, 30, 6, 9)
    protos = protos.select(F.concat(F.lit("s"), F.col("cluster") % 2).alias("signal"), "embedding")
    nothing = spark.createDataFrame([(None, [1.0] * 6), ("s0", None)], protos.schema)
    df = df.select("id", "embedding").unionByName(spark.createDataFrame([(80, None)], "id long, embedding array<double>"))
    unit, other = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (data, centres))
    got = {r.id: r.tops for r in top_similarities(df, protos.unionByName(nothing)).collect()}
    assert got[80] == {}
    for i in range(80):
        for s in (0, 1):
            want = np.sort(unit[i] @ other[which % 2 == s].T)[::-1][:2]
            assert np.allclose(got[i][f"s{s}"], want)
    assert all(r.tops == {} for r in top_similarities(df, protos.where("1 = 0")).collect())


def test_cascades_of_one_busy_session(spark):
    rng = np.random.default_rng(10)
    kinds = ["start", "satisfied", "escalate", "up"]
    seconds = np.sort(rng.integers(0, 200_000, 3000))
    rows = [
        (int(i), 1 if i % 3 else int(i % 50), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=int(s)), kinds[rng.integers(0, 4)])
        for i, s in enumerate(seconds)
    ]
    df = spark.createDataFrame(rows, "response_id long, session_id long, ts timestamp, kind string")
    got = {r.response_id: (r.outcome, r.resolved_at) for r in resolve_cascades(df, 300).collect()}
    want = {}
    by_session = {}
    for r in rows:
        if r[3] != "up":
            by_session.setdefault(r[1], []).append(r)
    for events in by_session.values():
        for a, b in zip(events, events[1:] + [None]):
            if a[3] != "start":
                continue
            if b is not None and (b[2] - a[2]).total_seconds() <= 300:
                outcome = {"start": "abandoned", "satisfied": "satisfied", "escalate": "escalated"}[b[3]]
                want[a[0]] = (outcome, b[2])
            else:
                want[a[0]] = ("abandoned", a[2] + dt.timedelta(seconds=300))
    assert got == want


@pytest.mark.parametrize("name", ["policy_replay", "calibration", "wide_outcomes", "knn_classifier", "threshold_sweeps", "token_pareto_curve"])
def test_plans_have_no_cross_join(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("name", ["policy_replay", "choice_grades", "math_grades", "calibration", "sample_per_category"])
def test_hot_paths_stay_out_of_python(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan
