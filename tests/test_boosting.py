"""Boosted trees against a plain leaf-by-leaf grower that tries every split."""

import heapq

import numpy as np
import pytest

from answerflow.plans import boosting
from answerflow.plans.boosting import BoostedClassifier, BoostedRegressor, derivatives, leaf_of, margins
from answerflow.plans.features import vector_column


def frame(spark, x, y, weight=None, parts=3):
    weight = np.ones(len(y)) if weight is None else weight
    rows = [(i, [float(v) for v in a], float(b), float(w)) for i, (a, b, w) in enumerate(zip(x, y, weight))]
    return vector_column(spark.createDataFrame(rows, "id long, embedding array<double>, label double, w double").repartition(parts))


def plain_tree(x, g, h, leaves, depth, ridge, least_weight, least_rows):
    """Splits in the order best-first growth makes them: (gain, feature, cut)."""

    def best(rows):
        out = (0.0, -1, 0.0)
        G, H = g[rows].sum(), h[rows].sum()
        for j in range(x.shape[1]):
            for cut in np.unique(x[rows, j])[:-1]:
                left = rows[x[rows, j] <= cut]
                right = rows[x[rows, j] > cut]
                if min(len(left), len(right)) < max(least_rows, 1) or min(h[left].sum(), h[right].sum()) < least_weight:
                    continue
                gain = g[left].sum() ** 2 / (h[left].sum() + ridge) + g[right].sum() ** 2 / (h[right].sum() + ridge) - G**2 / (H + ridge)
                if gain > out[0] + 1e-10:
                    out = (gain, j, cut)
        return out

    heap, made, value = [], [], np.zeros(len(g))
    count = 0

    def push(rows, d):
        nonlocal count
        value[rows] = -g[rows].sum() / (h[rows].sum() + ridge)
        found = best(rows) if d < depth and len(rows) >= 2 * max(least_rows, 1) else (0.0, -1, 0.0)
        if found[1] >= 0 and found[0] > 1e-12:
            heapq.heappush(heap, (-found[0], count, found, rows, d))
            count += 1

    push(np.arange(len(g)), 0)
    while heap and len(made) < leaves - 1:
        _, _, found, rows, d = heapq.heappop(heap)
        made.append(found)
        push(rows[x[rows, found[1]] <= found[2]], d + 1)
        push(rows[x[rows, found[1]] > found[2]], d + 1)
    return made, value


@pytest.mark.parametrize("classes", [True, False])
@pytest.mark.parametrize("leaves, depth, ridge", [(6, 99, 0.0), (64, 3, 1.0)])
def test_trees_are_those_of_a_plain_grower(spark, classes, leaves, depth, ridge):
    rng = np.random.default_rng(leaves)
    x = rng.integers(0, 12, size=(200, 4)) / 4.0
    y = ((x[:, 0] > 1) ^ (x[:, 1] > 2)).astype(float) if classes else x[:, 0] * x[:, 1] + rng.normal(size=200) / 5
    y = np.where(rng.random(200) < 0.1, 1 - y, y) if classes else y
    weight = rng.integers(1, 3, 200).astype(float)
    kind = BoostedClassifier if classes else BoostedRegressor
    settings = dict(rounds=4, rate=0.3, leaves=leaves, depth=0 if depth == 99 else depth, ridge=ridge, least_weight=0.5, least_rows=5)
    learned = kind(labelCol="label", weightCol="w", **settings).fit(frame(spark, x, y, weight)).arrays()
    mean = np.average(y, weights=weight)
    f = np.full(200, np.log(mean / (1 - mean)) if classes else mean)
    assert learned["start"] == pytest.approx(f[0])
    for a, b in zip(learned["offsets"], learned["offsets"][1:]):
        tree = learned["trees"][a:b]
        g, h = derivatives(f, y, weight, classes)
        made, value = plain_tree(x, g, h, leaves, depth, ridge, 0.5, 5)
        assert sorted((int(r[0]), r[2]) for r in tree if r[0] >= 0) == sorted((j, c) for _, j, c in made)
        assert np.allclose(tree[leaf_of(tree, x, 2), 5], 0.3 * value)
        f = f + 0.3 * value
    assert np.allclose(margins(learned, x), f)


def test_partitions_and_written_margins_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 3))
    y = (x[:, 0] > 0).astype(float)
    settings = dict(labelCol="label", rounds=6, least_rows=3)
    a = BoostedClassifier(**settings).fit(frame(spark, x, y, parts=1)).arrays()
    monkeypatch.setattr(boosting, "ROUNDS_WRITTEN", 2)
    b = BoostedClassifier(**settings).fit(frame(spark, x, y, parts=7)).arrays()
    assert np.allclose(a["trees"], b["trees"], atol=1e-9) and (a["offsets"] == b["offsets"]).all()


def test_passes_keep_the_cores_busy(spark, monkeypatch):
    seen = []
    summed = boosting.summed
    monkeypatch.setattr(boosting, "summed", lambda rows, work, finish, tasks: seen.append(tasks) or summed(rows, work, finish, tasks))
    rows = spark.range(40_000).selectExpr("id", "array(CAST(id % 7 AS DOUBLE), CAST(id % 3 AS DOUBLE)) AS embedding", "CAST(id % 7 > 3 AS DOUBLE) AS label")
    model = BoostedClassifier(labelCol="label", rounds=1, leaves=2).fit(vector_column(rows))
    assert model.arrays()["trees"][0][[0, 2]].tolist() == [0, 3]
    assert set(seen) == {min(3, spark.sparkContext.defaultParallelism)}


def test_leaves_of_chosen_rows():
    tree = np.array([[1, 2, 0.5, 1, 2, 0], [-1, 0, 0, 0, 0, 1], [0, 1, -3.0, 3, 4, 0], [-1, 0, 0, 0, 0, 2], [-1, 0, 0, 0, 0, 3]], float)
    values = np.array([[0, 2], [1, 3], [2, 3], [9, 0]], np.uint16)
    assert leaf_of(tree, values, 1).tolist() == [1, 3, 4, 1]
    assert leaf_of(tree, np.asfortranarray(values), 1, np.array([2, 0])).tolist() == [4, 1]
    # Values that are missing go right.
    assert leaf_of(tree, np.array([[-4.0, np.nan], [np.nan, 1.0], [5.0, 0.5]]), 2).tolist() == [3, 4, 1]


def test_awkward_rows(spark):
    x = np.array([[1.0, np.nan], [1.0, 2.0], [1.0, np.nan], [1.0, 3.0]] * 10)
    y = np.array([0.0, 1.0, 0.0, 1.0] * 10)
    model = BoostedClassifier(labelCol="label", rounds=20, rate=0.5, least_rows=1).fit(frame(spark, x, y))
    assert {(r.label, r.prediction) for r in model.transform(frame(spark, x, y)).collect()} == {(0.0, 0.0), (1.0, 1.0)}
    flat = BoostedRegressor(labelCol="label").fit(frame(spark, x[:, :1], y))
    assert {round(r.prediction, 9) for r in flat.transform(frame(spark, x[:, :1], y)).collect()} == {0.5}
    with pytest.raises(ValueError, match="no training rows"):
        BoostedRegressor(labelCol="label").fit(frame(spark, x, y).where("id < 0"))
