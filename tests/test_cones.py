import numpy as np
import pytest

from answerflow.operators import cones
from answerflow.operators.signals import top_similarities


def brute(rows, protos, m):
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    out = {}
    for signal in {s for s, _ in protos}:
        own = unit(np.array([v for s, v in protos if s == signal], float))
        cosines = unit(np.array(list(rows.values()), float)) @ own.T
        for i, row in zip(rows, -np.sort(-cosines, axis=1)[:, :m]):
            out.setdefault(i, {})[signal] = row.tolist()
    return out


def clustered(n, centres, rng, noise=0.15):
    return centres[rng.integers(0, len(centres), n)] + noise * rng.standard_normal((n, centres.shape[1]))


def test_cones_equal_brute_force_and_prune(spark, monkeypatch):
    """Signals of very different sizes, repeated and zero prototypes, a part cut in several: the
    same as all comparisons, while clustered rows visit a small share of the cones."""
    monkeypatch.setattr(cones, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(5)
    centres = 3 * rng.standard_normal((40, 16))
    protos = [("hard", v.tolist()) for v in clustered(1500, centres, rng)] + [("easy", v.tolist()) for v in clustered(700, centres, rng)]
    protos += [("easy", protos[0][1])] * 300 + [("one", centres[3].tolist()), ("hard", [0.0] * 16)]
    rows = {i: v.tolist() for i, v in enumerate(clustered(600, centres, rng))}
    rows |= {1000 + i: rows[0] for i in range(200)} | {2000: [0.0] * 16}
    df = spark.createDataFrame(list(rows.items()), "id long, embedding array<double>").repartition(5)
    table = spark.createDataFrame(protos, "signal string, embedding array<double>").repartition(3)
    exact = brute(rows, protos, 3)
    got = {r.id: r.tops for r in top_similarities(df, table, m=3, cones=40).collect()}
    assert got.keys() == rows.keys()
    for i, tops in got.items():
        assert tops.keys() == exact[i].keys() and all(np.allclose(tops[s], exact[i][s], atol=1e-12) for s in tops), i
    _, visited = cones.best_cosines(df.withColumnRenamed("embedding", "vector"), table.withColumnRenamed("embedding", "proto"), 3, 40)
    share = visited.selectExpr("sum(cones) / sum(all_cones)").first()[0]
    print("visited", share)
    assert share < 0.4


@pytest.mark.parametrize("count", [1, 7])
def test_cones_without_clusters(spark, count):
    rng = np.random.default_rng(6)
    protos = [(f"s{i % 3}", v.tolist()) for i, v in enumerate(rng.standard_normal((50, 8)))]
    rows = {i: v.tolist() for i, v in enumerate(rng.standard_normal((40, 8)))}
    df = spark.createDataFrame([*rows.items(), (90, None), (None, rows[0])], "id long, embedding array<double>")
    got = {r.id: r.tops for r in top_similarities(df, spark.createDataFrame(protos, "signal string, embedding array<double>"), cones=count).collect()}
    exact = brute(rows, protos, 2)
    assert got.pop(90) == {} and got.pop(None) == {}
    assert all(np.allclose(got[i][s], exact[i][s]) for i in exact for s in exact[i]) and got.keys() == exact.keys()
