"""The pivot tree: exact on every shape of data, and few pairs compared where there are clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerflow.operators import neighbours
from answerflow.operators.neighbours import build_tree, nearest_neighbours, plan_visits, search_tree, visited_pairs


def frame(spark, data, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v], i % 2) for i, v in enumerate(data)], "id long, embedding array<double>, y int")


def clustered(n, seed, dims=12, clusters=40):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(0).normal(size=(clusters, dims)) * 4
    return centres[rng.integers(0, clusters, n)] + 0.1 * rng.normal(size=(n, dims))


def brute(asked, data, k):
    gaps = np.round(np.sqrt(((asked[:, None, :] - data[None, :, :]) ** 2).sum(2)), 9)
    return [np.lexsort((np.arange(len(data)), g))[:k].tolist() for g in gaps]


@pytest.mark.parametrize("leaf_rows, block_rows", [(64, 1024), (3, 8), (1000, 16)])
def test_equal_to_brute_force(spark, leaf_rows, block_rows):
    rng = np.random.default_rng(1)
    for data in (clustered(400, 2), rng.normal(size=(300, 6)), np.vstack([np.repeat(rng.normal(size=(1, 6)), 150, axis=0), rng.normal(size=(150, 6))])):
        asked = np.vstack([data[:20] + 0.01, rng.normal(size=(20, data.shape[1])) * 8, data[-1:]])
        tree = build_tree(frame(spark, data), "y", leaf_rows=leaf_rows, block_rows=block_rows)
        rows = search_tree(tree, frame(spark, asked), k=7).collect()
        got = {}
        for r in sorted(rows, key=lambda r: (r.id, r.rank)):
            got.setdefault(r.id, []).append(r.neighbour)
            assert r.label == r.neighbour % 2
        assert [got[i] for i in range(len(asked))] == brute(asked, data, 7)


def test_pairs_grow_slower_than_all(spark):
    seen = []
    for n in (1500, 6000):
        data, asked = clustered(n, 3), clustered(n // 5, 4)
        tree = build_tree(frame(spark, data), "y")
        visits, queries = plan_visits(tree, frame(spark, asked), 5)
        assert queries == len(asked)
        seen.append(visited_pairs(tree, visits) / (n * len(asked)))
    # A query looks at its own cluster, a fortieth of the rows, and at little else.
    assert seen[0] < 0.12 and seen[1] < 0.05 and seen[1] < seen[0]


def test_rows_without_vectors(spark):
    data = frame(spark, clustered(50, 1)).unionByName(spark.createDataFrame([(99, None, 1)], "id long, embedding array<double>, y int"))
    assert nearest_neighbours(data, data, "y", k=3).where("id = 99 or neighbour = 99").count() == 0
    assert nearest_neighbours(data.where("id = 99"), data, "y").count() == 0
    with pytest.raises(ValueError, match="no training rows"):
        build_tree(data.where("id = 99"), "y")


def test_no_block_holds_a_crowded_leaf(spark):
    data = np.vstack([np.zeros((500, 4)), np.random.default_rng(0).normal(size=(100, 4))])
    tree = build_tree(frame(spark, data), "y", block_rows=50)
    assert tree.blocks.select(F.max(F.size("t"))).first()[0] < 200


def test_small_pieces_change_nothing(spark, monkeypatch):
    from answerflow.operators import neighbours

    monkeypatch.setattr(neighbours, "ROWS_OUT", 3)
    monkeypatch.setattr(neighbours, "PAIRS", 5)
    data = np.vstack([clustered(150, 2, dims=4, clusters=3), np.zeros((40, 4))])
    rows = nearest_neighbours(frame(spark, data), frame(spark, data), "y", k=3, block_rows=16).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.id, r.rank)):
        got.setdefault(r.id, []).append(r.neighbour)
    assert [got[i] for i in range(len(data))] == brute(data, data, 3)


def test_python_gets_few_large_rows_at_once(spark):
    import pyarrow as pa

    from answerflow.session import durable

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    wide = spark.range(64, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 20).alias("x"))
    assert durable(wide.mapInArrow(sizes, "n long")).agg(F.max("n")).first()[0] <= 16
    assert spark.conf.get(key) == before


def test_queries_go_in_rounds(spark, monkeypatch):
    """Vectors without clusters visit every block; what is sent to the blocks at once is bounded."""
    rng = np.random.default_rng(7)
    data, asked = rng.normal(size=(200, 6)), rng.normal(size=(45, 6))
    sent, visits = [], neighbours.visits_after
    monkeypatch.setattr(neighbours, "QUERIES_OF_A_ROUND", 10)
    monkeypatch.setattr(neighbours, "visits_after", lambda tree, started, *x: (sent.append(started.count()), visits(tree, started, *x))[1])
    twice = frame(spark, asked).unionByName(frame(spark, asked[:1]))
    rows = search_tree(build_tree(frame(spark, data), "y", block_rows=32), twice, k=5).collect()
    assert len(sent) == 5 and sum(sent) == 46 and max(sent) < 30
    want = brute(asked, data, 5)
    for i in range(1, len(asked)):
        assert [r.neighbour for r in sorted(rows, key=lambda r: r["rank"]) if r.id == i] == want[i]
