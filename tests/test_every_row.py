"""Model queries return every held-out row, not only how many there are."""

import pytest

from answerflow.operators.prep import random_split
from checks import QUERIES

NAMES = (
    "rf_classifier",
    "linear_regressor",
    "ridge_regressor",
    "huber_regressor",
    "rf_regressor",
    "gb_regressor",
    "dense_network_classifier",
)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, [((i * 37 + j * 101) % 199 - 99) / 800 for j in range(64)], i % 10) for i in range(300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", NAMES)
def test_every_held_out_row_is_returned(spark, folder, name):
    held = random_split(spark.read.parquet(f"{folder}/embeddings.parquet").withColumnRenamed("vec_id", "id"), "id").where("split = 'test'")
    rows = QUERIES[name](spark, folder).collect()
    assert sorted(r["id"] for r in rows) == sorted(r["id"] for r in held.select("id").collect())
    assert all(r["in_range"] and r["n_held"] == r["n_in_range"] == len(rows) and r["n_train"] == 300 - len(rows) for r in rows)
