"""Model selection by neighbours in a stream against the same search over a table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerflow.operators.neighbours import build_tree, knn_classify
from answerflow.streaming.selection import index_versions, publish_index, read_index, select_models

SCHEMA = "id long, embedding array<double>, route string"


def rows(seed, n, first=0):
    vectors = np.random.default_rng(seed).standard_normal((n, 6))
    return [(first + i, [float(x) for x in v], None) for i, v in enumerate(vectors)]


def index_of(spark, seed, flip=False):
    data = [(i, v, int((v[0] > 0) != flip)) for i, v, _ in rows(seed, 200)]
    return spark.createDataFrame(data, "id long, embedding array<double>, hard int")


def add(spark, folder, name, prompts):
    spark.createDataFrame(prompts, SCHEMA).coalesce(1).write.parquet(str(folder / name))


def select(spark, folder, index, path, **options):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
    prompts = source.option("pathGlobFilter", "*.parquet").parquet(str(folder))
    return select_models(prompts, index, path=path, use_utility=False, **options)


def test_stream_equals_batch(spark, tmp_path):
    train, prompts, index = index_of(spark, 1), rows(2, 60), str(tmp_path / "index")
    tree = build_tree(train, "hard", leaf_rows=8)
    assert publish_index(tree, index) == 1
    for i in range(3):
        add(spark, tmp_path / "in", f"b{i}", prompts[20 * i : 20 * i + 20])
    got = select(spark, tmp_path / "in", index, str(tmp_path / "out"), k=7)
    assert got.columns == ["id", "embedding", "p", "route", "index_version"]
    want = knn_classify(spark.createDataFrame(prompts, SCHEMA), train, "hard", k=7)
    assert {r.id: r.p for r in got.collect()} == pytest.approx({r.id: r.p for r in want.collect()})
    assert all((r.route == "llm") == (r.p >= 0.5) and r.index_version == 1 for r in got.collect())


def test_an_index_is_read_as_it_was_written(spark, tmp_path):
    tree = build_tree(index_of(spark, 1), "hard", leaf_rows=8, block_rows=16)
    publish_index(tree, str(tmp_path / "index"))
    again = read_index(spark, str(tmp_path / "index"), 1)
    for name in ("names", "pivots", "sizes", "reach"):
        assert np.array_equal(getattr(again, name), getattr(tree, name))
    assert (again.key_type, again.block_rows) == (tree.key_type, tree.block_rows)
    assert again.blocks.exceptAll(tree.blocks).isEmpty() and again.cells.exceptAll(tree.cells).isEmpty()


def test_a_repeated_batch_sees_its_index_and_the_next_one_the_newest(spark, tmp_path):
    index, path = str(tmp_path / "index"), str(tmp_path / "out")
    publish_index(build_tree(index_of(spark, 1), "hard"), index)
    add(spark, tmp_path / "in", "b0", rows(2, 20))
    first = {r.id: r.p for r in select(spark, tmp_path / "in", index, path).collect()}
    publish_index(build_tree(index_of(spark, 1, flip=True), "hard"), index)
    assert index_versions(spark, index) == [1, 2]
    # As if the first run had ended before its batch was marked as done.
    for name in ("0", ".0.crc"):
        (tmp_path / "out-progress" / "commits" / name).unlink(missing_ok=True)
    add(spark, tmp_path / "in", "b1", rows(3, 20, first=100))
    got = select(spark, tmp_path / "in", index, path).collect()
    assert {r.id: r.p for r in got if r.index_version == 1} == first
    assert sorted(r.id for r in got if r.index_version == 2) == list(range(100, 120))
    want = knn_classify(spark.createDataFrame(rows(3, 20, first=100), SCHEMA), index_of(spark, 1, flip=True), "hard")
    assert {r.id: r.p for r in got if r.index_version == 2} == pytest.approx({r.id: r.p for r in want.collect()})


def test_repeated_prompts_and_prompts_without_a_vector(spark, tmp_path):
    index, some = str(tmp_path / "index"), rows(2, 1)[0]
    publish_index(build_tree(index_of(spark, 1), "hard"), index)
    odd = [(9, None, "x"), (9, [], "x"), (None, [float("nan")] * 6, "x"), (8, [float("inf")] * 6, "x")]
    add(spark, tmp_path / "in", "b0", [some] * 5 + [(7, some[1], None)] + odd)
    got = select(spark, tmp_path / "in", index, str(tmp_path / "out"))
    assert got.count() == 10
    known = got.where("p is not null").collect()
    assert len(known) == 6 and len({r.p for r in known}) == 1
    assert [r.route for r in got.where("p is null").collect()] == ["llm"] * 4


def test_no_index_and_no_prompts(spark, tmp_path):
    with pytest.raises(ValueError):
        add(spark, tmp_path / "in", "b0", [])
        select(spark, tmp_path / "in", str(tmp_path / "none"), None)
    index = str(tmp_path / "index")
    publish_index(build_tree(index_of(spark, 1), "hard"), index)
    got = select(spark, tmp_path / "in", index, str(tmp_path / "out"))
    assert got.count() == 0 and "route" in got.columns
