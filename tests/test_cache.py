"""The semantic prompt cache against one that reads its prompts one after the other."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerflow.streaming.cache import cell_of, semantic_cache, unit_vectors
from answerflow.streaming.jobs import append_available, rocksdb_state

START = dt.datetime(2024, 1, 1)
SCHEMA = "id long, ts timestamp, scope string, embedding array<float>"


def one_after_the_other(batches, threshold, ttl, most, planes, seed=42):
    """id -> id of the entry met, by plain lists."""
    caches, met = {}, {}
    for batch in batches:
        for id, ts, scope, vector in sorted(batch, key=lambda r: (r[1], r[0])):
            met[id] = None
            if vector is None or not all(math.isfinite(x) for x in vector) or not any(vector):
                continue
            unit = np.float32(vector).astype(float)
            unit /= math.sqrt(sum(x * x for x in unit))
            cache = caches.setdefault((scope, cell_of(unit, planes, seed) if planes else 0), [])
            cache[:] = [e for e in cache if (ts - e[1]).total_seconds() <= ttl]
            best = max(((float(unit @ e[2]), -i) for i, e in enumerate(cache)), default=(-2, 0))
            if best[0] >= threshold:
                met[id] = str(cache[-best[1]][0])
            else:
                cache.append((id, ts, unit))
                del cache[:-most]
    return met


def run(spark, folder, batches, path=None, **options):
    for i, rows in enumerate(batches):
        target = folder / f"b{i:03d}"
        if not target.exists():
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(target))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
    events = source.option("pathGlobFilter", "*.parquet").parquet(str(folder))
    with rocksdb_state(spark):
        return append_available(semantic_cache(events, **options), "cache", path)


def prompts(seed, batches=4, rows=120):
    """Prompts around 12 meanings, two thirds of them of one scope, a third one and the same prompt."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, 8))
    out, id = [], 0
    for b in range(batches):
        batch = []
        for _ in range(rows):
            id += 1
            near = centres[0] if id % 3 == 0 else centres[rng.integers(12)] + 0.25 * rng.standard_normal(8)
            ts = START + dt.timedelta(minutes=30 * b, seconds=int(rng.integers(1800)))
            batch.append((id, ts, "busy" if id % 3 else None, [float(x) for x in near]))
        out.append(batch)
    return out


@pytest.mark.parametrize("planes, most, ttl", [(0, 5, 900), (2, 3, 2400)])
def test_equal_to_a_sequential_cache(spark, tmp_path, planes, most, ttl):
    batches = prompts(planes)
    got = run(spark, tmp_path, batches, scope="scope", threshold=0.9, ttl_seconds=ttl, max_entries=most, planes=planes)
    want = one_after_the_other(batches, 0.9, ttl, most, planes)
    assert {r.id: r.cached_id for r in got.collect()} == want
    assert 0.2 < sum(v is not None for v in want.values()) / len(want) < 0.95


def test_oldest_entry_goes_first_and_hits_do_not_renew(spark, tmp_path):
    axes = np.eye(3).tolist()
    at = lambda s: START + dt.timedelta(seconds=s)
    batches = [
        [(1, at(0), "s", axes[0]), (2, at(1), "s", axes[1]), (3, at(2), "s", axes[0])],
        [(4, at(3), "s", axes[2]), (5, at(4), "s", axes[0])],
        [(6, at(64), "s", axes[0]), (7, at(65), "s", axes[0]), (8, at(65), "other", axes[0])],
    ]
    got = run(spark, tmp_path, batches, scope="scope", threshold=0.9, ttl_seconds=60, max_entries=2, planes=0)
    # 3 meets 1, which 4 drives out; 5 is kept anew and met at its limit by 6, no longer by 7.
    assert {r.id: r.cached_id for r in got.collect()} == {
        1: None, 2: None, 3: "1", 4: None, 5: None, 6: "5", 7: None, 8: None,
    }


def test_prompts_without_a_usable_vector_pass(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    vectors = [None, None, [], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [1.0, 0.0], [2.0, 0.0], [1.0, 0.0]]
    batch = [(i, START, None, v) for i, v in enumerate(vectors)]
    got = {r.id: (r.cached_id, r.similarity) for r in run(spark, tmp_path, [batch], scope="scope", planes=3).collect()}
    assert all(got[i] == (None, None) for i in range(7))
    assert got[7] == ("6", 1.0) and got[8] == ("6", 1.0)


def test_no_prompts(spark, tmp_path):
    got = run(spark, tmp_path, [[]], planes=0)
    assert got.columns == ["id", "ts", "scope", "embedding", "cached_id", "similarity"] and got.count() == 0


def test_entries_outlive_a_stop(spark, tmp_path):
    """A second run goes on with the entries of the first, and repeats no row."""
    batches = prompts(7, batches=3, rows=60)
    options = dict(scope="scope", threshold=0.9, ttl_seconds=2400, max_entries=4, planes=1)
    source, path = tmp_path / "in", str(tmp_path / "out")
    run(spark, source, batches[:1], path, **options)
    got = run(spark, source, batches, path, **options).collect()
    assert len(got) == 180
    assert {r.id: r.cached_id for r in got} == one_after_the_other(batches, 0.9, 2400, 4, 1)


def test_lengths_of_any_size():
    import pandas as pd

    got = unit_vectors(pd.Series([[1e200, 1e200], [1e-200, 0.0]]))
    assert got[0] == pytest.approx([math.sqrt(0.5)] * 2) and got[1] == pytest.approx([1, 0])


def test_settings_are_checked(spark):
    events = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        semantic_cache(events, max_entries=0)
    with pytest.raises(ValueError):
        semantic_cache(events, planes=63)
