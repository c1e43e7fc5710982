"""What a task or a key does at once stays small, whatever the tables hold."""

import datetime as dt
import random
from pathlib import Path
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from answerflow.sources.runlogs import read_run_logs, write_run_logs
from answerflow.streaming.cascade import CascadeProcessor
from checks import QUERIES, sources
from checks.views import table


class Kept:
    """A state variable in memory."""

    def __init__(self):
        self.value = None

    def get(self):
        return self.value if self.value is not None else []

    def exists(self):
        return self.value is not None

    def appendList(self, more):
        self.value = [*(self.value or []), *more]

    def put(self, value):
        self.value = value

    update = put

    def clear(self):
        self.value = None


def test_cascades_register_few_timers():
    timers = []
    machine = CascadeProcessor(3600)
    machine.init(SimpleNamespace(getListState=lambda *_: Kept(), getValueState=lambda *_: Kept(), registerTimer=timers.append))
    start = dt.datetime(2024, 1, 1)
    rows = pd.DataFrame({
        "ts": [start + dt.timedelta(minutes=i) for i in reversed(range(100))], "response_id": range(100), "kind": ["satisfied", "start"] * 50,
    })
    machine.handleInputRows((7,), iter([rows]), None)
    assert timers == [CascadeProcessor._millis(start)]
    # What is not yet complete waits for a timer of its own.
    limit = CascadeProcessor._millis(start + dt.timedelta(minutes=49))
    first = pd.concat(machine.handleExpiredTimer((7,), SimpleNamespace(getCurrentWatermarkInMs=lambda: limit), None))
    assert limit + 60_000 in timers and len(timers) <= 3
    late = SimpleNamespace(getCurrentWatermarkInMs=lambda: limit + 10**8)
    second = pd.concat(machine.handleExpiredTimer((7,), late, None))
    assert sorted([*first["response_id"], *second["response_id"]]) == [i for i in range(100) if i % 2]


def documents(spark, folder, n):
    rows = spark.range(n).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("a\n b "), F.col("id")).alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"),
        F.lit(7).cast("long").alias("n_chars"),
    )
    rows.coalesce(1).write.parquet(f"{folder}/documents.parquet")


def test_wrapped_records_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    documents(spark, tmp_path, 400)
    whole = sorted(QUERIES["wrapped_records"](spark, str(tmp_path)).collect())
    monkeypatch.setattr(sources, "RECORDS_OF_A_PIECE", 40)
    paths = []
    monkeypatch.setattr(sources, "scratch_path", lambda _, label: paths.append(str(tmp_path / label)) or paths[-1])
    assert sorted(QUERIES["wrapped_records"](spark, str(tmp_path)).collect()) == whole and len(whole) == 400
    files = [f.read_text().splitlines() for f in Path(paths[0]).rglob("*.txt")]
    assert len(files) == 40 and all(lines[0].startswith("QID,") for lines in files) and max(map(len, files)) < 80


def test_votes_make_their_tables_once(spark, sf):
    for name in ("voted_scores", "voted_scores_of_two_sets"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "lineitem" not in plan


@pytest.mark.parametrize("compression", ["none", "gzip", "snappy"])
def test_run_logs_are_read_back(spark, tmp_path, compression):
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    values = sources.log_columns("text")
    documents(spark, tmp_path, 30)
    log = table(spark, str(tmp_path), "documents").select((F.col("doc_id") % 3).alias("model"), *[values[c].alias(c) for c in sources.LOG_FORMATS["simple"]])
    write_run_logs(log, str(tmp_path / "logs"), compression=compression)
    rows = read_run_logs(spark, str(tmp_path / "logs/*"), model_pattern=r"model=([^/]+)/[^/]*$").collect()
    assert sorted((r.id, r.model, r.question) for r in rows) == sorted((str(i), str(i % 3), f"a\n b {i}") for i in range(30))
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before


def test_logs_of_several_formats_stay_small(spark, tmp_path):
    """A question is also in its response, in each of four formats: eight copies of every text take less
    than four times its table."""
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 9))) for _ in range(4_000)]
    rows = [(i, " ".join(draw.choices(words, k=draw.randint(100, 700))), "en", "web") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)
    docs.withColumn("n_chars", F.length("text").cast("bigint")).write.parquet(str(tmp_path / "documents.parquet"))
    path = Path(sources.written_logs(spark, str(tmp_path), ["math", "medicine", "molecules", "simple"]).removeprefix("file:"))
    table = sum(f.stat().st_size for f in (tmp_path / "documents.parquet").glob("*.parquet"))
    assert sum(f.stat().st_size for f in path.rglob("part-*")) < 4 * table
    found = read_run_logs(spark, f"{path}/*/*", model_pattern=r"model=([^/]+)/[^/]*$")
    assert sorted((r.id, r.question, r.response) for r in found.where("model LIKE 'simple-%'").collect()) == sorted((str(i), t, f"so\n{t}") for i, t, _, _ in rows)
