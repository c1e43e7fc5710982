"""Streams cut into many batches against the same rows as one table."""

import datetime as dt
import shutil

import pytest
from pyspark.sql import functions as F

from answerflow.streaming.cascade import cascade_resolution, resolve_cascades
from answerflow.streaming.jobs import append_available, latest_available, read_stream, rocksdb_state, stream_table
from answerflow.streaming.prompts import cascade_rows, feedback_rows, feedback_windows, route_prompts
from answerflow.streaming.repeats import dedupe_prompts
from checks.streams import EVENTS, event_columns
from checks.views import table


@pytest.fixture(scope="module")
def daily(spark, sf, tmp_path_factory):
    """The events in one file per ten days, in order."""
    folder = tmp_path_factory.mktemp("events")
    events = table(spark, sf, "events")
    for i, day in enumerate((1, 11, 21)):
        part = events.where((F.dayofmonth("ts") >= day) & (F.dayofmonth("ts") < day + 10))
        part.coalesce(1).write.parquet(str(folder / f"part{i}"))
    return folder


def stream(spark, folder):
    paths = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
    return event_columns(paths.option("pathGlobFilter", "*.parquet").parquet(str(folder)))


def test_windows_over_batches(spark, sf, daily):
    got = latest_available(feedback_windows(stream(spark, daily).withWatermark("ts", "1 hour")), ["start", "end", "model"], "w")
    want = feedback_windows(event_columns(table(spark, sf, "events")))
    key = lambda r: (r.start, r.model)
    a, b = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
    assert [(r.start, r.model, r.n) for r in a] == [(r.start, r.model, r.n) for r in b]
    assert [r.cents for r in a] == pytest.approx([r.cents for r in b])


def test_cascades_over_batches(spark, sf, daily):
    with rocksdb_state(spark):
        got = append_available(cascade_resolution(stream(spark, daily)), "c")
    batch = resolve_cascades(event_columns(table(spark, sf, "events")))
    newest = table(spark, sf, "events").agg(F.max("ts")).first()[0]
    rows = {tuple(r) for r in got.collect()}
    settled = {tuple(r) for r in batch.where(F.col("resolved_at") <= F.lit(newest - dt.timedelta(hours=2))).collect()}
    assert settled <= rows
    assert rows <= {tuple(r) for r in batch.collect()}


def test_routes_equal_batch(spark, sf, daily):
    scored = lambda df: df.withColumn("p", F.col("response_id") * 7919 % 1000 / 999.0)
    got = append_available(route_prompts(scored(stream(spark, daily))).select("response_id", "route"), "r")
    want = route_prompts(scored(event_columns(table(spark, sf, "events")))).select("response_id", "route")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_threshold_routing_is_inclusive(spark):
    df = spark.createDataFrame([(0.5,), (0.49,)], "p double")
    assert [r.route for r in route_prompts(df, use_utility=False).orderBy("p").collect()] == ["slm", "llm"]


def test_feedback_rows(spark):
    schema = "response_id string, question string, answer string, latency double, input_tokens int, output_tokens int, model string, kind string"
    rows = [(" r1 ", "a\nb", "c\r\n", 1.0, 2, 3, "LLM", "up"), ("r2", "q", "a", 1.0, 2, 3, "SLM", "down"), ("r3", "q", "a", 1.0, 2, 3, "other", None)]
    got = [tuple(r) for r in feedback_rows(spark.createDataFrame(rows, schema)).collect()]
    assert got[0] == ("r1", "a b", "c", 1.0, 2, 3, "large", True)
    assert [(r[6], r[7]) for r in got[1:]] == [("small", False), ("small", False)]


def test_cascade_rows(spark):
    cols = "kind string, question string, " + ", ".join(
        f"{s}_response_id string, {s}_answer string, {s}_latency double, {s}_input_tokens int, {s}_output_tokens int" for s in ("slm", "llm")
    )
    rows = [
        ("satisfied", "q", "s1", "a", 1.0, 1, 1, None, None, None, None, None),
        ("escalate", "q", " ", "a", 1.0, 1, 1, "l2", "b", 2.0, 2, 2),
        ("start", "q", "s3", "a", 1.0, 1, 1, None, None, None, None, None),
    ]
    got = cascade_rows(spark.createDataFrame(rows, cols)).collect()
    assert sorted((r.model, r.is_good) for r in got) == [("large", True), ("small", False), ("small", True)]
    fresh = [r for r in got if r.model == "small" and not r.is_good]
    assert len(fresh[0].response_id) == 36
    # The same events again, in other partitions: the same ids; another event: another id.
    again = cascade_rows(spark.createDataFrame(rows, cols).repartition(3)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    other = cascade_rows(spark.createDataFrame([rows[1][:5] + (9,) + rows[1][6:]], cols)).where("model = 'small'").first()
    assert len(other.response_id) == 36 and other.response_id != fresh[0].response_id


def test_repeats_within_the_time_limit_are_dropped(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    batches = [
        [(1, day, "x"), (2, day + dt.timedelta(minutes=5), "x"), (3, day, "y")],
        [(4, day + dt.timedelta(minutes=30), "x"), (5, day + dt.timedelta(hours=4), "z")],
        [(6, day + dt.timedelta(hours=5), "x")],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "id long, ts timestamp, prompt string").coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
    source = spark.readStream.schema("id long, ts timestamp, prompt string").option("maxFilesPerTrigger", 1)
    events = source.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(str(tmp_path))
    with rocksdb_state(spark):
        kept = append_available(dedupe_prompts(events, ttl_seconds=3600), "d").collect()
    assert sorted((r.id, r.prompt) for r in kept) == [(1, "x"), (3, "y"), (5, "z"), (6, "x")]


def test_repeats_in_columns_of_any_name(spark, tmp_path):
    schema = "`class` long, ts timestamp, `the prompt` string, _x long"
    spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "x", 5), (1, dt.datetime(2024, 1, 1), "x", 5)], schema).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    with rocksdb_state(spark):
        kept = append_available(dedupe_prompts(events, key="the prompt"), "named")
    assert [tuple(r) for r in kept.select("class", "the prompt", "_x").collect()] == [(1, "x", 5)]


def test_a_table_may_be_a_file_or_a_folder(spark, sf, tmp_path):
    folder = str(tmp_path / "events.parquet")
    table(spark, sf, "events").repartition(3).write.parquet(folder)
    for path in (f"{sf}/events.parquet", folder):
        assert append_available(stream_table(spark, path, EVENTS).select("event_id"), "t").count() == 1000


def test_only_named_files_are_read(spark, sf):
    assert append_available(read_stream(spark, sf, "events.parquet", EVENTS).select("event_id"), "e").count() == 1000


def test_a_second_run_goes_on_where_the_first_ended(spark, daily, tmp_path):
    """Files that come between two runs are read once, and windows go on growing."""
    source, logs, windows = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "windows")
    source.mkdir()
    for i, file in enumerate(sorted(daily.rglob("*.parquet"))):
        shutil.copy(file, source / f"{i}.parquet")
        events = stream(spark, source)
        log = append_available(events.select("response_id"), "log", logs)
        # A watermark this late drops nothing, whatever the order of the files.
        late = feedback_windows(events.withWatermark("ts", "10000 days"))
        latest = latest_available(late, ["start", "end", "model"], "windows", windows)
    every = event_columns(spark.read.parquet(str(source)))
    assert sorted(r[0] for r in log.collect()) == sorted(r[0] for r in every.select("response_id").collect())
    want = {(r.start, r.model): r.n for r in feedback_windows(every).collect()}
    assert {(r.start, r.model): r.n for r in latest.collect()} == want
