"""Session settings and the shared folder for checkpoints and written intermediates."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "answerflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on. `conf` overrides, with `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    A machine-local folder is only ever chosen in local mode, where it is shared by definition.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="answerflow-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, never reused path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


# While a step is written: its shuffle files go when it is done, and Python gets its rows in batches of a
# few megabytes, however large a row is.
WHILE_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}
_turn = threading.Lock()
_inside: dict[int, tuple[int, dict[str, str]]] = {}
_made = threading.local()


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """`WHILE_WRITING` holds. The session's own settings are back when the last thread leaves."""
    with _turn:
        inside, before = _inside.get(id(spark), (0, {}))
        if not inside:
            before = {key: spark.conf.get(key) for key in WHILE_WRITING}
            for key, value in WHILE_WRITING.items():
                spark.conf.set(key, value)
        _inside[id(spark)] = inside + 1, before
    try:
        yield
    finally:
        with _turn:
            inside, before = _inside.pop(id(spark))
            if inside > 1:
                _inside[id(spark)] = inside - 1, before
            else:
                for key, value in before.items():
                    spark.conf.set(key, value)


def durable(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet to the shared folder and continue from there.

    Cuts the lineage, survives the loss of executors, and later passes read only the columns
    they need. The shuffle files that led to them go at once.
    """
    path = scratch_path(df.sparkSession, "rows")
    if (made := getattr(_made, "paths", None)) is not None:
        made.append(path)
    with writing(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What this thread makes `durable` inside is needed there only: it goes at the end."""
    outer = getattr(_made, "paths", None)
    _made.paths = []
    try:
        yield
    finally:
        paths, _made.paths = _made.paths, outer
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
        # Shuffle files and broadcasts of MLlib's own go when the driver collects its garbage.
        gc.collect()
        spark._jvm.System.gc()
