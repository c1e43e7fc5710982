"""Running a stream to the end of what is available, into a table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from answerflow.session import scratch_path


def read_stream(spark: SparkSession, folder: str, glob: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """New parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def append_available(stream: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Append everything available to a parquet table and read it back.

    With a `path` the table is there and its progress is kept beside it, so the next call with
    the same path goes on where this one ended, and one that broke off neither loses nor
    repeats rows: the file sink commits each batch once. Without, the table is a new one in the
    shared folder.
    """
    spark = stream.sparkSession
    table = path or scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", f"{table}-progress")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(table)


def latest_available(stream: DataFrame, keys: Sequence[str], label: str, path: str | None = None) -> DataFrame:
    """Keep the newest row per key of an aggregation with a watermark, in a parquet table.

    Each batch writes the groups that it changed, under its number, so a batch that is repeated
    after a failure replaces its own rows; the state behind the watermark is dropped. Reading
    takes the row of the latest batch per key. `path` as in `append_available`.
    """
    spark = stream.sparkSession
    table = path or scratch_path(spark, label)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_batch", F.lit(epoch)).write.mode("overwrite").parquet(f"{table}/{epoch:010d}")

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{table}-progress")
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("_batch", IntegerType())])
    try:
        rows = spark.read.schema(schema).parquet(f"{table}/[0-9]*")
    except AnalysisException:
        return spark.createDataFrame([], stream.schema)
    values = [c for c in stream.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_newest"))
    return newest.select(*keys, "_newest.*").select(*stream.columns)


def stream_table(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """A parquet table as a stream, whether it is one file or a folder of files.

    Spark takes a plain path for a folder and refuses a file; as a pattern it takes both.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, as custom stateful operators need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
