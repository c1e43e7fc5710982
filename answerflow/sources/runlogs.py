"""Run logs and run summaries as files."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from answerflow.functions.text import strip_space

# The columns that run logs may have, in any order, with their type and their name
# from there on.
RUN_LOG_COLUMNS = {
    "ID": ("string", "id"),
    "Unique ID": ("string", "id"),
    "SMILES": ("string", "smiles"),
    "Problem": ("string", "question"),
    "Model Response": ("string", "response"),
    "Extracted Answer": ("string", "extracted"),
    "Ground Truth": ("string", "gold"),
    "Correct": ("string", "correct"),
    "Latency": ("double", "latency"),
    "Category": ("string", "category"),
    "Subject": ("string", "category"),
    "Level": ("string", "level"),
    "Input Tokens": ("bigint", "input_tokens"),
    "Output Tokens": ("bigint", "output_tokens"),
}
ALWAYS = ("id", "question", "response", "extracted", "gold", "correct", "latency", "input_tokens", "output_tokens")


def _headers(spark: SparkSession, paths: Sequence[str]) -> dict[str, list[str]]:
    """The files by their header line. One row per file reaches the driver."""
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), "value",
    )
    first = lines.where("block = 0").groupBy("file").agg(F.min(F.struct("line", "value")).alias("first"))
    found: dict[str, list[str]] = {}
    for row in first.select("file", "first.value").collect():
        found.setdefault(row["value"].lstrip("\ufeff").rstrip("\r"), []).append(row["file"])
    return found


def read_run_logs(
    spark: SparkSession,
    path: str | Sequence[str],
    model_pattern: str = r"([^/]+)/[^/]*$",
    required: Sequence[str] = (),
) -> DataFrame:
    """CSV logs, one or more files per model, with the model taken from the file path.

    Each file's columns are found by the names in its header, so files of several formats can be
    read together; a column that a format lacks is missing. A header with an unknown or repeated
    column, without one of the columns all formats have, or without a `required` one (by its
    name there or in the result) is refused. Quoted fields may span lines, so a CSV file is read by one
    task: write the result with `write_table` once and work on that.
    """
    names = list(dict.fromkeys(name for _, name in RUN_LOG_COLUMNS.values()))
    kinds = {name: kind for kind, name in RUN_LOG_COLUMNS.values()}
    parts = []
    for header, files in _headers(spark, [path] if isinstance(path, str) else path).items():
        columns = next(csv.reader([header]))
        unknown = [c for c in columns if c not in RUN_LOG_COLUMNS]
        here = [RUN_LOG_COLUMNS[c][1] for c in columns if c not in unknown]
        wanted = {RUN_LOG_COLUMNS[c][1] if c in RUN_LOG_COLUMNS else c for c in required}
        missing = sorted({*ALWAYS, *wanted} - set(here))
        if unknown or missing or len(set(here)) < len(here):
            raise ValueError(f"missing columns: {missing}, unknown: {unknown}, or repeated ones, in {header!r} of {files[0]}")
        log = (
            spark.read.schema(", ".join(f"`{c}` {RUN_LOG_COLUMNS[c][0]}" for c in columns))
            .options(header=True, multiLine=True, escape='"', enforceSchema=False)
            .csv([unquote(f) for f in files])
        )
        file = F.url_decode(F.col("_metadata.file_path"))
        own = dict(zip(here, columns))
        parts.append(log.select(
            F.regexp_extract(file, model_pattern, 1).alias("model"),
            *[(F.col(f"`{own[n]}`") if n in own else F.lit(None).cast(kinds[n])).alias(n) for n in names],
        ))
    if not parts:
        raise ValueError(f"no log with a header in {path}")
    return reduce(DataFrame.unionByName, parts)


# Folders into which a task writes at the same time; with more of them it sorts its rows first.
OPEN_FOLDERS = 32
# How hard "gzip" tries: a third of the time of its default, for 4 per cent more bytes on logs of texts.
GZIP_LEVEL = "FOUR"


def write_run_logs(df: DataFrame, path: str, by: str = "model", compression: str = "none") -> None:
    """Run logs as CSV, one folder per model, in the format `read_run_logs` reads.

    Rows go to their folders without being sorted, so nothing spills. `read_run_logs` also reads
    compressed files ("gzip", "snappy"); "gzip" stores the same text in two columns of a row about once,
    if it is no longer than 32 KB.
    """
    keep_space = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "zlib.compress.level": GZIP_LEVEL}
    conf, key = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(key)
    conf.set(key, OPEN_FOLDERS)
    try:
        df.write.partitionBy(by).options(header=True, escape='"', quoteAll=True, compression=compression, **keep_space).csv(path)
    finally:
        conf.set(key, before)


def write_table(df: DataFrame, path: str, by: Sequence[str] = ("split",), mode: str = "errorifexists") -> None:
    """Parquet partitioned by `by`.

    Rows are rebalanced by those columns first: small groups end up in few files and a group
    that holds most rows is written by several tasks.
    """
    df.hint("rebalance", *[F.col(c) for c in by]).write.mode(mode).partitionBy(*by).parquet(path)


# How a record of a wrapped result file starts, and its fields.
RECORD_START = r"^\d+,[^,]*,"
RECORD = r"(?s)^(\d+),([^,]*),(.*),([^,]*),([^,]*),([^,]*)$"


def repair_wrapped_records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Result files whose unquoted questions run over several lines, as typed records.

    A record starts at `<number>,<anything>,`; other lines are stripped and appended with one
    blank. A record that does not have all its fields fails the job. Files are split and read in parallel: lines are numbered within their file block,
    and records are counted across the blocks of a file from one total per block.
    """
    paths = [path] if isinstance(path, str) else list(path)
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
    in_block = W.partitionBy("file", "block").orderBy("line")
    # The first line of a file is its header.
    numbered = lines.withColumn("_at", F.row_number().over(in_block)).where("NOT (block = 0 AND _at = 1)")
    starts = F.col("value").rlike(RECORD_START).cast("bigint")
    numbered = numbered.withColumn("_rec", F.sum(starts).over(in_block.rowsBetween(W.unboundedPreceding, 0)))
    per_block = numbered.groupBy("file", "block").agg(F.max("_rec").alias("_starts"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_block.select("file", "block", F.coalesce(F.sum("_starts").over(earlier), F.lit(0)).alias("_before"))
    placed = numbered.join(offsets, ["file", "block"]).withColumn("_record", F.col("_before") + F.col("_rec"))
    parts = F.sort_array(F.collect_list(F.struct("block", "line", "value")))
    joined = F.array_join(
        F.transform(parts, lambda p, i: F.when(i == 0, p["value"]).otherwise(strip_space(p["value"]))), " "
    )
    records = placed.where("_record > 0").groupBy("file", "_record").agg(joined.alias("_text"))
    broken = F.raise_error(F.concat(F.lit("cannot split a record of "), F.col("file"), F.lit(": "), F.substring("_text", 1, 200)))
    records = records.withColumn("_text", F.when(F.col("_text").rlike(RECORD), F.col("_text")).otherwise(broken))

    def field(i: int):
        return strip_space(F.regexp_extract("_text", RECORD, i))

    question = field(3)
    quoted = question.rlike(r'(?s)^".*"$') & (F.length(question) >= 2)
    unquoted = F.replace(F.substring(question, F.lit(2), F.length(question) - 2), F.lit('""'), F.lit('"'))
    return records.select(
        "file",
        field(1).try_cast("bigint").alias("QID"),
        field(2).alias("model_answer"),
        F.when(quoted, unquoted).otherwise(question).alias("question"),
        field(4).alias("correct_answer"),
        field(5).try_cast("double").alias("time"),
        field(6).alias("category"),
    )


def parse_run_summaries(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Model, accuracy and mean time from text summaries; files lacking one of them are left out."""
    paths = [path] if isinstance(path, str) else list(path)
    text = spark.read.text(paths, wholetext=True)
    # The lines of a summary.
    found = text.select(
        strip_space(F.regexp_extract("value", r"(?d)Model used:\s*(.+)", 1)).alias("model"),
        F.regexp_extract("value", r"Accuracy:\s*([0-9.]+)%", 1).alias("accuracy"),
        F.regexp_extract("value", r"Average time:\s*([0-9.]+)s", 1).alias("avg_time"),
    )
    complete = found.where("model <> '' AND accuracy <> '' AND avg_time <> ''")
    return complete.select(
        "model", F.col("accuracy").cast("double").alias("accuracy"), F.col("avg_time").cast("double").alias("avg_time")
    ).orderBy("avg_time", "model")
