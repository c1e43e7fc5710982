from __future__ import annotations

from pyspark.sql import functions as F

from answerflow.functions.numbers import to_flag, to_number
from answerflow.operators.merge import normalize_and_prefix
from answerflow.session import scratch_path
from answerflow.sources.runlogs import (
    parse_run_summaries,
    read_run_logs,
    repair_wrapped_records,
    write_run_logs,
    write_table,
)
from checks.registry import query
from checks.views import run_sql, table, view


# The headers of the five formats.
LOG_FORMATS = {
    "choice": ["ID", "Problem", "Model Response", "Extracted Answer", "Ground Truth", "Correct", "Latency", "Category", "Input Tokens", "Output Tokens"],
    "math": ["Unique ID", "Problem", "Model Response", "Extracted Answer", "Ground Truth", "Correct", "Latency", "Subject", "Level", "Input Tokens", "Output Tokens"],
    "medicine": ["ID", "Problem", "Model Response", "Extracted Answer", "Ground Truth", "Correct", "Latency", "Subject", "Input Tokens", "Output Tokens"],
    "molecules": ["ID", "SMILES", "Problem", "Model Response", "Extracted Answer", "Ground Truth", "Correct", "Latency", "Input Tokens", "Output Tokens"],
    "simple": ["ID", "Problem", "Model Response", "Extracted Answer", "Ground Truth", "Correct", "Latency", "Input Tokens", "Output Tokens"],
}


def log_columns(text: str) -> dict:
    return {
        "ID": F.col("doc_id").cast("string"), "Unique ID": F.concat(F.lit("test/"), F.col("doc_id"), F.lit(".json")),
        "SMILES": F.concat(F.lit("C="), F.col("doc_id")), "Problem": F.col(text), "Model Response": F.concat(F.lit("so\n"), F.col(text)),
        "Extracted Answer": F.substring(F.lit("ABCD"), (F.col("doc_id") % 4 + 1).cast("int"), F.lit(1)),
        "Ground Truth": F.substring(F.lit("ABCD"), (F.col("doc_id") % 3 + 1).cast("int"), F.lit(1)),
        "Correct": F.when(F.col("doc_id") % 12 < 3, "True").otherwise("False"), "Latency": F.col("n_chars") / 1e3,
        "Category": F.col("lang"), "Subject": F.col("lang"), "Level": F.concat(F.lit("Level "), F.col("doc_id") % 5),
        "Input Tokens": F.col("n_chars"), "Output Tokens": F.col("n_chars") * 2,
    }


def written_logs(spark, sf_dir, formats) -> str:
    """Logs of some formats, each in the order of its header, below one folder."""
    path = scratch_path(spark, "run-logs")
    docs = table(spark, sf_dir, "documents")
    for name in formats:
        values = log_columns("text")
        log = docs.select(F.concat(F.lit(f"{name}-"), F.col("doc_id") % 3).alias("model"), *[values[c].alias(c) for c in LOG_FORMATS[name]])
        write_run_logs(log, f"{path}/{name}", compression="gzip")
    return path


LOG_SQL = """
SELECT concat('{name}-', CAST(doc_id % 3 AS STRING)) AS model,
       {id} AS id, {smiles} AS smiles, text AS question, concat('so', chr(10), text) AS response,
       substr('ABCD', CAST(doc_id % 4 AS INT) + 1, 1) AS extracted, substr('ABCD', CAST(doc_id % 3 AS INT) + 1, 1) AS gold,
       CASE WHEN doc_id % 12 < 3 THEN 'True' ELSE 'False' END AS correct, n_chars / 1e3 AS latency,
       {category} AS category, {level} AS level, n_chars AS input_tokens, n_chars * 2 AS output_tokens
FROM documents
"""


def log_sql(name: str) -> str:
    return LOG_SQL.format(
        name=name, id="concat('test/', CAST(doc_id AS STRING), '.json')" if name == "math" else "CAST(doc_id AS STRING)",
        smiles="concat('C=', CAST(doc_id AS STRING))" if name == "molecules" else "CAST(NULL AS STRING)",
        category="lang" if name in ("choice", "math", "medicine") else "CAST(NULL AS STRING)",
        level="concat('Level ', CAST(doc_id % 5 AS STRING))" if name == "math" else "CAST(NULL AS STRING)",
    )


@query(log_sql("choice"), rounded=["latency"])
def run_logs_from_csv(spark, sf_dir):
    path = written_logs(spark, sf_dir, ["choice"])
    return read_run_logs(spark, path + "/*/*", model_pattern=r"model=([^/]+)/[^/]*$", required=["category"])


@query("\nUNION ALL\n".join(log_sql(name) for name in LOG_FORMATS if name != "choice"), rounded=["latency"])
def run_logs_of_other_formats(spark, sf_dir):
    path = written_logs(spark, sf_dir, [name for name in LOG_FORMATS if name != "choice"])
    return read_run_logs(spark, path + "/*/*", model_pattern=r"model=([^/]+)/[^/]*$")


RECORDS_OF_A_PIECE = 20_000


@query("""
WITH cut AS (
  SELECT doc_id, lang, n_chars, string_split_regex(text, '\\r\\n|\\r|\\n') AS parts FROM documents
)
SELECT doc_id AS QID, substr('ABCD', CAST(doc_id % 4 AS INT) + 1, 1) AS model_answer,
       array_to_string(list_transform(parts, lambda p, i:
           CASE WHEN i > 1 AND i < len(parts) THEN trim(p) WHEN i > 1 THEN ltrim(p) ELSE p END), ' ') AS question,
       substr('ABCD', CAST((doc_id * 3) % 4 AS INT) + 1, 1) AS correct_answer,
       CASE WHEN doc_id % 10 <> 0 THEN n_chars / 1e3 END AS "time", lang AS category
FROM cut
""", rounded=["time"])
def wrapped_records(spark, sf_dir):
    path = scratch_path(spark, "wrapped")
    docs = table(spark, sf_dir, "documents")
    letter = F.substring(F.lit("ABCD"), (F.col("doc_id") % 4 + 1).cast("int"), F.lit(1))
    gold = F.substring(F.lit("ABCD"), (F.col("doc_id") * 3 % 4 + 1).cast("int"), F.lit(1))
    seconds = F.when(F.col("doc_id") % 10 == 0, F.lit("slow")).otherwise((F.col("n_chars") / 1e3).cast("string"))
    quoted = F.replace(F.col("text"), F.lit('"'), F.lit('""'))
    # Each part has as many files as keep a file, which one task writes, small.
    pieces = max(1, -(-docs.count() // RECORDS_OF_A_PIECE))
    body = docs.select(
        (F.col("doc_id") % 4).alias("part"), F.pmod(F.xxhash64("doc_id"), F.lit(pieces)).alias("piece"), F.col("doc_id").alias("at"),
        F.concat(F.col("doc_id"), F.lit(","), letter, F.lit(',"'), quoted, F.lit('",'), gold, F.lit(","), seconds,
                 F.lit(","), F.col("lang")).alias("value"),
    )
    heads = body.select("part", "piece").distinct().select(
        "part", "piece", F.lit(-1).cast("bigint").alias("at"), F.lit("QID,model_answer,question,correct_answer,time,category").alias("value")
    )
    body.unionByName(heads).repartition("part", "piece").sortWithinPartitions("part", "piece", "at").select("part", "piece", "value") \
        .write.partitionBy("part", "piece").text(path)
    return repair_wrapped_records(spark, path + "/*/*").drop("file")


@query("""
SELECT model, round(avg(correct) * 1e2, 2) AS accuracy, round(avg(latency), 2) AS avg_time
FROM fx_outcomes WHERE model <> 'm7' GROUP BY model
""", rounded=["accuracy", "avg_time"])
def run_summaries(spark, sf_dir):
    path = scratch_path(spark, "summaries")
    per_model = view(spark, sf_dir, "fx_outcomes").groupBy("model").agg(
        F.avg("correct").alias("a"), F.avg("latency").alias("t")
    )
    accuracy = F.when(F.col("model") != "m7", F.format_string("Accuracy: %.2f%%\n", F.col("a") * 100)).otherwise(F.lit(""))
    text = F.concat(
        F.lit("Model used: "), F.col("model"), F.lit(" \n"), accuracy, F.format_string("Average time: %.2fs", "t")
    )
    per_model.select(F.col("model").alias("of"), text.alias("value")).write.partitionBy("of").text(path)
    return parse_run_summaries(spark, path + "/*")


@query("""
SELECT o_orderkey AS id, o_orderpriority AS problem, o_totalprice AS slm_Latency, o_orderstatus AS "slm_Correct"
FROM orders
""")
def prefixed_columns(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ID"), F.col("o_orderpriority").alias("Problem"),
        F.col("o_totalprice").alias("Latency"), F.col("o_orderstatus").alias("Correct"),
    )
    return normalize_and_prefix(orders, "slm_")


RAW_NUMBER = """
CASE CAST(doc_id % 7 AS INT) WHEN 0 THEN 'n/a' WHEN 6 THEN concat(CAST(n_chars AS STRING), 'd') WHEN 1 THEN 'NaN' WHEN 2 THEN NULL
     WHEN 3 THEN concat(chr(9), CAST(n_chars AS STRING), chr(13)) WHEN 4 THEN concat('-', CAST(n_chars AS STRING), '.5')
     ELSE concat(CAST(n_chars AS STRING), 'e-2') END
"""


@query(f"""
WITH raw AS (SELECT doc_id AS id, TRY_CAST(trim({RAW_NUMBER}, concat(' ', chr(9), chr(13))) AS DOUBLE) AS x FROM documents)
SELECT id, CASE WHEN NOT isnan(x) THEN x END AS number, coalesce(CASE WHEN NOT isnan(x) THEN x END, 0e0) AS filled
FROM raw
""", rounded=["number", "filled"])
def numbers_from_text(spark, sf_dir):
    raw = run_sql(spark, sf_dir, f"SELECT doc_id AS id, {RAW_NUMBER} AS x FROM documents")
    return raw.select("id", to_number(F.col("x")).alias("number"), to_number(F.col("x"), 0.0).alias("filled"))


RAW_FLAG = """
CASE CAST(o_orderkey % 8 AS INT) WHEN 0 THEN concat(chr(9), 'True', chr(13)) WHEN 1 THEN ' true ' WHEN 2 THEN '1' WHEN 3 THEN 'YES'
     WHEN 4 THEN 'correct' WHEN 5 THEN 'no' WHEN 6 THEN '0' ELSE NULL END
"""


@query(f"""
WITH raw AS (SELECT o_orderkey AS id, {RAW_FLAG} AS x, o_totalprice / 5e5 AS share FROM orders)
SELECT id, coalesce(lower(trim(x, concat(' ', chr(9), chr(13)))) = 'true', false) AS as_text,
       coalesce(lower(trim(x, concat(' ', chr(9), chr(13)))) IN ('true', '1', 'yes', 'y', 'correct'), false) AS as_words,
       share > 5e-1 AS as_number
FROM raw
""")
def flags_from_text(spark, sf_dir):
    raw = run_sql(spark, sf_dir, f"SELECT o_orderkey AS id, {RAW_FLAG} AS x, o_totalprice / 5e5 AS share FROM orders")
    return raw.select(
        "id", to_flag(F.col("x")).alias("as_text"), to_flag(F.col("x"), "words").alias("as_words"),
        to_flag(F.col("share").cast("string"), "number").alias("as_number"),
    )


@query("""
SELECT dataset_name, model, count(*) AS n, CAST(sum(output_tokens) AS BIGINT) AS tokens
FROM fx_outcomes GROUP BY dataset_name, model
""")
def partitioned_table(spark, sf_dir):
    path = scratch_path(spark, "outcomes")
    write_table(view(spark, sf_dir, "fx_outcomes"), path, ["dataset_name", "model"])
    return spark.read.parquet(path).groupBy("dataset_name", "model").agg(
        F.count(F.lit(1)).alias("n"), F.sum("output_tokens").alias("tokens")
    )
