"""Stand-in views over the driver tables, in SQL that Spark and the checking engine both accept."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


# The statements of FIXTURES.md.
VIEWS = {
    "fx_outcomes": """
SELECT l_orderkey AS id,
       concat('m', CAST(l_linenumber AS STRING)) AS model,
       o_orderpriority AS dataset_name,
       o_orderstatus AS category,
       CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS correct,
       l_quantity / 1e1 AS latency,
       l_partkey % 500 + 20 AS input_tokens,
       CAST(floor(l_extendedprice / 1e1) AS BIGINT) AS output_tokens
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                   ORDER BY l_partkey, l_suppkey, l_extendedprice,
                                            l_quantity, l_shipdate, l_returnflag) AS rn FROM lineitem) l
JOIN orders ON l_orderkey = o_orderkey
WHERE rn = 1
""",
    "fx_pairs": """
SELECT s.id AS id, s.dataset_name AS dataset_name, s.category AS category,
       s.correct AS slm_correct, s.latency AS slm_latency,
       s.input_tokens AS slm_input_tokens, s.output_tokens AS slm_output_tokens,
       l.correct AS llm_correct, l.latency * 7e0 AS llm_latency,
       l.input_tokens AS llm_input_tokens, l.output_tokens AS llm_output_tokens,
       ((s.id * 7919) % 1000) / 999e0 AS p
FROM fx_outcomes s JOIN fx_outcomes l ON s.id = l.id
WHERE s.model = 'm1' AND l.model = 'm2'
""",
    "fx_fraction": """
SELECT id, min(dataset_name) AS dataset_name, min(category) AS category,
       CAST(sum(correct) AS BIGINT) AS n_correct,
       sum(correct) / 4e0 AS slm_accuracy_fraction
FROM fx_outcomes WHERE model IN ('m1', 'm2', 'm3', 'm4')
GROUP BY id HAVING count(*) = 4
""",
    "fx_questions": """
SELECT doc_id AS id, text AS question, lang AS dataset_name, source AS category,
       CASE WHEN doc_id % 3 = 0 THEN 'multi' WHEN doc_id % 3 = 1 THEN 'single' END AS choice_type
FROM documents
""",
    "fx_responses": """
SELECT doc_id AS id, concat('m', CAST(doc_id % 3 AS STRING)) AS model, lang AS category,
       substr('ABCDEFGHIJ', CAST(doc_id % 10 AS INT) + 1, 1) AS letter,
       substr('ABCDEFGHIJ', CAST((doc_id * 7) % 10 AS INT) + 1, 1) AS gold_letter,
       concat(CAST(doc_id % 5 AS STRING), '/', CAST(doc_id % 7 + 1 AS STRING)) AS gold_math,
       CASE doc_id % 8
         WHEN 0 THEN concat('step one. The answer is (', substr('ABCDEFGHIJ', CAST(doc_id % 10 AS INT) + 1, 1), ').')
         WHEN 1 THEN concat('so the answer is ', substr('ABCDEFGHIJ', CAST(doc_id % 10 AS INT) + 1, 1), chr(10), 'Answer: J')
         WHEN 2 THEN concat('line', chr(10), 'final Answer: ', substr('ABCDEFGHIJ', CAST(doc_id % 10 AS INT) + 1, 1))
         WHEN 3 THEN concat('either A or B, finally ', substr('ABCDEFGHIJ', CAST(doc_id % 10 AS INT) + 1, 1))
         WHEN 4 THEN 'no choice was made'
         WHEN 5 THEN concat('thus ', chr(92), 'boxed{', chr(92), 'dfrac{', CAST(doc_id % 5 AS STRING), '}{', CAST(doc_id % 7 + 1 AS STRING), '}}')
         WHEN 6 THEN concat('broken ', chr(92), 'boxed{', chr(92), 'frac{1}{2}')
         ELSE concat(chr(92), 'boxed{', CAST(doc_id % 5 AS STRING), '/', CAST(doc_id % 7 + 1 AS STRING), ' cm}')
       END AS response,
       n_chars / 1e3 AS latency,
       CASE WHEN doc_id % 11 = 0 THEN 'timeout' END AS error
FROM documents
""",
    "fx_vectors": """
SELECT vec_id AS id, embedding, label AS cluster,
       CASE WHEN label >= 5 THEN 1 ELSE 0 END AS complex, label / 9e0 AS difficulty
FROM embeddings
""",
    "fx_turns": """
SELECT u.conv_id AS conv_id, u.turn AS turn, u.text AS prompt, a.text AS answer
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'
""",
    "fx_feedback": """
SELECT event_id AS response_id, ts, user_id AS session_id,
       CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'satisfied'
            WHEN 'purchase' THEN 'escalate' WHEN 'signup' THEN 'up' ELSE 'down' END AS kind,
       CASE WHEN event_id % 4 = 0 THEN 'LLM' ELSE 'SLM' END AS model,
       value AS latency, event_id % 90 + 10 AS input_tokens, event_id % 700 AS output_tokens
FROM events
""",
    "fx_replies": """
SELECT event_id AS id,
       CASE event_id % 5
         WHEN 0 THEN '{"route":"small"}'
         WHEN 1 THEN '{"routing":{"selected_model":"big"}}'
         WHEN 2 THEN '{"metadata":{"route":"qwen-7b"}}'
         WHEN 3 THEN '{"model":"gpt-5"}'
         ELSE '{"other":1}' END AS reply
FROM events
""",
}


def names_in(sql: str) -> set[str]:
    return set(re.findall(r"\b\w+\b", sql))


def with_views(sql: str) -> str:
    """Prefix a statement with the views it uses, directly or through other views."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name in names_in(text) and name not in needed:
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    heads = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    body = sql.strip()
    if re.match(r"(?i)with\b", body):
        return f"WITH {heads},\n{body[4:].lstrip()}"
    return f"WITH {heads}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in view over the tables of one scale factor."""
    return run_sql(spark, sf_dir, f"SELECT * FROM {name}")


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a statement over the tables and views; only the tables it names are opened."""
    full = with_views(sql)
    for name in TABLES:
        if name in names_in(full):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(full)
