from __future__ import annotations

from pyspark.sql import functions as F

from answerflow.functions.costs import PROFILES
from answerflow.streaming.cache import semantic_cache
from answerflow.streaming.cascade import cascade_resolution, resolve_cascades
from answerflow.streaming.jobs import append_available, latest_available, rocksdb_state, stream_table
from answerflow.streaming.prompts import (
    answer_cents,
    cascade_rows,
    feedback_rows,
    feedback_windows,
    route_prompts,
)
from answerflow.streaming.repeats import dedupe_prompts
from checks.registry import query
from checks.views import table

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_columns(events):
    """The feedback view, on a batch or a stream of events."""
    kind = (
        F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "click", "satisfied")
        .when(F.col("event_type") == "purchase", "escalate").when(F.col("event_type") == "signup", "up").otherwise("down")
    )
    return events.select(
        F.col("event_id").alias("response_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("session_id"), kind.alias("kind"),
        F.when(F.col("event_id") % 4 == 0, "LLM").otherwise("SLM").alias("model"),
        F.col("value").alias("latency"), (F.col("event_id") % 90 + 10).alias("input_tokens"),
        (F.col("event_id") % 700).alias("output_tokens"), F.col("props").alias("prompt"),
    )


def event_stream(spark, sf_dir):
    return event_columns(stream_table(spark, f"{sf_dir}/events.parquet", EVENTS))


P = "((response_id * 7919) % 1000) / 999e0"
LIVE_SLM = f"(11e-2 * 31e-1 + {{c}} * (1e0 - ((1e0 - {P}) * 76e-2 + {P} * 39e-2)))"
LIVE_LLM = f"((154e0 * 125e-8 + 189718e-2 * 1e-5) * 1e2 + 11e-2 * 2381e-2 + {{c}} * (1e0 - ((1e0 - {P}) * 93e-2 + {P} * 83e-2)))"
C_ERR = "CASE WHEN response_id % 3 = 0 THEN CAST(response_id % 20 + 1 AS DOUBLE) ELSE 15e0 END"
LIVE = f"CASE WHEN {LIVE_LLM.format(c=f'({C_ERR})')} < {LIVE_SLM.format(c=f'({C_ERR})')} THEN 'llm' ELSE 'slm' END"


@query(f"""
WITH r AS (SELECT *, CASE WHEN kind = 'up' THEN lower(model) ELSE {LIVE} END AS route FROM fx_feedback)
SELECT response_id, route, CASE WHEN route = 'llm' THEN (input_tokens * 125e-8 + output_tokens * 1e-5) * 1e2 ELSE 0e0 END AS cents FROM r
""", rounded=["cents"], digits=9)
def routed_prompt_stream(spark, sf_dir):
    prompts = event_stream(spark, sf_dir).withColumns(
        {
            "p": F.col("response_id") * 7919 % 1000 / 999.0,
            "settings": F.when(F.col("response_id") % 3 == 0, F.create_map(F.lit("C_ERR"), (F.col("response_id") % 20 + 1).cast("string"))),
            "asked": F.when(F.col("kind") == "up", F.col("model")),
        }
    )
    routed = route_prompts(prompts, PROFILES["live"], requested="asked", settings="settings")
    cents = answer_cents(F.col("route"), F.col("input_tokens"), F.col("output_tokens"))
    return append_available(routed.select("response_id", "route", cents.alias("cents")), "routes")


@query("""
SELECT CAST(response_id AS STRING) AS response_id, concat('a', ' b', CAST(session_id AS STRING)) AS question, 'x' AS answer, latency,
       input_tokens, output_tokens, CASE WHEN model = 'LLM' THEN 'large' ELSE 'small' END AS model, kind = 'up' AS is_good
FROM fx_feedback
""", rounded=["latency"])
def feedback_log_stream(spark, sf_dir):
    events = event_stream(spark, sf_dir).withColumns(
        {"question": F.concat(F.lit(" a\r\nb"), F.col("session_id")), "answer": F.lit("x\n")}
    )
    return append_available(feedback_rows(events), "feedback")


@query("""
SELECT CASE WHEN response_id % 10 = 0 THEN NULL ELSE concat('s', CAST(response_id AS STRING)) END AS response_id, 'small' AS model,
       kind = 'satisfied' AS is_good, latency, 'q' AS question
FROM fx_feedback WHERE kind IN ('satisfied', 'escalate')
UNION ALL
SELECT concat('l', CAST(response_id AS STRING)), 'large', true, latency * 2e0, 'q' FROM fx_feedback WHERE kind = 'escalate'
""", rounded=["latency"])
def cascade_log_stream(spark, sf_dir):
    events = event_stream(spark, sf_dir)
    given = F.when(F.col("response_id") % 10 == 0, F.lit(" ")).otherwise(F.concat(F.lit("s"), F.col("response_id")))
    rows = events.select(
        "kind", F.lit("q").alias("question"),
        given.alias("slm_response_id"), F.lit("a").alias("slm_answer"), F.col("latency").alias("slm_latency"),
        F.col("input_tokens").alias("slm_input_tokens"), F.col("output_tokens").alias("slm_output_tokens"),
        F.concat(F.lit("l"), F.col("response_id")).alias("llm_response_id"), F.lit("b").alias("llm_answer"),
        (F.col("latency") * 2).alias("llm_latency"), F.col("input_tokens").alias("llm_input_tokens"),
        F.col("output_tokens").alias("llm_output_tokens"),
    )
    logged = append_available(cascade_rows(rows), "cascade-log")
    # Ids made from the content are 36 characters long.
    fresh = F.length("response_id") == 36
    return logged.select(
        F.when(~fresh, F.col("response_id")).alias("response_id"), "model", "is_good", "latency", "question"
    )


RESOLVED = """
e AS (SELECT session_id, response_id, kind, epoch_us(ts) AS t,
             lead(kind) OVER w AS nk, lead(epoch_us(ts)) OVER w AS nt
      FROM fx_feedback WHERE kind IN ('start', 'satisfied', 'escalate')
      WINDOW w AS (PARTITION BY session_id ORDER BY epoch_us(ts), response_id)),
o AS (SELECT session_id, response_id, t AS started_us,
             CASE WHEN nt <= t + 3600000000 AND nk = 'satisfied' THEN 'satisfied'
                  WHEN nt <= t + 3600000000 AND nk = 'escalate' THEN 'escalated' ELSE 'abandoned' END AS outcome,
             CASE WHEN nt <= t + 3600000000 THEN nt ELSE t + 3600000000 END AS resolved_us
      FROM e WHERE kind = 'start')
"""


def in_micros(df):
    return df.select(
        "session_id", "response_id", F.unix_micros("ts").alias("started_us"), "outcome",
        F.unix_micros("resolved_at").alias("resolved_us"),
    )


@query(f"WITH {RESOLVED} SELECT * FROM o")
def cascade_outcomes(spark, sf_dir):
    return in_micros(resolve_cascades(event_columns(table(spark, sf_dir, "events"))))


# A stream reports what the watermark (newest event minus one hour) has passed.
@query(f"""
WITH {RESOLVED}, w AS (SELECT (max(epoch_us(ts)) // 1000 - 3600000) AS wm FROM fx_feedback WHERE kind IN ('start', 'satisfied', 'escalate'))
SELECT o.* FROM o, w WHERE resolved_us <= wm * 1000
""")
def cascade_outcome_stream(spark, sf_dir):
    with rocksdb_state(spark):
        return in_micros(append_available(cascade_resolution(event_stream(spark, sf_dir)), "cascades"))


def windows(start: str, width_us: int) -> str:
    return f"""
    SELECT s AS start_us, s + {width_us} AS end_us, model, count(*) AS n, avg(CASE WHEN kind = 'up' THEN 1e0 ELSE 0e0 END) AS good_rate,
           avg(latency) AS avg_latency,
           sum(CASE WHEN model = 'LLM' THEN (input_tokens * 125e-8 + output_tokens * 1e-5) * 1e2 ELSE 0e0 END) AS cents
    FROM ({start}) GROUP BY s, model"""


def window_micros(df):
    return df.select(
        F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "model", "n", "good_rate", "avg_latency", "cents"
    )


@query(windows("SELECT *, epoch_us(ts) // 86400000000 * 86400000000 AS s FROM fx_feedback", 86400000000),
       rounded=["good_rate", "avg_latency", "cents"])
def daily_feedback_stream(spark, sf_dir):
    stream = event_stream(spark, sf_dir).withWatermark("ts", "1 hour")
    return window_micros(latest_available(feedback_windows(stream), ["start", "end", "model"], "windows"))


# In append mode a window is reported once the watermark has passed its end.
@query(f"""
SELECT * FROM ({windows("SELECT *, epoch_us(ts) // 86400000000 * 86400000000 AS s FROM fx_feedback", 86400000000)})
WHERE end_us <= (SELECT max(epoch_us(ts)) - 3600000000 FROM fx_feedback)
""", rounded=["good_rate", "avg_latency", "cents"])
def closed_feedback_window_stream(spark, sf_dir):
    stream = event_stream(spark, sf_dir).withWatermark("ts", "1 hour")
    return window_micros(append_available(feedback_windows(stream), "closed-windows"))


@query(windows("""
SELECT *, epoch_us(ts) // 43200000000 * 43200000000 - 43200000000 * k AS s FROM fx_feedback, (SELECT unnest([0, 1]) AS k)""", 86400000000),
       rounded=["good_rate", "avg_latency", "cents"])
def sliding_feedback_windows(spark, sf_dir):
    return window_micros(feedback_windows(event_columns(table(spark, sf_dir, "events")), "1 day", "12 hours"))


# The next row kept after one is the first that is more than an hour younger.
@query("""
WITH RECURSIVE e AS (SELECT event_id AS response_id, props AS prompt, epoch_us(ts) AS t FROM events),
kept AS (
  SELECT prompt, min(t) AS t FROM e GROUP BY prompt
  UNION ALL
  SELECT k.prompt, min(e.t) FROM kept k JOIN e ON e.prompt = k.prompt AND e.t > k.t + 3600000000 GROUP BY k.prompt)
SELECT e.response_id, e.prompt FROM kept JOIN e ON e.prompt = kept.prompt AND e.t = kept.t
""")
def deduplicated_prompt_stream(spark, sf_dir):
    stream = event_stream(spark, sf_dir).select("response_id", "ts", "prompt")
    with rocksdb_state(spark):
        return append_available(dedupe_prompts(stream), "deduplicated").select("response_id", "prompt")


# A user's prompts one after the other: entries of the last five days, four at most, first in, first out.
@query("""
WITH RECURSIVE n AS (SELECT count(*) AS n FROM embeddings),
e AS (SELECT event_id, user_id, epoch_us(ts) AS t, CAST(v.embedding AS DOUBLE[]) AS e,
             row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS k
      FROM events, n JOIN embeddings v ON v.vec_id = event_id % n.n),
c AS (
  SELECT user_id, k, event_id, CAST(NULL AS BIGINT) AS met, CAST(NULL AS DOUBLE) AS similarity,
         [{'id': event_id, 't': t, 'e': e}] AS entries FROM e WHERE k = 1
  UNION ALL
  SELECT user_id, k, event_id, best.id, best.s,
         CASE WHEN best IS NULL THEN list_append(live, {'id': event_id, 't': t, 'e': e})[-4:] ELSE live END
  FROM (SELECT *, list_filter(near, lambda x: x.s >= 2e-1 AND x.s = list_max(list_transform(near, lambda y: y.s)))[1] AS best
        FROM (SELECT *, list_transform(live, lambda x: {'id': x.id, 's': list_cosine_similarity(x.e, e)}) AS near
              FROM (SELECT e.*, list_filter(c.entries, lambda x: x.t + 432000000000 >= e.t) AS live
                    FROM c JOIN e ON e.user_id = c.user_id AND e.k = c.k + 1))))
SELECT event_id AS response_id, CAST(met AS STRING) AS cached_id, similarity FROM c
""", rounded=["similarity"])
def semantic_cache_stream(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    n = vectors.count()
    events = event_stream(spark, sf_dir).select("response_id", "ts", "session_id")
    prompts = events.join(vectors.select("vec_id", "embedding"), F.col("response_id") % n == F.col("vec_id")).drop("vec_id")
    with rocksdb_state(spark):
        cached = semantic_cache(
            prompts, key="response_id", scope="session_id", threshold=0.2, ttl_seconds=432_000, max_entries=4, planes=0
        )
        return append_available(cached, "semantic-cache").select("response_id", "cached_id", "similarity")
