"""Summary of a batch of questions that a router has answered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from answerflow.functions.costs import token_cost


def routed_batch_summary(df: DataFrame, bucket: str = "bucket", by: Sequence[str] = ()) -> DataFrame:
    """Counts, right answers, time, tokens and USD of a routed batch.

    Rows in the `default` bucket were not routed: they count, but add no time or tokens.
    """
    small, big = F.col(bucket) == "slm", F.col(bucket) == "llm"

    def total(mask: Column, column: str) -> Column:
        return F.coalesce(F.sum(F.when(mask, F.col(column))), F.lit(0))

    summed = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(small).alias("n_slm"),
        F.count_if(big).alias("n_llm"),
        F.count_if(~small & ~big).alias("n_default"),
        total(small, "slm_correct").cast("bigint").alias("slm_correct"),
        total(big, "llm_correct").cast("bigint").alias("llm_correct"),
        total(small, "slm_latency").cast("double").alias("slm_seconds"),
        total(big, "llm_latency").cast("double").alias("llm_seconds"),
        total(big, "llm_input_tokens").cast("bigint").alias("llm_input_tokens"),
        total(big, "llm_output_tokens").cast("bigint").alias("llm_output_tokens"),
    )
    routed = F.col("n_slm") + F.col("n_llm")
    per = F.nullif(routed, F.lit(0))
    seconds = F.col("slm_seconds") + F.col("llm_seconds")
    usd = token_cost(F.col("llm_input_tokens"), F.col("llm_output_tokens"))
    return summed.select(
        "*",
        routed.alias("n_routed"),
        (F.col("n_slm") / F.col("n")).alias("slm_share"),
        (F.col("n_llm") / F.col("n")).alias("llm_share"),
        F.coalesce((F.col("slm_correct") + F.col("llm_correct")) / per, F.lit(0.0)).alias("accuracy"),
        seconds.alias("total_seconds"),
        F.coalesce(seconds / per, F.lit(0.0)).alias("avg_seconds"),
        usd.alias("usd"),
        F.coalesce(usd / per, F.lit(0.0)).alias("usd_per_question"),
    )


def raw_route_counts(df: DataFrame, route: str = "route") -> DataFrame:
    """How often each route value occurs, most frequent first."""
    return df.groupBy(route).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), route)
