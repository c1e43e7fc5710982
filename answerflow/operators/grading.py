"""Grading a log of raw responses in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from answerflow.functions.text import LETTERS_10, extract_boxed, extract_choice, normalize_latex
from answerflow.operators.merge import answers_match


def apply_call_failures(df: DataFrame, error: str = "error") -> DataFrame:
    """A failed call keeps its error text as the response and counts as wrong, free and instant."""
    failed = F.col(error).isNotNull()
    return (
        df.withColumn("response", F.when(failed, F.col(error)).otherwise(F.col("response")))
        .withColumn("extracted", F.when(~failed, F.col("extracted")))
        .withColumn("correct", F.when(failed, F.lit(0)).otherwise(F.col("correct")))
        .withColumn("latency", F.when(failed, F.lit(0.0)).otherwise(F.col("latency")))
        .withColumn("input_tokens", F.when(failed, F.lit(0)).otherwise(F.col("input_tokens")).cast("bigint"))
        .withColumn("output_tokens", F.when(failed, F.lit(0)).otherwise(F.col("output_tokens")).cast("bigint"))
        .withColumn("failed", failed.cast("int"))
    )


def grade_choice(df: DataFrame, gold: str, letters: str = LETTERS_10, response: str = "response") -> DataFrame:
    """Add `extracted` and `correct` for multiple-choice answers."""
    graded = df.withColumn("extracted", extract_choice(F.col(response), letters))
    return graded.withColumn(
        "correct", F.coalesce(F.col("extracted") == F.col(gold), F.lit(False)).cast("int")
    )


def grade_math(df: DataFrame, gold: str, response: str = "response") -> DataFrame:
    """Add `extracted` and `correct` for boxed answers, compared after normalization."""
    graded = df.withColumn("extracted", extract_boxed(F.col(response)))
    equal = normalize_latex(F.col("extracted")) == normalize_latex(F.col(gold))
    return graded.withColumn("correct", F.coalesce(equal, F.lit(False)).cast("int"))


def regrade_exact(df: DataFrame, mode: str = "upper") -> DataFrame:
    """Regrade stored answers against the key: `raw`, or trimmed and in `upper` or `lower` case."""
    return df.withColumn("correct", answers_match(mode))


def grade_responses(df: DataFrame, kind: str, gold: str, letters: str = LETTERS_10) -> DataFrame:
    """Extract, grade and account for failed calls. `kind` is `choice` or `math`."""
    if kind == "choice":
        graded = grade_choice(df, gold, letters)
    elif kind == "math":
        graded = grade_math(df, gold)
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return apply_call_failures(graded) if "error" in df.columns else graded


def run_summary(graded: DataFrame, by: Sequence[str], expected: DataFrame | None = None) -> DataFrame:
    """Per group: answers, right answers, accuracy, mean latency, failed extractions and calls.

    `expected` (the `by` columns and `n_expected`) puts items that timed out without a row
    into the accuracy denominator.
    """
    by = list(by)
    summary = graded.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("correct").cast("bigint").alias("n_correct"),
        F.avg("latency").alias("avg_latency"),
        F.count_if(F.col("extracted").isNull()).alias("n_unextracted"),
        (F.sum("failed") if "failed" in graded.columns else F.lit(0)).cast("bigint").alias("n_failed"),
    )
    if expected is None:
        return summary.withColumn("accuracy", F.col("n_correct") / F.col("n"))
    return (
        summary.join(expected, by, "left")
        .withColumn("accuracy", F.col("n_correct") / F.coalesce("n_expected", "n"))
    )
