"""Difficulty labels from model consensus and from token use."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from answerflow.functions.costs import token_cost
from answerflow.functions.numbers import to_number
from answerflow.operators.ordering import exact_percentiles


def label_complex(df: DataFrame, threshold: float = 0.75, fraction: str = "slm_accuracy_fraction") -> DataFrame:
    """`complex` is 1 if strictly fewer models than the threshold solved the question."""
    return df.withColumn(
        "complex", F.coalesce((F.col(fraction) < F.lit(float(threshold))).cast("int"), F.lit(0))
    )


def complexity_score(
    df: DataFrame, digits: int | None = 1, fraction: str = "slm_accuracy_fraction"
) -> DataFrame:
    """`complexity_score` = 1 - fraction, rounded half to even (None: not rounded)."""
    score = F.lit(1.0) - F.col(fraction)
    return df.withColumn("complexity_score", score if digits is None else F.bround(score, digits))


def difficulty_score(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """`difficulty` = 1 - weighted share of solving models; unreadable flags count as unsolved."""
    missing = sorted(set(weights) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")

    def clipped(col: Column) -> Column:
        return F.least(F.greatest(col, F.lit(0.0)), F.lit(1.0))

    solved = sum(
        (clipped(to_number(F.col(c), 0.0)) * F.lit(float(w)) for c, w in weights.items()), F.lit(0.0)
    )
    return df.withColumn("difficulty", F.lit(1.0) - clipped(solved))


def label_high_cost(
    train: DataFrame, test: DataFrame, tokens: str = "llm_output_tokens", percentile: float = 0.95
) -> tuple[DataFrame, DataFrame]:
    """Label rows above the train percentile of output tokens, in both sets."""
    cut = exact_percentiles(train, tokens, [percentile]).select("q0").scalar()
    flag = F.coalesce((F.col(tokens) > cut).cast("int"), F.lit(0))
    return train.withColumn("high_cost", flag), test.withColumn("high_cost", flag)


def high_cost_report(
    train: DataFrame,
    test: DataFrame,
    tokens: str = "llm_output_tokens",
    input_tokens: str = "llm_input_tokens",
    percentile: float = 0.95,
) -> DataFrame:
    """One row: the cut, the USD cost of a question at the cut, and the share above it in each set."""
    cuts = exact_percentiles(train, tokens, [percentile]).select(F.col("q0").alias("cut_tokens"))

    above = F.avg(F.coalesce(F.col(tokens) > cuts.scalar(), F.lit(False)).cast("double"))
    on_train = train.agg(F.struct(above.alias("share"), F.avg(input_tokens).alias("input"))).scalar()
    return cuts.select(
        "cut_tokens",
        token_cost(on_train["input"], F.col("cut_tokens")).alias("usd_at_cut"),
        on_train["share"].alias("train_share"),
        test.agg(above).scalar().alias("test_share"),
    )


def quantile_bins(df: DataFrame, column: str, bins: int = 4, name: str = "bin") -> DataFrame:
    """0-based right-closed quantile bins; repeated edges are merged; missing and NaN stay missing."""
    probs = [i / bins for i in range(bins + 1)]
    distinct = exact_percentiles(df, column, probs).select(
        F.array_distinct(F.array(*[f"q{i}" for i in range(bins + 1)])).alias("e")
    )
    # The first and the last distinct edge bound the range; only those between separate bins.
    inner = [
        F.when(F.size("e") > i + 1, F.try_element_at("e", F.lit(i + 1))).alias(f"e{i}") for i in range(1, bins)
    ]
    edges = distinct.select(F.struct(*inner)).scalar()
    passed = sum(
        (F.coalesce((edges[f"e{i}"] < F.col(column)).cast("int"), F.lit(0)) for i in range(1, bins)), F.lit(0)
    )
    there = F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))
    return df.withColumn(name, F.when(there, passed))


def label_distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows and percentage per value."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("pct", F.col("n") * 100.0 / total)
