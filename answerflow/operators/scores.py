"""Turning model outputs into probabilities and combining several models."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F


def logistic(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def score_to_probability(df: DataFrame, name: str = "p") -> DataFrame:
    """Probability of label 1: as given, else from the margin, else the hard prediction."""
    if "probability" in df.columns:
        p = vector_to_array("probability")[1]
    elif "rawPrediction" in df.columns:
        p = logistic(vector_to_array("rawPrediction")[1])
    elif "margin" in df.columns:
        p = logistic(F.col("margin"))
    else:
        p = (F.col("prediction") == 1).cast("double")
    return df.withColumn(name, p)


def vote(
    models: list[DataFrame], how: str = "soft", key: str | Sequence[str] = "id", score: str = "p"
) -> DataFrame:
    """Combine score tables: `soft` mean probability, `hard` majority of labels, `mean` of scores.

    A hard tie goes to the lower label.
    """
    keys = [key] if isinstance(key, str) else list(key)
    tables = [
        m.select(*keys, F.col(score).cast("double").alias(f"_s{i}")) for i, m in enumerate(models)
    ]
    joined = reduce(lambda a, b: a.join(b, keys), tables)
    scores = [F.col(f"_s{i}") for i in range(len(tables))]
    mean = sum(scores, F.lit(0.0)) / F.lit(float(len(scores)))
    if how == "soft":
        return joined.select(*keys, mean.alias("p"), (mean > 0.5).cast("int").alias("prediction"))
    if how == "hard":
        yes = sum(((s > 0.5).cast("int") for s in scores), F.lit(0))
        return joined.select(*keys, (yes * 2 > len(scores)).cast("int").alias("prediction"))
    if how == "mean":
        return joined.select(*keys, mean.alias("score"))
    raise ValueError(f"unknown vote {how!r}")
