"""Quality of difficulty predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from answerflow.operators.ordering import exact_percentiles, same


def ratio(top: Column, bottom: Column) -> Column:
    """0 instead of a division by zero."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / F.nullif(bottom, F.lit(0)))


def classification_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall and F1 of label 1."""
    y, z = F.col(actual) == 1, F.col(predicted) == 1
    counted = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(actual) == F.col(predicted)).alias("_right"),
        F.count_if(y & z).alias("_tp"), F.count_if(~y & z).alias("_fp"), F.count_if(y & ~z).alias("_fn"),
    )
    tp, fp, fn = F.col("_tp"), F.col("_fp"), F.col("_fn")
    return counted.select(
        *by, "n",
        ratio(F.col("_right"), F.col("n")).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def confusion_matrix(df: DataFrame, actual: str, predicted: str, labels: Sequence[int] = (0, 1)) -> DataFrame:
    """One row per cell, empty ones included, with the share of the actual label in percent."""
    cells = [(a, p) for a in labels for p in labels]
    counted = df.agg(
        *[
            F.count_if((F.col(actual) == a) & (F.col(predicted) == p)).alias(f"c{i}")
            for i, (a, p) in enumerate(cells)
        ]
    )
    rows = []
    for i, (a, p) in enumerate(cells):
        of_row = sum((F.col(f"c{j}") for j, (b, _) in enumerate(cells) if b == a), F.lit(0))
        rows.append(
            F.struct(
                F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"c{i}").alias("n"),
                ratio(F.col(f"c{i}") * 100.0, of_row).alias("row_pct"),
            )
        )
    return counted.select(F.explode(F.array(*rows)).alias("_c")).select("_c.*")


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE and R2 after clipping predictions to [0, 1]."""
    clipped = F.least(F.greatest(F.col(predicted), F.lit(0.0)), F.lit(1.0))
    gap = F.col(actual) - clipped
    return (
        df.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.abs(gap)).alias("mae"),
            F.sum(gap * gap).alias("_sse"),
            (F.var_pop(actual) * F.count(actual)).alias("_sst"),
        )
        .select(*by, "n", "mae", (F.lit(1.0) - F.col("_sse") / F.nullif("_sst", F.lit(0.0))).alias("r2"))
    )


def prediction_spread(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Box-plot numbers per actual score: quartiles and the outermost values within 1.5 IQR."""
    boxes = exact_percentiles(df, predicted, [0.25, 0.5, 0.75], [actual])
    boxes = boxes.select(
        actual, "n", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3")
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    value = F.col(predicted)
    return (
        df.select(actual, predicted).alias("l").join(boxes.alias("r"), same("l", "r", [actual]))
        .groupBy(f"l.{actual}")
        .agg(
            F.max("r.n").alias("n"), F.max("q1").alias("q1"), F.max("median").alias("median"), F.max("q3").alias("q3"),
            F.min(F.when(value >= F.col("q1") - reach, value)).alias("low"),
            F.max(F.when(value <= F.col("q3") + reach, value)).alias("high"),
        )
    )


