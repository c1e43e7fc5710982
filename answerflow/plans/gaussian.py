"""Gaussian naive Bayes written as two aggregations, for score tables that stay in SQL."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window as W, functions as F

SMOOTHING = 1e-9


def class_moments(train: DataFrame, label: str, vector: str = "embedding") -> DataFrame:
    """Per class: share of rows, mean and smoothed population variance per dimension."""
    dense = array_to_vector(F.transform(vector, lambda x: x.cast("double")))
    per_class = train.groupBy(F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n"),
        vector_to_array(Summarizer.mean(dense)).alias("mean"),
        vector_to_array(Summarizer.variance(dense)).alias("var"),
    )
    overall = train.agg(F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.variance(dense)).alias("var"))
    # The summarizer gives sample variances.
    widest = overall.select(
        F.array_max(F.transform("var", lambda v: v * (F.col("n") - 1) / F.col("n"))) * F.lit(SMOOTHING)
    ).scalar()
    share = F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0)))
    return per_class.withColumns({"prior": share, "_widest": widest}).select(
        "label", "prior", "mean",
        F.transform("var", lambda v: v * (F.col("n") - 1) / F.col("n") + F.col("_widest")).alias("var"),
    )


def gaussian_bayes(train: DataFrame, test: DataFrame, label: str, key: str = "id", vector: str = "embedding") -> DataFrame:
    """`p` of label 1 for every test row. The two class rows travel as one scalar."""
    moments = class_moments(train, label, vector).where(F.col("label").isin(0, 1))
    packed = moments.agg(
        F.sort_array(F.collect_list(F.struct("label", F.log("prior").alias("lp"), "mean", "var"))).alias("m")
    ).scalar()

    def likelihood(row):
        return row["lp"] + F.aggregate(
            F.zip_with(
                F.zip_with(F.col(vector), row["mean"], lambda x, m: x.cast("double") - m),
                row["var"],
                lambda d, v: F.log(v * 2.0 * 3.141592653589793) + d * d / v,
            ),
            F.lit(0.0),
            lambda a, x: a + x,
        ) * -0.5

    logs = F.transform("_m", lambda r: F.struct(r["label"].alias("label"), likelihood(r).alias("ll")))
    scored = test.withColumn("_m", packed).select(key, logs.alias("_l"))
    gap = F.col("_l")[0]["ll"] - F.col("_l")[1]["ll"]
    p = F.when(F.size("_l") == 2, 1.0 / (1.0 + F.exp(F.least(gap, F.lit(700.0))))).otherwise(
        F.col("_l")[0]["label"].cast("double")
    )
    return scored.select(key, p.alias("p")).withColumn("prediction", (F.col("p") > 0.5).cast("int"))
