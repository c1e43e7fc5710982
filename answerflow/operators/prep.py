"""Filtering, sampling, splitting and balancing question sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from answerflow.operators.ordering import below_cut, hash_cuts, hash_fraction, same


def exclude_value(df: DataFrame, column: str, value: object) -> DataFrame:
    """Drop rows that hold `value`; rows where it is missing stay."""
    return df.where(~F.col(column).eqNullSafe(F.lit(value)))


def filter_category(df: DataFrame, category: str | None) -> DataFrame:
    """Keep one category, named by `category` or else by `dataset_name`; None keeps all."""
    if category is None or category == "none":
        return df
    for column in ("category", "dataset_name"):
        if column in df.columns:
            return df.where(F.col(column) == category)
    raise ValueError("neither a 'category' nor a 'dataset_name' column")


def stratified_sample(df: DataFrame, by: Sequence[str], key: str | Sequence[str], fraction: float, seed: int = 42) -> DataFrame:
    """Exactly the rounded `fraction` of each group, the same rows for the same seed.

    Groups with a missing name are dropped.
    """
    named = df.dropna(subset=list(by))
    take = F.bround(F.col("_size") * F.lit(float(fraction)), 0)
    cuts = hash_cuts(named, by, key, seed, take)
    return below_cut(named, cuts, by, key, seed, "_picked").where("_picked").drop("_picked")


def stratified_split(
    df: DataFrame, by: Sequence[str], key: str | Sequence[str], test_fraction: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add `split`: `test` for the rounded fraction of each group, else `train`."""
    take = F.bround(F.col("_size") * F.lit(float(test_fraction)), 0)
    marked = below_cut(df, hash_cuts(df, by, key, seed, take), by, key, seed, "_test")
    return marked.withColumn(
        "split", F.when(F.col("_test"), F.lit("test")).otherwise(F.lit("train"))
    ).drop("_test")


def random_split(df: DataFrame, key: str | Sequence[str], test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Add `split` by hash alone: no shuffle, size within sampling error of the fraction."""
    return df.withColumn(
        "split",
        F.when(hash_fraction(key, seed) < F.lit(float(test_fraction)), F.lit("test")).otherwise(F.lit("train")),
    )


def downsample_majority(df: DataFrame, label: str, key: str | Sequence[str], seed: int = 42) -> DataFrame:
    """Cut the rows of label 1 to the number of rows of label 0, if there are more of them."""
    simple = df.where(F.col(label) == 0).agg(F.count(F.lit(1))).scalar()
    labelled = df.where(F.col(label).isin(0, 1))
    take = F.when(F.col(label) == 1, F.least(F.col("_size"), simple)).otherwise(F.col("_size"))
    cuts = hash_cuts(labelled, [label], key, seed, take)
    return below_cut(labelled, cuts, [label], key, seed, "_picked").where("_picked").drop("_picked")


def _hash_normal(key: Column, position: Column, seed: int) -> Column:
    """A standard normal draw fixed by row key, position and seed (Box-Muller on two hashes)."""
    u1 = (F.pmod(F.xxhash64(key, position, F.lit(seed)), F.lit(2**53)) + 1) / F.lit(float(2**53))
    u2 = F.pmod(F.xxhash64(key, position, F.lit(seed + 1)), F.lit(2**53)) / F.lit(float(2**53))
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)


def augment_minority(
    df: DataFrame,
    label: str,
    vector: str,
    key: str,
    minority: int = 0,
    factor: int = 2,
    noise_std: float = 0.01,
    seed: int = 42,
) -> DataFrame:
    """Add `factor - 1` noisy copies of every minority row; `copy` 0 is the row itself.

    Noise is drawn from a hash, so it does not depend on how the rows are partitioned.
    """
    if factor < 2:
        return df.withColumn("copy", F.lit(0))
    copies = F.when(F.col(label) == minority, F.sequence(F.lit(0), F.lit(factor - 1))).otherwise(
        F.array(F.lit(0))
    )
    noisy = F.transform(
        vector,
        lambda x, i: x
        + F.lit(float(noise_std)) * _hash_normal(F.concat_ws("|", F.col(key), F.col("copy")), i, seed),
    )
    return df.withColumn("copy", F.explode(copies)).withColumn(
        vector, F.when(F.col("copy") == 0, F.col(vector).cast("array<double>")).otherwise(noisy)
    )


def class_weights(df: DataFrame, label: str, weight: str = "weight") -> DataFrame:
    """Balanced class weights: rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.agg(
        (F.sum("_n").cast("double") / F.count(F.lit(1))).alias("_even")
    )
    return counts.select(label, (totals.scalar() / F.col("_n")).alias(weight))


def with_class_weights(df: DataFrame, label: str, weight: str = "weight") -> DataFrame:
    """Each row with the weight of its class."""
    weights = class_weights(df, label, weight)
    return df.alias("l").join(weights.alias("r"), same("l", "r", [label])).select("l.*", f"r.{weight}")


def append_constant_labeled(
    main: DataFrame, simple: DataFrame, question: str = "question", fraction: str = "slm_accuracy_fraction"
) -> DataFrame:
    """Union of the main set and an all-simple set (fraction 1, label 0); incomplete rows are dropped."""
    first = main.dropna(subset=[question, fraction]).withColumn("is_simple", F.lit(False))
    second = (
        simple.dropna(subset=[question])
        .withColumn(fraction, F.lit(1.0))
        .withColumn("label", F.lit(0))
        .withColumn("is_simple", F.lit(True))
    )
    return first.unionByName(second, allowMissingColumns=True)
