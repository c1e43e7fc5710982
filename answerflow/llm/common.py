"""Helpers shared by the operators: written intermediates, ranks without a whole group in one
task, packed rows and the word patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from answerflow.session import scratch_path, writing

# What counts as a word, and the letters that are lower-cased.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def store(df: DataFrame, label: str) -> DataFrame:
    """Write the rows as Parquet to the folder all executors share and go on from there.

    Cuts the lineage, survives lost executors, and later passes see the same rows. The shuffle
    files that led to them go at once, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with writing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(
    df: DataFrame, by: Sequence[str], order: Sequence[str], name: str, totals: dict[str, Column] | None = None
) -> DataFrame:
    """Add `name`: the row's number (from 0) within `by` along `order`, and the sums of
    `totals` over the earlier rows of the group.

    Rows are dealt to ranges of (by, order), so that a group with a third of all rows is
    spread over many tasks; a range continues from the sums of the ranges before it. `order`
    should be total up to equal rows. The rows are written once.
    """
    totals = {name: F.lit(1).cast("long"), **(totals or {})}
    by = list(by)
    keys = [F.col(c).asc_nulls_first() for c in [*by, *order]]
    dealt = df.repartitionByRange(shuffle_width(df.sparkSession), *keys)
    dealt = store(dealt.withColumn("_range", F.spark_partition_id()), f"ranges-{name}")
    sums = dealt.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in totals.items()])
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(
        *[F.col(c).alias(f"_k_{c}") for c in by], F.col("_range").alias("_k_range"),
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in totals],
    )
    inside = W.partitionBy(*by, "_range").orderBy(*keys[len(by) :]).rowsBetween(W.unboundedPreceding, -1)
    local = dealt.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_l_{n}") for n, c in totals.items()])
    on = F.col("_range") == F.col("_k_range")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    joined = local.join(starts, on)
    return joined.select(*df.columns, *[(F.col(f"_b_{n}") + F.col(f"_l_{n}")).alias(n) for n in totals])


# A key that holds more than one in so many of all rows is joined by broadcast.
OFTEN = 256


def join_groups(rows: DataFrame, groups: DataFrame, by: Sequence[str], size: str) -> DataFrame:
    """`rows` with the columns of their group; rows without one go. Null keys are equal.

    `groups` has one row for each key and in `size` how many of the rows have it. Fewer than OFTEN keys can
    hold more than one in OFTEN of the rows: these are broadcast, so no task gets all rows of a
    frequent key; the others are shuffled.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    keyed = groups.select(*[F.col(c).alias(f"_k_{c}") for c in by], *[c for c in groups.columns if c not in by])
    often = F.broadcast(keyed.where(F.col(size) * OFTEN > F.lit(total)))
    rare = keyed.where(F.col(size) * OFTEN <= F.lit(total))
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    keys = [f"_k_{c}" for c in by]
    return (
        rows.join(often, on)
        .unionByName(rows.join(often, on, "left_anti").join(rare, on))
        .drop(*keys)
    )
