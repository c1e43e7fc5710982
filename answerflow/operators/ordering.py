"""Global order, running totals, exact percentiles and exact seeded sampling.

A window without `partitionBy`, or one over a group that holds a third of all rows, is a
single task. Everything here works on slices of bounded size instead: either ranges of a
total order, or prefixes of a uniform hash.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from answerflow.session import durable

SLICE = "_slice"
# Relative rank error of a percentile sketch is at most one over this.
SKETCH_ACCURACY = 10_000
# Hex digits of a row hash by which rows are counted before any are ranked.
PREFIX = 4


def same(left: str, right: str, keys: Sequence[str]) -> Column:
    """Null-safe equality of the key columns of two aliased frames."""
    return reduce(
        lambda a, b: a & b,
        [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys],
    )


def slice_by_order(df: DataFrame, order: Sequence[Column], slices: int | None = None) -> DataFrame:
    """Range-partition by `order` and tag every row with its slice number.

    The order must be total (end with a unique column), so that a value held by many rows is
    still cut into several slices. The tagged rows are written out once: all later passes
    see the same slices. Unless given, there are as many as shuffle partitions.
    """
    if slices is None:
        slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return durable(df.repartitionByRange(slices, *order).withColumn(SLICE, F.spark_partition_id()))


def running_totals(
    sliced: DataFrame, order: Sequence[Column], totals: dict[str, Column], by: Sequence[str] = ()
) -> DataFrame:
    """Add inclusive running totals along `order`, within `by` groups if given.

    Each slice is totalled first; a slice then starts from the totals of the slices before
    it. Without `by` there is one offset row per slice, so that table may be broadcast; with
    `by` its size depends on the data and the join is left to runtime statistics.
    """
    by = list(by)
    per_slice = sliced.groupBy(*by, SLICE).agg(*[F.sum(c).alias(n) for n, c in totals.items()])
    before = W.partitionBy(*by).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_slice.select(
        *by, SLICE, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_o_{n}") for n in totals]
    )
    if not by:
        offsets = F.broadcast(offsets)
    joined = sliced.alias("l").join(offsets.alias("r"), same("l", "r", [*by, SLICE]))
    inside = W.partitionBy(*[f"l.{k}" for k in [*by, SLICE]]).orderBy(*order).rowsBetween(
        W.unboundedPreceding, 0
    )
    return joined.select(
        "l.*", *[(F.col(f"_o_{n}") + F.sum(c).over(inside)).alias(n) for n, c in totals.items()]
    )


def ordered_totals(
    df: DataFrame, order: Sequence[Column], totals: dict[str, Column], by: Sequence[str] = ()
) -> DataFrame:
    """Inclusive running totals along a total order, slice by slice. `df` is read once."""
    sliced = slice_by_order(df, [*[F.col(k).asc() for k in by], *order])
    return running_totals(sliced, order, totals, by).drop(SLICE)


def exact_percentiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), name: str = "q"
) -> DataFrame:
    """Linear-interpolated percentiles as columns `q0, q1, ...` plus the row count `n`. NaN is
    missing.

    The values are written once. A sketch whose rank error is bounded gives a narrow bracket
    for each percentile; the distinct values inside a bracket are counted, and only the number
    of rows between brackets. So no group is sorted: a task holds one bracket of one group, a
    few of ten thousand of its rows, counted by value (the built-in `percentile` keeps all
    distinct values in one buffer). Should a bracket miss its percentile, the job fails.
    """
    by = list(by)
    marks = sorted(set(probs))
    good = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    rows = durable(df.where(good).select(*by, F.col(value).alias("_v")))
    slack = 2.0 / SKETCH_ACCURACY
    ends = [min(max(p + move, 0.0), 1.0) for p in marks for move in (-slack, slack)]
    sketch = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", ends, SKETCH_ACCURACY).alias("_sketch"),
    )

    # The slack is twice the sketch's error. What is left of it must be a few rows, or the bracket
    # is the whole (small) group.
    fine = F.col("n") >= 4 * SKETCH_ACCURACY

    def end(j: int) -> Column:
        whole = F.col("_max") if j % 2 else F.col("_min")
        return whole if ends[j] in (0.0, 1.0) else F.when(fine, F.col("_sketch")[j]).otherwise(whole)

    sketch = sketch.select(
        *by, "n", *[end(2 * i).alias(f"_from{i}") for i in range(len(marks))], *[end(2 * i + 1).alias(f"_to{i}") for i in range(len(marks))]
    )
    # Without groups it is one row.
    brackets = sketch if by else F.broadcast(sketch)
    on = same("l", "r", by) if by else F.lit(True)
    placed = rows.alias("l").join(brackets.alias("r"), on).select("l.*", *[f"r.{c}" for c in sketch.columns if c not in by])
    # Brackets begun at or before the value; within one, its values come before what lies between
    # it and the next (`_gap` = 1, no value).
    begun = [F.col("_v") >= F.col(f"_from{i}") for i in range(len(marks))]
    inside = reduce(lambda a, b: a | b, [c & (F.col("_v") <= F.col(f"_to{i}")) for i, c in enumerate(begun)])
    counts = placed.groupBy(
        *by, sum((c.cast("int") for c in begun), F.lit(0)).alias("_slot"), (~inside).cast("int").alias("_gap"),
        F.when(inside, F.col("_v")).alias("_v"),
    ).agg(F.count(F.lit(1)).alias("_n"))
    within = W.partitionBy(*by, "_slot").orderBy("_gap", "_v").rowsBetween(W.unboundedPreceding, 0)
    slots = range(1, len(marks) + 1)
    earlier = counts.groupBy(*by).agg(
        *[F.coalesce(F.sum(F.when(F.col("_slot") < k, F.col("_n"))), F.lit(0)).alias(f"_before{k}") for k in slots]
    )
    upto = counts.withColumn("_in_slot", F.sum("_n").over(within))
    sizes = sketch.select(*by, "n").alias("s")
    full = earlier.alias("e").join(sizes, same("e", "s", by) if by else F.lit(True)).select("e.*", "s.n")
    full = full if by else F.broadcast(full)
    placed = upto.alias("l").join(full.alias("r"), on).select("l.*", *[f"r.{c}" for c in full.columns if c not in by])
    before = reduce(lambda a, k: F.when(F.col("_slot") == k, F.col(f"_before{k}")).otherwise(a), slots, F.lit(0))
    last = before + F.col("_in_slot")
    picks = []
    for i, p in enumerate(probs):
        at = (F.col("n") - 1) * F.lit(float(p))
        for side, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            covers = (last - F.col("_n") <= pos) & (pos < last)
            picks.append(F.max(F.when(covers, F.col("_v"))).alias(f"_{side}{i}"))
    found = placed.groupBy(*by).agg(F.max("n").alias("n"), *picks)
    missed = F.raise_error(F.lit("a percentile lies outside its bracket")).cast("double")
    out = []
    for i, p in enumerate(probs):
        at = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.col(f"_lo{i}").cast("double"), F.col(f"_hi{i}").cast("double")
        number = low + (high - low) * (at - F.floor(at))
        out.append(F.when(F.col("n") > 0, F.coalesce(number, missed)).alias(f"{name}{i}"))
    if by:
        return found.select(*by, "n", *out)
    # An empty set has one row, too.
    return found.select(F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), *out)


def row_hash(key: str | Column | Sequence[str], seed: int) -> Column:
    """A uniform, engine-independent 32-digit hex hash of a row key: a column, or several, whose
    texts are joined with their lengths."""
    if isinstance(key, (list, tuple)) and len(key) == 1:
        key = key[0]
    if isinstance(key, (list, tuple)):
        texts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]
        key = F.concat_ws("|", *[F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in texts])
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")).cast("binary"))


def hash_fraction(key: str | Column | Sequence[str], seed: int) -> Column:
    """The row hash as a number in [0, 1)."""
    return F.conv(F.substring(row_hash(key, seed), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def hash_cuts(df: DataFrame, by: Sequence[str], key: str | Sequence[str], seed: int, take: Column) -> DataFrame:
    """Per group, the hash below or at which exactly `take` rows fall (`take` may use `_size`).

    Groups and hashes are written once. Rows are counted per hash prefix, which finds the prefix
    holding the cut; only the rows of that prefix (1 in 16^PREFIX) are then ranked. The full
    rows are never shuffled. `key`, a column or several, must be unique. Groups that take
    nothing have no row.
    """
    by = list(by)
    hashed = durable(df.select(*by, row_hash(key, seed).alias("_h"))).withColumn("_p", F.substring("_h", 1, PREFIX))
    per_prefix = hashed.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_c"))
    group = W.partitionBy(*by)
    upto = group.orderBy("_p").rowsBetween(W.unboundedPreceding, 0)
    edge = (
        per_prefix.select(
            *by, "_p", "_c", F.sum("_c").over(upto).alias("_upto"), F.sum("_c").over(group).alias("_size")
        )
        .withColumn("_take", take.cast("bigint"))
        .where((F.col("_take") <= F.col("_upto")) & (F.col("_take") > F.col("_upto") - F.col("_c")))
        .select(*by, "_p", (F.col("_take") - F.col("_upto") + F.col("_c")).alias("_need"))
    )
    near = hashed.alias("l").join(edge.alias("r"), same("l", "r", [*by, "_p"])).select(
        *[f"l.{k}" for k in by], "l._h", "r._need"
    )
    rank = F.row_number().over(W.partitionBy(*by, F.substring("_h", 1, PREFIX)).orderBy("_h"))
    return near.withColumn("_rank", rank).where("_rank = _need").select(*by, F.col("_h").alias("_cut"))


def below_cut(
    df: DataFrame, cuts: DataFrame, by: Sequence[str], key: str | Sequence[str], seed: int, flag: str
) -> DataFrame:
    """Add boolean `flag`: does the row's hash fall at or below its group's cut?

    `cuts` has one row per group; adaptive execution broadcasts it if it measures small and
    splits skewed groups otherwise.
    """
    if not by:
        return df.withColumn(
            flag, F.coalesce(row_hash(key, seed) <= cuts.select("_cut").scalar(), F.lit(False))
        )
    hashed = df.withColumn("_own_hash", row_hash(key, seed)).alias("l").join(cuts.alias("r"), same("l", "r", by), "left")
    picked = F.coalesce(F.col("_own_hash") <= F.col("r._cut"), F.lit(False))
    return hashed.select("l.*", picked.alias(flag)).drop("_own_hash")
