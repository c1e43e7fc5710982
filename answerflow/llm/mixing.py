"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions.

Targets rise with their weights until a source reaches its cap; what it can't take is shared
anew by weight until no target is above its cap. Each document is taken as often as its source
is repeated as a whole, and a seeded part of the documents once more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from answerflow.llm.common import numbered, store, word_count

# Documents of a source are summed by the first hex digits of their hash; only those of one
# prefix (1 in 4,096) are then put in order.
DIGITS = 3


def water_level(sources: DataFrame, total: float) -> float:
    """The level at which the targets, least(cap, weight * level), sum up to `total`; infinite
    if all caps together are below it. `sources` has weight and cap, one row per source.

    Each round clamps the sources above their cap and shares the rest by weight; only sums
    reach the driver.
    """
    level = 0.0
    while True:
        full = F.col("cap") < F.col("weight") * F.lit(level)
        sums = sources.agg(
            F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("clamped"),
            F.sum(F.when(~full, F.col("weight")).otherwise(0)).alias("open"),
        ).first()
        if not sums.open:
            return float("inf") if sums.open is not None else 0.0
        raised = (total - sums.clamped) / sums.open
        if raised <= level:
            return level
        level = raised


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Per source (null is one): source, source_size, target. `sizes` has source and size.

    Weights repeat over the sources by code point, null last.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(sums.withColumn("_none", F.col("source").isNull()), [], ["_none", "source"], "_rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    sources = ranked.select(
        "source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap")
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(sources, share * total)
    return sources.select(
        "source", "source_size", F.least(F.col("cap"), F.col("weight") * F.lit(level)).alias("target")
    )


def seeded(id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(id.cast("string"), F.lit(""))).cast("binary"))


def repetitions(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Per source: its size, target, whole repetitions, and where its hash order is cut:
    prefixes before `cut` are taken once more, and of prefix `cut` the first `left` words.

    `sizes` has source, size and hash.
    """
    aims = store(targets(sizes, weights, share, most), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    aims = aims.withColumn("whole", whole.cast("long"))
    aims = aims.withColumn("more", F.col("target") - F.col("whole") * F.col("source_size"))
    prefixes = sizes.groupBy("source", F.substring("hash", 1, DIGITS).alias("prefix")).agg(F.sum("size").alias("words"))
    upto = W.partitionBy("source").orderBy("prefix").rowsBetween(W.unboundedPreceding, -1)
    before = prefixes.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    a, b = aims.alias("a"), before.alias("b")
    # The first prefix that goes beyond the words needed; it has the edge, or begins at it.
    cut = (
        b.join(a, F.col("a.source").eqNullSafe(F.col("b.source")))
        .where((F.col("before") <= F.col("more")) & (F.col("more") < F.col("before") + F.col("words")))
        .select("b.source", F.col("prefix").alias("cut"), (F.col("more") - F.col("before")).alias("left"))
    ).alias("c")
    return a.join(cut, F.col("a.source").eqNullSafe(F.col("c.source")), "left").select(
        F.col("a.source").alias("of"), "source_size", "target", "whole", "cut", "left"
    )


def taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """`rows` (id, source, size, hash and others) with source_size, target and `repeats`."""
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    prefix = F.substring("hash", 1, DIGITS)
    edge = F.coalesce(prefix == F.col("cut"), F.lit(False))
    # Rows without an id all have one hash, so this prefix may hold most of a source.
    at_edge = numbered(joined.where(edge), ["source"], ["hash", "id", "size"], "_at", {"_before": F.col("size")})
    extra = (F.col("_before") + F.col("size") / 2 < F.col("left")).cast("long")
    at_edge = at_edge.withColumn("repeats", F.col("whole") + extra).drop("_at", "_before")
    others = joined.where(~edge).withColumn(
        "repeats", F.col("whole") + F.coalesce((prefix < F.col("cut")).cast("long"), F.lit(0))
    )
    return others.unionByName(at_edge).drop("cut", "left", "whole")


def mix(
    docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", *,
    weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 42, keep: bool = False,
) -> DataFrame:
    """One row per row of `docs`: id, source, size (words), source_size, target (words its source
    should give), repeats (how often the row is taken) and taken = size * repeats; with
    `keep` also `row`, the whole row as a struct.

    Sources share `share` times all words by their weights; none gives more than `most` times
    its own words. Null text has no words. Null is a source of its own, the last. Rows are put
    in the order of a seeded hash of their id (null ids count as empty), so reruns agree
    whatever the partitioning; the words taken miss a target by at most half of one document.
    Of repeated rows any may be the one taken once more. Extra columns only go into `row`. An
    empty table gives an empty result.
    """
    base = docs.select(
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep else []),
        F.col(id).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
        seeded(F.col(id), seed).alias("hash"),
    )
    sizes = store(base.select("id", "source", "size", "hash"), "mix-sizes")
    plan = store(repetitions(sizes, weights, share, most), "mix-plan")
    mixed = taken(base if keep else sizes, plan).drop("hash")
    return mixed.withColumn("taken", F.col("size") * F.col("repeats"))


def repeated(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows and columns of `docs`, each as often as the mix takes it."""
    mixed = mix(docs, id, text, source, keep=True, **options).where(F.col("repeats") > 0)
    copies = mixed.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))))
    return copies.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
