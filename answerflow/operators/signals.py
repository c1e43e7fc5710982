"""Routing by semantic signals: prototypes, hard/easy contrast, rules and knowledge groups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from answerflow.operators.cones import best_cosines

# Signal thresholds and the blend of the best and the mean of the top prototypes.
COMPLEX_THRESHOLD = 0.68
SIMPLE_THRESHOLD = 0.74
CONTRAST_THRESHOLD = 0.65
BEST_WEIGHT = 0.75
TOP_M = 2


def top_similarities(
    df: DataFrame, prototypes: DataFrame, m: int = TOP_M, key: str = "id", vector: str = "embedding",
    cones: int | None = None,
) -> DataFrame:
    """`key` and `tops`: per signal, the m best cosines to its prototypes, best first.

    `prototypes` has `signal` and the vector column. They are dealt to `cones`, of which a row
    visits those that can hold one of its best. A row without a vector has no similarities;
    prototypes without a vector or a signal are left out.
    """
    there = F.col(vector).isNotNull()
    protos = prototypes.where(there & F.col("signal").isNotNull()).select("signal", F.col(vector).alias("proto"))
    rows = df.where(there & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("vector"))
    best, _ = best_cosines(rows, protos, m, cones)
    entries = best.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("signal", "tops"))).alias("tops"))
    none = F.create_map().cast("map<string,array<double>>")
    return df.select(key).join(entries.withColumnRenamed("id", "_of"), F.col(key) == F.col("_of"), "left").select(
        key, F.coalesce("tops", none).alias("tops")
    )


def nearest(tops: Column, signal: str) -> Column:
    """Best cosine to a signal's prototypes."""
    return F.try_element_at(tops, F.lit(signal))[0]


def blended(tops: Column, signal: str, best_weight: float = BEST_WEIGHT) -> Column:
    """Weighted mean of the best cosine and the mean of the top ones."""
    top = F.try_element_at(tops, F.lit(signal))
    mean = F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top)
    return top[0] * F.lit(best_weight) + mean * F.lit(1.0 - best_weight)


def nearest_prototype_signal(scored: DataFrame, signal: str, threshold: float, name: str) -> DataFrame:
    """Add the signal's similarity and whether it fires."""
    value = nearest(F.col("tops"), signal)
    return scored.withColumn(f"{name}_score", value).withColumn(
        name, F.coalesce(value >= F.lit(float(threshold)), F.lit(False)).cast("int")
    )


def contrast_signal(
    scored: DataFrame, hard: str = "hard", easy: str = "easy", threshold: float = CONTRAST_THRESHOLD,
    best_weight: float = BEST_WEIGHT, name: str = "task_complexity",
) -> DataFrame:
    """Add `hard`, `easy` or `medium`: by how much the hard prototypes win over the easy ones."""
    margin = blended(F.col("tops"), hard, best_weight) - blended(F.col("tops"), easy, best_weight)
    return scored.withColumn(f"{name}_margin", margin).withColumn(
        name,
        F.when(margin >= F.lit(float(threshold)), F.lit("hard"))
        .when(margin <= F.lit(-float(threshold)), F.lit("easy"))
        .otherwise(F.lit("medium")),
    )


@dataclass(frozen=True)
class Rule:
    """Route to `model` if all (or any) of the conditions hold."""

    model: str
    priority: int
    conditions: Sequence[Column]
    any_of: bool = False

    def holds(self) -> Column:
        result = self.conditions[0]
        for condition in self.conditions[1:]:
            result = (result | condition) if self.any_of else (result & condition)
        return F.coalesce(result, F.lit(False))


def apply_rules(rules: Sequence[Rule], default: str) -> Column:
    """The model of the holding rule with the highest priority (the earlier of equals), else the default."""
    ordered = sorted(rules, key=lambda r: -r.priority)
    return F.coalesce(*[F.when(r.holds(), F.lit(r.model)) for r in ordered], F.lit(default))


# Subjects whose questions go to the large model.
ESCALATE = (
    "biology", "business", "computer science", "economics", "history", "math", "other",
    "philosophy", "psychology",
)
KEEP = ("chemistry", "engineering", "health", "law", "physics")


def group_margin(
    scored: DataFrame, positive: Sequence[str] = ESCALATE, negative: Sequence[str] = KEEP,
    threshold: float = 0.0, name: str = "escalate_vs_keep",
) -> DataFrame:
    """Best score of the positive labels minus best of the negative ones, and the side it falls on."""

    def best(signals: Sequence[str]) -> Column:
        return F.array_max(F.array(*[nearest(F.col("tops"), s) for s in signals]))

    margin = best(positive) - best(negative)
    return scored.withColumn(f"{name}_margin", margin).withColumn(
        name, F.when(margin > F.lit(float(threshold)), F.lit("escalate")).otherwise(F.lit("keep"))
    )


def category_action(category: Column, escalate: Sequence[str] = ESCALATE, keep: Sequence[str] = KEEP) -> Column:
    """`escalate` or `keep` for a listed subject, else missing."""
    return F.when(category.isin(*escalate), F.lit("escalate")).when(category.isin(*keep), F.lit("keep"))
