"""Joining per-model runs into one outcome table, and voting over it."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from answerflow.functions.numbers import to_flag
from answerflow.functions.text import strip_space

METRICS = ("correct", "latency", "input_tokens", "output_tokens")


def resolve_column(df: DataFrame, wanted: str) -> str:
    """The one column of `df` that is `wanted` but for case and what stands between its words."""
    def words(name: str) -> list[str]:
        return re.findall(r"[^\W_]+", name.casefold())

    same = [f.name for f in df.schema if words(f.name) == words(wanted)]
    if len(same) == 1:
        return same[0]
    what = f"more than one column is {wanted!r}: {same}" if same else f"no column is {wanted!r}; there are {df.columns}"
    raise ValueError(what)


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def normalize_and_prefix(
    df: DataFrame, prefix: str, keys: Sequence[str] = ("id", "problem"), renames: Mapping[str, str] | None = None
) -> DataFrame:
    """Rename the key columns, then prefix every other column."""
    renames = {"ID": "id", "Problem": "problem"} if renames is None else renames
    names = [renames.get(c, c) for c in df.columns]
    return df.select(
        *[
            F.col(f"`{old}`").alias(new if new in keys else f"{prefix}{new}")
            for old, new in zip(df.columns, names)
        ]
    )


def merge_runs(
    left: DataFrame, right: DataFrame, on: Sequence[str], metrics: Sequence[str], suffixes: tuple[str, str]
) -> DataFrame:
    """Inner join of two runs: shared columns from the left, metric columns of both with a suffix."""
    a = left.select(*[F.col(c).alias(c + suffixes[0] if c in metrics else c) for c in left.columns])
    b = right.select(*on, *[F.col(c).alias(c + suffixes[1]) for c in metrics])
    return a.join(b, list(on), "inner")


def merge_runs_prefixed(
    left: DataFrame, right: DataFrame, prefixes: tuple[str, str], keys: Sequence[str] = ("id", "problem")
) -> DataFrame:
    """Inner join on the keys after prefixing all other columns."""
    a = normalize_and_prefix(left, prefixes[0], keys)
    b = normalize_and_prefix(right, prefixes[1], keys)
    return a.join(b, list(keys), "inner")


def pair_outcomes(
    slm: DataFrame, llm: DataFrame, key: str = "ID", keep: Sequence[str] = (), within: Sequence[str] = ()
) -> DataFrame:
    """One row per question answered by both models, with `slm_` and `llm_` metric columns.

    Ids that are only unique within, say, a data set need those columns in `within`.
    """

    def side(df: DataFrame, prefix: str, extra: Sequence[str]) -> DataFrame:
        named = {m: resolve_column(df, m) for m in METRICS}
        return df.select(
            F.col(f"`{resolve_column(df, key)}`").alias("id"),
            *[F.col(f"`{c}`") for c in [*within, *extra]],
            to_flag(F.col(f"`{named['correct']}`")).cast("int").alias(f"{prefix}_correct"),
            *[F.col(f"`{named[m]}`").alias(f"{prefix}_{m}") for m in METRICS[1:]],
        )

    return side(slm, "slm", keep).join(side(llm, "llm", ()), ["id", *within], "inner")


def pairs_from_outcomes(outcomes: DataFrame, slm: str, llm: str) -> DataFrame:
    """The same pair view out of the long outcome table: one pass and one shuffle, no self-join."""
    cells = [
        F.max(F.when(F.col("model") == name, F.col(m))).alias(f"{side}_{m}")
        for side, name in (("slm", slm), ("llm", llm))
        for m in METRICS
    ]
    return (
        outcomes.where(F.col("model").isin(slm, llm))
        .groupBy("id", "dataset_name", "category")
        .agg(
            *cells,
            F.max((F.col("model") == slm).cast("int")).alias("_slm"),
            F.max((F.col("model") == llm).cast("int")).alias("_llm"),
        )
        .where("_slm = 1 AND _llm = 1")
        .drop("_slm", "_llm")
    )


def key_list(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def ensemble_accuracy(runs: DataFrame, n_models: int, key: str | Sequence[str] = "id") -> DataFrame:
    """Share of models that solved each question, for questions that all of them answered.

    A model has one vote per question however often it was run: it solved it if its best run did.
    """
    keys = key_list(key)
    votes = runs.groupBy(*keys, "model").agg(F.max("correct").alias("correct"))
    return (
        votes.groupBy(*keys)
        .agg(F.sum("correct").cast("bigint").alias("n_correct"), F.count("model").alias("_models"))
        .where(F.col("_models") == n_models)
        .select(*keys, "n_correct", (F.col("n_correct") / F.lit(float(n_models))).alias("slm_accuracy_fraction"))
    )


def build_outcomes_wide(outcomes: DataFrame, models: Sequence[str], slms: Sequence[str] = ()) -> DataFrame:
    """Long outcomes to one row per question with four columns per model.

    The models are passed in, so no job is needed to find them, and one aggregation does the
    pivot. `slms` name the models behind `slm_accuracy_fraction`.
    """
    cells = [
        F.max(F.when(F.col("model") == m, F.col(metric))).alias(
            f"{'is_correct' if metric == 'correct' else metric}_{m}"
        )
        for m in models
        for metric in METRICS
    ]
    fraction = []
    if slms:
        solved = F.sum(F.when(F.col("model").isin(*slms), F.col("correct")))
        answered = F.count_if(F.col("model").isin(*slms))
        fraction = [
            F.when(answered == len(slms), solved / F.lit(float(len(slms)))).alias("slm_accuracy_fraction")
        ]
    # Question ids are only unique within a data set; as keys, the two names also stay out of
    # the aggregation buffers, which keeps it a hash aggregation.
    return outcomes.groupBy("id", "dataset_name", "category").agg(*cells, *fraction)


def models_of(wide: DataFrame, prefix: str = "is_correct_") -> list[str]:
    """The models of a wide table, found by the prefix of their columns."""
    found = [c.removeprefix(prefix) for c in wide.columns if c.startswith(prefix)]
    if not found:
        raise ValueError(f"no columns start with {prefix!r}")
    return found


def unpivot_outcomes(wide: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """Wide outcomes back to one row per question and model that answered it."""
    models = models_of(wide) if models is None else models
    require_columns(wide, [f"{'is_correct' if m == 'correct' else m}_{name}" for name in models for m in METRICS])
    cells = F.array(
        *[
            F.struct(
                F.lit(m).alias("model"),
                *[
                    F.col(f"{'is_correct' if metric == 'correct' else metric}_{m}").alias(metric)
                    for metric in METRICS
                ],
            )
            for m in models
        ]
    )
    return (
        wide.select("id", "dataset_name", "category", F.explode(cells).alias("_m"))
        .select("id", "dataset_name", "category", "_m.*")
        .where(F.coalesce(*METRICS).isNotNull())
    )


def answers_match(mode: str = "upper") -> Column:
    """`model_answer` equals `correct_answer`, raw or after trimming and folding case; missing is wrong."""
    fold = {"raw": lambda c: c, "upper": lambda c: F.upper(strip_space(c)), "lower": lambda c: F.lower(strip_space(c))}
    if mode not in fold:
        raise ValueError(f"unknown mode {mode!r}")
    f = fold[mode]
    return F.coalesce(f(F.col("model_answer")) == f(F.col("correct_answer")), F.lit(False)).cast("int")


def _answering(models: Sequence[str]) -> Column:
    """How many of `models` have a row in the group."""
    return sum((F.coalesce(F.max((F.col("model") == m).cast("int")), F.lit(0)) for m in models), F.lit(0))


def vote_table(singles: DataFrame, models: Sequence[str], version: str, key: str | Sequence[str] = "id") -> DataFrame:
    """Per question: which models were right, how many, and whether at most 60 % were."""
    flags = [F.coalesce(F.max(F.when(F.col("model") == m, answers_match())), F.lit(0)).alias(f"{m}_correct") for m in models]
    votes = singles.where(F.col("model").isin(*models)).groupBy(*key_list(key)).agg(
        F.min("category").alias("category"), F.min("correct_answer").alias("correct_answer"),
        _answering(models).alias("_models"), *flags,
    ).where(F.col("_models") == len(models)).drop("_models")
    right = sum((F.col(f"{m}_correct") for m in models), F.lit(0))
    return (
        votes.withColumn("correct_models", right.cast("bigint"))
        .withColumn("vote_accuracy", F.col("correct_models") / F.lit(float(len(models))))
        .withColumn("complex", (F.col("correct_models") <= len(models) * 3 // 5).cast("int"))
        .withColumn("version", F.lit(version))
    )


def five_vote_ensemble(
    fives: DataFrame, models: Sequence[str], version: str, key: str | Sequence[str] = "id", accuracy: str = "accuracy"
) -> DataFrame:
    """A model votes simple from 80 % accuracy on; a question is simple if all but one model say so.

    A model with several rows for a question votes once, by the lowest; a missing accuracy
    does not count against it.
    """
    keys = key_list(key)
    own = fives.where(F.col("model").isin(*models)).groupBy(*keys, "model").agg(F.min(accuracy).alias("_lowest"))
    simple = F.count_if(F.coalesce(F.col("_lowest") >= 0.8, F.lit(True)))
    return (
        own.groupBy(*keys)
        .agg(simple.alias("votes_simple"), F.count("model").alias("_models"))
        .where(F.col("_models") == len(models))
        .select(
            *keys,
            "votes_simple",
            (F.lit(len(models)) - F.col("votes_simple")).alias("votes_complex"),
            (F.col("votes_simple") < len(models) - 1).cast("int").alias("complex"),
            F.lit(version).alias("ensemble_version"),
        )
    )


def first_answers(singles: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per model and question, in the given order.

    Later rows are dropped before the shuffle (the planner limits each group to its first
    rank on both sides of it), so a question logged very often is no hot spot.
    """
    rank = F.row_number().over(W.partitionBy("model", *key_list(key)).orderBy(*order))
    return singles.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def consensus_dataset(
    singles: DataFrame, n_models: int, order: Sequence[str], key: str | Sequence[str] = "QID", threshold: float = 0.8
) -> DataFrame:
    """Questions answered by all models, with the share that was right and the complex label.

    Of several rows of a model for a question the first in the given order counts.
    """
    keys = key_list(key)
    rows = first_answers(singles, keys, order)
    facts = [c for c in ("question", "category", "correct_answer") if c in singles.columns and c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(
            *[F.min(c).alias(c) for c in facts],
            F.count("model").alias("_models"),
            F.avg(answers_match("lower")).alias("accuracy_fraction"),
        )
        .where(F.col("_models") == n_models)
        .drop("_models")
        .withColumn("complex", (F.col("accuracy_fraction") < threshold).cast("int"))
    )
