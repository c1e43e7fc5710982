"""Where tokens, errors and time go: concentration curves and tables by model, domain and template."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from answerflow.functions.numbers import to_number
from answerflow.functions.text import question_template
from answerflow.operators.ordering import ordered_totals
from answerflow.operators.replay import score_histogram
from answerflow.session import durable


def pareto_curve(
    df: DataFrame,
    tokens: str = "output_tokens",
    fraction: str = "slm_accuracy_fraction",
    key: str = "id",
    threshold: float = 0.75,
) -> DataFrame:
    """Rows by output tokens, largest first, with running token share and share of complex rows.

    Rows without a token count or fraction, or with a negative count, are left out; equal
    counts are ordered by key. Rows are sorted in range slices, not in one task.
    """
    clean = df.select(
        key, to_number(F.col(tokens)).alias("tokens"), to_number(F.col(fraction)).alias("_f")
    ).where("tokens >= 0 AND _f IS NOT NULL")
    clean = clean.select(key, "tokens", (F.col("_f") < threshold).cast("int").alias("complex"))
    clean = durable(clean)
    order = [F.col("tokens").desc(), F.col(key).asc()]
    curve = ordered_totals(
        clean, order, {"rank": F.lit(1), "cum_tokens": F.col("tokens"), "cum_complex": F.col("complex")}
    )
    total = clean.agg(F.sum("tokens")).scalar()
    n = clean.agg(F.count(F.lit(1))).scalar()
    return curve.select(
        key, "tokens", "complex", "rank", "cum_tokens",
        (F.col("cum_tokens") * 100.0 / F.nullif(total, F.lit(0.0))).alias("cum_tokens_pct"),
        (F.col("rank") * 100.0 / n).alias("row_pct"),
        (F.col("cum_complex") * 100.0 / F.col("rank")).alias("cum_complex_pct"),
        n.alias("n"),
    )


def top_share(curve: DataFrame, share: float = 0.2) -> DataFrame:
    """Token and complex share within the first `share` of the rows of a Pareto curve."""
    return curve.where(F.col("rank") == F.ceil(F.col("n") * F.lit(float(share)))).select(
        "n", F.col("rank").alias("rows"), "cum_tokens_pct", "cum_complex_pct"
    )


def accuracy_by_domain_and_model(
    outcomes: DataFrame, domains: Sequence[str], models: Sequence[str] | None = None
) -> DataFrame:
    """Accuracy in percent per model and domain, and over all rows as `total`; best total first."""
    if models is not None:
        outcomes = outcomes.where(F.col("model").isin(*models))
    flag = to_number(F.col("correct"))
    return (
        outcomes.groupBy("model")
        .agg(
            *[(F.avg(F.when(F.col("dataset_name") == d, flag)) * 100.0).alias(d) for d in domains],
            (F.avg(flag) * 100.0).alias("total"),
        )
        .orderBy(F.col("total").desc(), "model")
    )


def accuracy_vs_latency(outcomes: DataFrame) -> DataFrame:
    """Accuracy in percent and mean latency per model, most accurate first."""
    return (
        outcomes.groupBy("model")
        .agg(
            (F.avg(to_number(F.col("correct"))) * 100.0).alias("total_accuracy"),
            F.avg(to_number(F.col("latency"))).alias("avg_latency"),
        )
        .orderBy(F.col("total_accuracy").desc(), "model")
    )


def category_accuracy(outcomes: DataFrame, models: Sequence[str], value: str = "correct") -> DataFrame:
    """Mean accuracy per category with one column per model."""
    return outcomes.groupBy("category").agg(
        *[F.avg(F.when(F.col("model") == m, F.col(value))).alias(m) for m in models]
    )


def macro_accuracy(outcomes: DataFrame, value: str = "correct") -> DataFrame:
    """Per model, the mean over categories of the category means; best first."""
    means = outcomes.groupBy("model", "category").agg(F.avg(value).alias("_m"))
    return means.groupBy("model").agg(F.avg("_m").alias("macro_accuracy")).orderBy(
        F.col("macro_accuracy").desc(), "model"
    )


def vote_accuracy_by_model(fives: DataFrame, accuracy: str = "accuracy", threshold: float = 0.8) -> DataFrame:
    """Share of questions a model gets right in at least 80 % of its tries; best first."""
    simple = (~F.coalesce(F.col(accuracy) < threshold, F.lit(False))).cast("double")
    return fives.groupBy("model").agg(F.avg(simple).alias("accuracy")).orderBy(F.col("accuracy").desc(), "model")


def category_vote_accuracy(votes: DataFrame) -> DataFrame:
    """Mean vote accuracy per category and ensemble version."""
    return votes.groupBy("category", "version").agg(F.avg("vote_accuracy").alias("avg_vote_accuracy"))


TOKEN_COLUMNS = ("input_tokens", "output_tokens", "latency")


def token_latency_points(df: DataFrame, columns: Sequence[str] = TOKEN_COLUMNS) -> DataFrame:
    """Numeric token and latency triples without incomplete rows."""
    return df.select(*[to_number(F.col(c)).alias(name) for c, name in zip(columns, TOKEN_COLUMNS)]).dropna()


def token_latency_correlation(points: DataFrame) -> DataFrame:
    """Pearson correlation of each pair of the three measures."""
    pairs = [("input_tokens", "output_tokens"), ("input_tokens", "latency"), ("output_tokens", "latency")]
    return points.agg(F.count(F.lit(1)).alias("n"), *[F.corr(a, b).alias(f"{a}_{b}") for a, b in pairs])


def top_templates(questions: DataFrame, k: int = 10, fraction: str = "slm_accuracy_fraction") -> DataFrame:
    """The k most frequent question templates with their mean solve fraction, hardest first."""
    counted = questions.groupBy(question_template(F.col("question")).alias("template")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(fraction).alias("avg_fraction")
    )
    return counted.orderBy(F.col("n").desc(), "template").limit(k).orderBy("avg_fraction", "template")


def template_score_histogram(
    test: DataFrame, validation: DataFrame, top: DataFrame, bins: int = 20, score: str = "p"
) -> DataFrame:
    """Score histogram per split and top template."""
    clipped = F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0))

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            question_template(F.col("question")).alias("template"), clipped.alias("p"), F.lit(name).alias("split")
        )

    both = side(test, "test").unionByName(side(validation, "validation"))
    kept = both.join(top.select("template"), "template", "left_semi")
    return score_histogram(kept, bins, ["template", "split"])
