"""Live prompts and feedback: stateless jobs that also run as batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from answerflow.functions.costs import (
    CENTS,
    CostModel,
    PROFILES,
    choose_model,
    route_by_score,
    route_by_utility,
    settings_with_overrides,
    token_cost,
)
from answerflow.functions.text import joined_lines, strip_space


def route_prompts(
    prompts: DataFrame,
    model: CostModel | None = None,
    use_utility: bool = True,
    requested: str | None = None,
    settings: str | None = None,
) -> DataFrame:
    """Add `route` (`slm` or `llm`) to prompts scored with `p`.

    `settings` names a map column with per-prompt overrides of the cost model, `requested` a
    column with an explicit choice.
    """
    model = model or PROFILES["live"]
    if settings:
        model = settings_with_overrides(F.col(settings), model)
    routed = (
        route_by_utility(F.col("p"), model)
        if use_utility
        else route_by_score(F.col("p"), model.score_threshold, inclusive=True)
    )
    return prompts.withColumn("route", choose_model(F.col(requested), routed) if requested else routed)


def answer_cents(route: Column, input_tokens: Column, output_tokens: Column) -> Column:
    """Cents for an answer; the small model is free."""
    return F.when(F.lower(route) == "llm", token_cost(input_tokens, output_tokens) * CENTS).otherwise(F.lit(0.0))


def _size(model: Column) -> Column:
    return F.when(model == "LLM", F.lit("large")).otherwise(F.lit("small"))


def feedback_rows(events: DataFrame) -> DataFrame:
    """Feedback events to log rows; only `up` is good."""
    return events.select(
        strip_space(F.col("response_id").cast("string")).alias("response_id"),
        joined_lines(strip_space(F.col("question"))).alias("question"),
        joined_lines(strip_space(F.col("answer"))).alias("answer"),
        "latency",
        "input_tokens",
        "output_tokens",
        _size(strip_space(F.col("model"))).alias("model"),
        F.coalesce(strip_space(F.col("kind")) == "up", F.lit(False)).alias("is_good"),
    )


def cascade_rows(events: DataFrame) -> DataFrame:
    """Cascade events to log rows: satisfied logs the small answer as good; escalate logs it as
    bad and the large answer as good.

    Needs `kind`, `question` and `slm_`/`llm_` response_id, answer, latency, input_tokens and
    output_tokens. A blank id is replaced by one made from the event's whole content and the side,
    so a batch that is repeated logs the same ids; events alike in every column share theirs.
    """
    content = F.to_json(F.struct(*[F.col(f"`{c}`") for c in events.columns]))

    def made(side: str) -> Column:
        digits = F.substring(F.sha2(F.concat(F.lit(f"{side} "), content), 256), 1, 32)
        return F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")

    def row(side: str, good: bool) -> Column:
        given = F.nullif(strip_space(F.col(f"{side}_response_id").cast("string")), F.lit(""))
        return F.struct(
            F.coalesce(given, made(side)).alias("response_id"),
            joined_lines(strip_space(F.col("question"))).alias("question"),
            joined_lines(strip_space(F.col(f"{side}_answer"))).alias("answer"),
            F.col(f"{side}_latency").alias("latency"),
            F.col(f"{side}_input_tokens").alias("input_tokens"),
            F.col(f"{side}_output_tokens").alias("output_tokens"),
            _size(F.lit(side.upper())).alias("model"),
            F.lit(good).alias("is_good"),
        )

    rows = F.when(F.col("kind") == "satisfied", F.array(row("slm", True))).when(
        F.col("kind") == "escalate", F.array(row("slm", False), row("llm", True))
    )
    return events.where(F.col("kind").isin("satisfied", "escalate")).select(F.explode(rows).alias("_r")).select("_r.*")


def feedback_windows(events: DataFrame, size: str = "1 day", slide: str | None = None) -> DataFrame:
    """Answers, share of good ones, mean latency and cents per time window and model.

    In a stream, set the watermark on `ts` first.
    """
    span = F.window("ts", size, slide) if slide else F.window("ts", size)
    cents = answer_cents(F.col("model"), F.col("input_tokens"), F.col("output_tokens"))
    return (
        events.groupBy(span.alias("w"), "model")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg((F.col("kind") == "up").cast("double")).alias("good_rate"),
            F.avg("latency").alias("avg_latency"),
            F.sum(cents).alias("cents"),
        )
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "model", "n", "good_rate", "avg_latency", "cents")
    )
