"""Reading the route out of a router reply."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from answerflow.functions.text import strip_space

# Where a reply may name its route, in order, and which words mean which model.
ROUTE_PATHS = (
    "$.route",
    "$.routing.selected_model",
    "$.routing.model",
    "$.metadata.route",
    "$.metadata.selected_model",
    "$.model",
)
SMALL_WORDS = ("small", "slm", "qwen", "7b")
BIG_WORDS = ("big", "llm", "gpt", "large")


def extract_route(reply: Column) -> Column:
    """The route at the first place that a JSON reply has; missing if there is none, or if that
    place holds an explicit null."""
    route = F.lit(None).cast("string")
    parsed = F.try_parse_json(reply)
    for path in reversed(ROUTE_PATHS):
        there = F.try_variant_get(parsed, path, "variant")
        route = F.when(there.isNotNull(), F.get_json_object(reply, path)).otherwise(route)
    return route


def route_bucket(route: Column, strict: bool = False) -> Column:
    """`slm`, `llm`, or `default`. With `strict`, a reply that names neither fails the job."""
    text = F.lower(strip_space(route))
    bucket = F.when(text.rlike("|".join(SMALL_WORDS)), F.lit("slm")).when(
        text.rlike("|".join(BIG_WORDS)), F.lit("llm")
    )
    if not strict:
        return bucket.otherwise(F.lit("default"))
    message = F.concat(F.lit("unexpected route: "), F.coalesce(route, F.lit("none")))
    return bucket.otherwise(F.raise_error(message).cast("string"))
