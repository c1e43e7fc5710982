"""Cost model and routing decisions: pure Column functions shared by batch and streams."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, functions as F

from answerflow.functions.text import has_indexed_variable, is_plain_language, strip_space

SLM, LLM = "slm", "llm"

# USD per token in and out, and USD to cents.
PRICE_IN = 1.25 / 1e6
PRICE_OUT = 10.0 / 1e6
CENTS = 100.0


def _col(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


@dataclass(frozen=True)
class CostModel:
    """Solve rates, mean resource use and prices behind a routing decision.

    Every number may also be a Column, so that one plan can carry many models (one per
    profile, domain or settings row).
    """

    q_slm_simple: Column | float = 0.76
    q_slm_complex: Column | float = 0.39
    q_llm_simple: Column | float = 0.93
    q_llm_complex: Column | float = 0.83
    slm_latency: Column | float = 3.10
    llm_latency: Column | float = 23.81
    llm_input_tokens: Column | float = 154.0
    llm_output_tokens: Column | float = 1897.18
    latency_weight: Column | float = 0.11
    error_weight: Column | float = 15.0
    score_threshold: Column | float = 0.5

    def with_(self, **changes: Column | float) -> CostModel:
        return replace(self, **changes)


# The calibrated profiles.
PROFILES = {
    "classifier": CostModel(
        0.76, 0.39, 0.93, 0.83, 3.1007189569935947, 23.806206206190154,
        154.00091508052708, 1897.1786237188874, 0.13, 13.0, 0.5,
    ),
    "classifier_no_smiles": CostModel(
        0.77, 0.49, 0.93, 0.90, 2.997632443039878, 11.746656273613679,
        119.61035724176128, 1090.7227914705068, 0.12, 7.0, 0.5,
    ),
    "regressor": CostModel(
        0.73, 0.36, 0.93, 0.81, 3.1007, 23.8062, 154.0009, 1897.1786, 0.11, 14.0, 0.6
    ),
    "regressor_no_smiles": CostModel(
        0.75, 0.45, 0.93, 0.89, 2.9976, 11.7467, 119.6104, 1090.7228, 0.15, 7.0, 0.6
    ),
    "live": CostModel(),
}

# Names of the settings a caller may override, by cost-model field.
SETTING_NAMES = {
    "latency_weight": "LAMBDA_LATENCY",
    "error_weight": "C_ERR",
    "q_slm_simple": "MANUAL_Q_S_SIMPLE",
    "q_slm_complex": "MANUAL_Q_S_COMPLEX",
    "q_llm_simple": "MANUAL_Q_L_SIMPLE",
    "q_llm_complex": "MANUAL_Q_L_COMPLEX",
    "slm_latency": "SLM_AVG_LATENCY",
    "llm_latency": "LLM_AVG_LATENCY",
    "llm_input_tokens": "LLM_AVG_INPUT_TOKENS",
    "llm_output_tokens": "LLM_AVG_OUTPUT_TOKENS",
}
# Other spellings that are also understood.
SETTING_ALIASES = {"LLM_AVG_INPUT_TOKENS": "LLM_AVG_IMPUT_TOKENS"}


def token_cost(input_tokens: Column | float, output_tokens: Column | float) -> Column:
    """USD for one LLM answer."""
    return _col(input_tokens) * F.lit(PRICE_IN) + _col(output_tokens) * F.lit(PRICE_OUT)


def error_cost(usd: Column | float, latency: Column | float, quality: Column | float, model: CostModel) -> Column:
    """Cents for money, plus weighted waiting time, plus the weighted chance of a wrong answer."""
    return (
        _col(usd) * F.lit(CENTS)
        + _col(model.latency_weight) * _col(latency)
        + _col(model.error_weight) * (F.lit(1.0) - _col(quality))
    )


def expected_quality(p: Column, simple: Column | float, complex_: Column | float) -> Column:
    """Chance of a right answer for a question that is complex with probability p."""
    return (F.lit(1.0) - p) * _col(simple) + p * _col(complex_)


def slm_quality(p: Column, model: CostModel) -> Column:
    return expected_quality(p, model.q_slm_simple, model.q_slm_complex)


def llm_quality(p: Column, model: CostModel) -> Column:
    return expected_quality(p, model.q_llm_simple, model.q_llm_complex)


def expected_slm_error(p: Column, model: CostModel, latency: Column | None = None) -> Column:
    latency = _col(model.slm_latency) if latency is None else latency
    return error_cost(0.0, latency, slm_quality(p, model), model)


def expected_llm_error(
    p: Column, model: CostModel, latency: Column | None = None, usd: Column | None = None
) -> Column:
    latency = _col(model.llm_latency) if latency is None else latency
    if usd is None:
        usd = token_cost(model.llm_input_tokens, model.llm_output_tokens)
    return error_cost(usd, latency, llm_quality(p, model), model)


def route_by_utility(
    p: Column,
    model: CostModel,
    *,
    p_llm: Column | None = None,
    slm_latency: Column | None = None,
    llm_latency: Column | None = None,
    llm_usd: Column | None = None,
) -> Column:
    """LLM only if its expected error cost is strictly lower.

    Means of the cost model are used unless per-row latency and cost are given. `p_llm` is
    the LLM's own view of the difficulty, if it differs.
    """
    small = expected_slm_error(p, model, slm_latency)
    big = expected_llm_error(p if p_llm is None else p_llm, model, llm_latency, llm_usd)
    return F.when(big < small, F.lit(LLM)).otherwise(F.lit(SLM))


def break_even(model: CostModel) -> Column:
    """The probability at which both models cost the same; missing if the lines are parallel."""
    extra = token_cost(model.llm_input_tokens, model.llm_output_tokens) * F.lit(CENTS) + _col(
        model.latency_weight
    ) * (_col(model.llm_latency) - _col(model.slm_latency))
    gain_simple = _col(model.q_llm_simple) - _col(model.q_slm_simple)
    gain_complex = _col(model.q_llm_complex) - _col(model.q_slm_complex)
    # NULL instead of a division by zero.
    weight = F.nullif(_col(model.error_weight), F.lit(0.0))
    return (extra / weight - gain_simple) / F.nullif(gain_complex - gain_simple, F.lit(0.0))


def route_by_score(score: Column, threshold: Column | float = 0.5, inclusive: bool = False) -> Column:
    """LLM if the score is above the threshold (or at it, if `inclusive`)."""
    over = score >= _col(threshold) if inclusive else score > _col(threshold)
    return F.when(over, F.lit(LLM)).otherwise(F.lit(SLM))


def _shift_logit(p: Column, by: float) -> Column:
    logit = F.log((p + F.lit(1e-8)) / (F.lit(1.0) - p + F.lit(1e-8))) + F.lit(by)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def adjust_by_text_features(p: Column, question: Column, input_tokens: Column) -> tuple[Column, Column]:
    """The difficulty as the SLM and as the LLM see it, given surface features of the question."""
    # The shifts, and the length of a short question.
    for_llm = F.when(has_indexed_variable(question), _shift_logit(p, -1.2)).otherwise(p)
    for_slm = (
        F.when(is_plain_language(question), _shift_logit(p, 0.5))
        .when(input_tokens < 12, _shift_logit(p, 0.6))
        .otherwise(p)
    )
    return for_slm, for_llm


def override_high_cost(high_cost: Column, decision: Column) -> Column:
    """Questions predicted to be expensive stay with the SLM."""
    return F.when(F.coalesce(high_cost.cast("int") == 1, F.lit(False)), F.lit(SLM)).otherwise(decision)


def settings_with_overrides(overrides: Column, base: CostModel | None = None) -> CostModel:
    """Cost model with per-row overrides from a map of text; unreadable values are ignored."""
    base = base or PROFILES["live"]
    changes = {}
    for field, name in SETTING_NAMES.items():
        names = [name] + [alias for key, alias in SETTING_ALIASES.items() if key == name]
        given = [F.try_element_at(overrides, F.lit(n)).try_cast("double") for n in names]
        changes[field] = F.coalesce(*given, _col(getattr(base, field)))
    return base.with_(**changes)


def choose_model(requested: Column, routed: Column) -> Column:
    """An explicit SLM or LLM request wins; anything else is routed."""
    asked = F.upper(strip_space(requested))
    return F.lower(F.coalesce(F.when(asked.isin("SLM", "LLM"), asked), routed))
