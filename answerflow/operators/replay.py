"""Calibrating the cost model on a pair log and replaying routing policies over it.

A pair log has one row per question with `slm_` and `llm_` correct, latency and token columns
and the predicted difficulty `p`. Every report is one aggregation with map-side partial sums,
so a data set that holds most rows is no hot spot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from answerflow.functions.costs import (
    CENTS,
    LLM,
    SLM,
    CostModel,
    break_even,
    error_cost,
    expected_llm_error,
    expected_slm_error,
    llm_quality,
    override_high_cost,
    route_by_score,
    route_by_utility,
    slm_quality,
    token_cost,
)

POLICIES = ("router", "oracle", "oracle_cost", "all_slm", "all_llm")


def with_actual_costs(pairs: DataFrame, model: CostModel) -> DataFrame:
    """Add what each model really cost per question: `llm_usd`, `slm_error`, `llm_error`."""
    usd = token_cost(F.col("llm_input_tokens"), F.col("llm_output_tokens"))
    return pairs.withColumns(
        {
            "llm_usd": usd,
            "slm_error": error_cost(0.0, F.col("slm_latency"), F.col("slm_correct"), model),
            "llm_error": error_cost(usd, F.col("llm_latency"), F.col("llm_correct"), model),
        }
    )


def decisions(model: CostModel, router: Column | None = None) -> dict[str, Column]:
    """Decision column per policy; the router thresholds `p` unless another rule is given."""
    return {
        "router": route_by_score(F.col("p"), model.score_threshold) if router is None else router,
        "oracle": F.when(F.col("slm_correct") == 1, F.lit(SLM)).otherwise(F.lit(LLM)),
        "oracle_cost": F.when(F.col("slm_error") <= F.col("llm_error"), F.lit(SLM)).otherwise(F.lit(LLM)),
        "all_slm": F.lit(SLM),
        "all_llm": F.lit(LLM),
    }


def replay_policies(
    pairs: DataFrame, model: CostModel, by: Sequence[str] = ("dataset_name",), router: Column | None = None
) -> DataFrame:
    """Per group and policy: LLM share, accuracy, mean latency, mean cents and mean error cost.

    All policies are summed side by side in one pass; only the few result rows are unfolded.
    """
    costed = with_actual_costs(pairs, model)
    chosen = decisions(model, router)
    costed = costed.withColumns({f"_llm_{p}": c == LLM for p, c in chosen.items()})
    sums = [F.count(F.lit(1)).alias("n")]
    for policy in POLICIES:
        big = F.col(f"_llm_{policy}")

        def pick(llm: Column, slm: Column) -> Column:
            return F.when(big, llm).otherwise(slm)

        sums += [
            F.count_if(big).alias(f"{policy}_n"),
            F.avg(pick(F.col("llm_correct"), F.col("slm_correct"))).alias(f"{policy}_acc"),
            F.avg(pick(F.col("llm_latency"), F.col("slm_latency"))).alias(f"{policy}_lat"),
            F.avg(pick(F.col("llm_usd"), F.lit(0.0))).alias(f"{policy}_usd"),
            F.avg(pick(F.col("llm_error"), F.col("slm_error"))).alias(f"{policy}_err"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(policy).alias("policy"),
                F.col("n").alias("n"),
                F.col(f"{policy}_n").alias("n_llm"),
                (F.col(f"{policy}_n") * 100.0 / F.col("n")).alias("llm_pct"),
                F.col(f"{policy}_acc").alias("accuracy"),
                F.col(f"{policy}_lat").alias("avg_latency"),
                (F.col(f"{policy}_usd") * CENTS).alias("avg_cents"),
                F.col(f"{policy}_err").alias("avg_error"),
            )
            for policy in POLICIES
        ]
    )
    return costed.groupBy(*by).agg(*sums).select(*by, F.explode(rows).alias("_p")).select(*by, "_p.*")


def routing_confusion(
    pairs: DataFrame, model: CostModel, by: Sequence[str] = ("dataset_name",), router: Column | None = None
) -> DataFrame:
    """Router against the right route (SLM if it is right), with what wrong routes wasted."""
    big = (route_by_score(F.col("p"), model.score_threshold) if router is None else router) == LLM
    should_slm = F.col("slm_correct") == 1
    wasted = should_slm & big
    usd = token_cost(F.col("llm_input_tokens"), F.col("llm_output_tokens"))
    return pairs.groupBy(*by).agg(
        F.count_if(should_slm & ~big).alias("slm_slm"),
        F.count_if(wasted).alias("slm_llm"),
        F.count_if(~should_slm & ~big).alias("llm_slm"),
        F.count_if(~should_slm & big).alias("llm_llm"),
        F.count_if(~should_slm & ~big).alias("missed_escalations"),
        F.count_if(wasted).alias("failed_escalations"),
        F.coalesce(F.sum(F.when(wasted, usd)) * CENTS, F.lit(0.0)).alias("wasted_cents"),
        F.coalesce(
            F.sum(F.when(wasted, F.col("llm_latency") - F.col("slm_latency"))), F.lit(0.0)
        ).alias("wasted_seconds"),
    )


def calibrate(pairs: DataFrame, predicted: Column, actual: Column, by: Sequence[str] = ()) -> DataFrame:
    """Solve rates per predicted class (0 for an empty class), label counts and overall means.

    `predicted` and `actual` are 1 for complex and 0 for simple.
    """
    hard, easy = predicted == 1, predicted == 0
    true_hard, true_easy = actual == 1, actual == 0

    def rate(flag: str, mask: Column) -> Column:
        return F.coalesce(F.avg(F.when(mask, F.col(flag))), F.lit(0.0))

    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(easy).alias("n_simple"),
        F.count_if(hard).alias("n_complex"),
        rate("slm_correct", easy).alias("q_slm_simple"),
        rate("slm_correct", hard).alias("q_slm_complex"),
        rate("llm_correct", easy).alias("q_llm_simple"),
        rate("llm_correct", hard).alias("q_llm_complex"),
        *[
            F.avg(f"{side}_{metric}").alias(f"{side}_{metric}")
            for side in (SLM, LLM)
            for metric in ("latency", "input_tokens", "output_tokens")
        ],
        F.count_if(true_easy & easy).alias("simple_as_simple"),
        F.count_if(true_easy & hard).alias("simple_as_complex"),
        F.count_if(true_hard & easy).alias("complex_as_simple"),
        F.count_if(true_hard & hard).alias("complex_as_complex"),
    )


def calibrated(base: CostModel) -> CostModel:
    """`base` with its rates and means taken from the columns of a calibration row."""
    return base.with_(
        **{
            name: F.col(name)
            for name in (
                "q_slm_simple", "q_slm_complex", "q_llm_simple", "q_llm_complex",
                "slm_latency", "llm_latency", "llm_input_tokens", "llm_output_tokens",
            )
        }
    )


def conditional_means(pairs: DataFrame, predicted: Column, by: Sequence[str] = ()) -> DataFrame:
    """Rows and mean resource use where a model solved questions of one predicted class."""
    masks = {
        "slm_complex": (SLM, (predicted == 1) & (F.col("slm_correct") == 1)),
        "slm_simple": (SLM, (predicted == 0) & (F.col("slm_correct") == 1)),
        "llm_complex": (LLM, (predicted == 1) & (F.col("llm_correct") == 1)),
        "llm_simple": (LLM, (predicted == 0) & (F.col("llm_correct") == 1)),
    }
    metrics = ("latency", "input_tokens", "output_tokens")
    sums = []
    for name, (side, mask) in masks.items():
        sums.append(F.count_if(mask).alias(f"{name}_n"))
        sums += [F.avg(F.when(mask, F.col(f"{side}_{m}"))).alias(f"{name}_{m}") for m in metrics]
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("scenario"),
                F.col(f"{name}_n").alias("n"),
                *[F.col(f"{name}_{m}").alias(f"avg_{m}") for m in metrics],
            )
            for name in masks
        ]
    )
    return pairs.groupBy(*by).agg(*sums).select(*by, F.explode(rows).alias("_s")).select(*by, "_s.*")


def average_quality_columns() -> list[Column]:
    total = F.nullif(F.col("n_simple") + F.col("n_complex"), F.lit(0))
    return [
        F.coalesce(
            (F.col("n_complex") * F.col(f"q_{s}_complex") + F.col("n_simple") * F.col(f"q_{s}_simple")) / total,
            F.lit(0.0),
        ).alias(f"avg_q_{s}")
        for s in (SLM, LLM)
    ]


def average_quality(calibration: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Solve rates of both models weighted by the size of the predicted classes."""
    return calibration.select(*by, *average_quality_columns())


def policy_detail(
    pairs: DataFrame, model: CostModel, policy: str = "utility", high_cost: Column | None = None
) -> DataFrame:
    """One row per question: decision, outcome, actual and predicted cost.

    `utility` weighs expected costs, `high_cost` does so after sending predicted expensive
    questions to the SLM, `oracle` and `oracle_cost` know the outcome.
    """
    costed = with_actual_costs(pairs, model)
    routed = route_by_utility(F.col("p"), model)
    known = decisions(model)
    rules = {
        "utility": routed,
        "high_cost": override_high_cost(F.lit(0) if high_cost is None else high_cost, routed),
        "oracle": known["oracle"],
        "oracle_cost": known["oracle_cost"],
    }
    if policy not in rules:
        raise ValueError(f"unknown policy {policy!r}")
    traced = costed.withColumn("decision", rules[policy])
    big = F.col("decision") == LLM

    def pick(llm: Column, slm: Column) -> Column:
        return F.when(big, llm).otherwise(slm)

    mean_usd = token_cost(model.llm_input_tokens, model.llm_output_tokens)

    def lit(value: Column | float) -> Column:
        return value if isinstance(value, Column) else F.lit(float(value))

    return traced.select(
        "id",
        *[c for c in ("dataset_name",) if c in pairs.columns],
        "p",
        "decision",
        pick(F.col("llm_correct"), F.col("slm_correct")).alias("correct"),
        pick(F.col("llm_latency"), F.col("slm_latency")).alias("latency"),
        pick(F.col("llm_input_tokens"), F.col("slm_input_tokens")).alias("input_tokens"),
        pick(F.col("llm_output_tokens"), F.col("slm_output_tokens")).alias("output_tokens"),
        pick(F.col("llm_usd"), F.lit(0.0)).alias("actual_usd"),
        pick(mean_usd, F.lit(0.0)).alias("predicted_usd"),
        pick(lit(model.llm_latency), lit(model.slm_latency)).alias("predicted_latency"),
        pick(F.col("llm_error"), F.col("slm_error")).alias("error"),
        pick(llm_quality(F.col("p"), model), slm_quality(F.col("p"), model)).alias("quality"),
    )


def by_decision_summary(trace: DataFrame) -> DataFrame:
    """Rows, share and means per decision plus a total row (`decision` = `all`)."""
    return (
        trace.rollup("decision")
        .agg(
            F.grouping("decision").alias("_all"),
            F.count(F.lit(1)).alias("n"),
            F.avg("correct").alias("accuracy"),
            F.avg("latency").alias("avg_latency"),
            (F.avg("actual_usd") * CENTS).alias("avg_cents"),
            F.avg("input_tokens").alias("avg_input_tokens"),
            F.avg("output_tokens").alias("avg_output_tokens"),
            F.avg("error").alias("avg_error"),
        )
        .withColumn("decision", F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col("decision")))
        # Three rows at most: the total is the largest of them.
        .withColumn("share", F.col("n") / F.max("n").over(W.partitionBy(F.lit(0))))
        .drop("_all")
    )


def baseline_errors(pairs: DataFrame, model: CostModel, by: Sequence[str] = ()) -> DataFrame:
    """Mean actual error cost of always using one model; rows without a value are skipped."""
    return (
        with_actual_costs(pairs, model)
        .groupBy(*by)
        .agg(F.avg("slm_error").alias("all_slm_error"), F.avg("llm_error").alias("all_llm_error"))
    )


def subset_counterfactual(pairs: DataFrame, decision: Column, by: Sequence[str] = ()) -> DataFrame:
    """LLM latency and cost on the rows sent to it, SLM latency on the rows sent to that."""
    big = decision == LLM
    return (
        pairs.groupBy(*by)
        .agg(
            F.avg(F.when(big, F.col("llm_latency"))).alias("llm_latency_on_llm"),
            F.avg(F.when(~big, F.col("slm_latency"))).alias("slm_latency_on_slm"),
            F.avg(F.when(big, F.col("llm_input_tokens"))).alias("_in"),
            F.avg(F.when(big, F.col("llm_output_tokens"))).alias("_out"),
        )
        .select(
            *by, "llm_latency_on_llm", "slm_latency_on_slm",
            (token_cost(F.col("_in"), F.col("_out")) * CENTS).alias("llm_cents_on_llm"),
        )
    )


def predicted_error(trace: DataFrame, calibration: DataFrame, model: CostModel) -> DataFrame:
    """Error cost of the mean predictions: of the router (from its trace) and of each model alone."""
    means = calibration.select("*", *average_quality_columns())
    alone = calibrated(model)
    usd = token_cost(F.col("llm_input_tokens"), F.col("llm_output_tokens"))
    both = means.select(
        F.struct(
            error_cost(0.0, F.col("slm_latency"), F.col("avg_q_slm"), alone).alias("slm"),
            error_cost(usd, F.col("llm_latency"), F.col("avg_q_llm"), alone).alias("llm"),
        )
    ).scalar()
    router = trace.agg(
        error_cost(F.avg("predicted_usd"), F.avg("predicted_latency"), F.avg("quality"), model).alias("router_error")
    )
    return router.select("router_error", both["slm"].alias("slm_error"), both["llm"].alias("llm_error"))


def cost_curve(models: DataFrame, model: CostModel, points: int = 1001, by: Sequence[str] = ()) -> DataFrame:
    """Expected cost of both models over p in [0, 1] for every row of cost-model columns."""
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    on_grid = models.withColumn("step", grid).withColumn("p", F.col("step") / F.lit(float(points - 1)))
    return on_grid.select(
        *by, "step", "p",
        expected_slm_error(F.col("p"), model).alias("slm_error"),
        expected_llm_error(F.col("p"), model).alias("llm_error"),
    )


def curve_crossing(models: DataFrame, model: CostModel, by: Sequence[str], points: int = 1001) -> DataFrame:
    """Where the curves meet: on the grid, in closed form, the one to use, and the cost there."""
    last = F.lit(float(points - 1))

    def gap(step: Column) -> Column:
        p = step / last
        # Equal gaps go to the lower step; rounding keeps them equal.
        far = F.round(F.abs(expected_llm_error(p, model) - expected_slm_error(p, model)), 9)
        return F.struct(far.alias("gap"), step.alias("step"))

    nearest = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), gap))["step"]
    placed = models.withColumns({"grid_p": nearest / last, "p_star": break_even(model)})
    used = F.when(F.col("p_star").between(0, 1), F.col("p_star")).otherwise(F.col("grid_p"))
    # The curve is a line, so interpolating on the grid is interpolating between its ends.
    at0, at1 = expected_llm_error(F.lit(0.0), model), expected_llm_error(F.lit(1.0), model)
    return placed.select(
        *by, "grid_p", "p_star", used.alias("p_used"),
        (at0 + (at1 - at0) * used).alias("cost_at_p"),
        F.least(F.greatest(F.coalesce("p_star", used), F.lit(0.0)), F.lit(1.0)).alias("p_clipped"),
    )


def actual_cost_fit(
    pairs: DataFrame, model: CostModel, decision: Column | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Straight line through (p, actual error) per model.

    With `decision`, each model is fitted on the rows sent to it; without, both on all rows.
    Fewer than two rows give no line.
    """
    costed = with_actual_costs(pairs, model)
    finite = [F.col("p"), F.col("slm_error"), F.col("llm_error")]
    usable = F.lit(True)
    for value in finite:
        usable = usable & value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    if decision is None:
        masks = {SLM: usable, LLM: usable}
    else:
        masks = {
            side: (decision == side) & F.col(f"{side}_error").isNotNull() & F.col("p").isNotNull()
            for side in (SLM, LLM)
        }
    p = F.least(F.greatest(F.col("p"), F.lit(0.0)), F.lit(1.0))
    sums = []
    for side, mask in masks.items():
        x, y = F.when(mask, p), F.when(mask, F.col(f"{side}_error"))
        sums += [
            F.count(x).alias(f"{side}_n"), F.regr_slope(y, x).alias(f"{side}_slope"),
            F.regr_intercept(y, x).alias(f"{side}_at0"), F.corr(x, y).alias(f"{side}_r"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(side).alias("model"), F.col(f"{side}_n").alias("n"),
                *[
                    F.when(F.col(f"{side}_n") >= 2, F.col(f"{side}_{name}")).alias(alias)
                    for name, alias in (("slope", "slope"), ("at0", "intercept"), ("r", "r"))
                ],
            )
            for side in masks
        ]
    )
    return costed.groupBy(*by).agg(*sums).select(*by, F.explode(rows).alias("_m")).select(*by, "_m.*")


def plotted_points(pairs: DataFrame, model: CostModel, p_star: Column | float) -> DataFrame:
    """The actual cost points shown next to the curves: SLM rows up to p*, LLM rows from p* on."""
    star = p_star if isinstance(p_star, Column) else F.lit(float(p_star))
    p = F.least(F.greatest(F.col("p"), F.lit(0.0)), F.lit(1.0))
    traced = (
        with_actual_costs(pairs, model)
        .withColumn("p", p)
        .withColumn("decision", route_by_utility(F.col("p"), model))
        .withColumn("error", F.when(F.col("decision") == LLM, F.col("llm_error")).otherwise(F.col("slm_error")))
    )
    shown = ((F.col("decision") == SLM) & (F.col("p") <= star)) | ((F.col("decision") == LLM) & (F.col("p") >= star))
    return traced.where(F.col("error").isNotNull() & shown).select("id", "dataset_name", "p", "decision", "error")


def score_histogram(
    df: DataFrame, bins: int = 20, by: Sequence[str] = (), score: str = "p", right_closed: bool = False
) -> DataFrame:
    """Rows per equal-width bin of [0, 1], empty bins included.

    Left-closed bins (the last one closed on both sides) drop scores outside [0, 1];
    right-closed ones (the first closed on both sides) clip them first.
    """
    value = F.col(score)
    if right_closed:
        value = F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))
        place = F.greatest(F.ceil(value * bins) - 1, F.lit(0))
    else:
        place = F.least(F.floor(value * bins), F.lit(bins - 1))
    counted = (
        df.where(value.between(0, 1))
        .groupBy(*by, place.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Fill the gaps: fold each group to a map of its few bins, then unfold all bins.
    folded = counted.groupBy(*by).agg(F.map_from_entries(F.array_agg(F.struct("bin", "n"))).alias("_m"))
    return folded.select(
        *by, "_m", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    ).select(
        *by, "bin", (F.col("bin") / F.lit(float(bins))).alias("left_edge"),
        F.coalesce(F.try_element_at("_m", F.col("bin")), F.lit(0)).cast("bigint").alias("n"),
    )


def slm_routing_accuracy(df: DataFrame, threshold: float = 0.55, score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Sent to the SLM (score strictly below the threshold) against whether it was right."""
    sent, right = F.col(score) < F.lit(float(threshold)), F.col("slm_correct") == 1
    return df.groupBy(*by).agg(
        F.count_if(sent & right).alias("tp"), F.count_if(sent & ~right).alias("fp"),
        F.count_if(~sent & right).alias("fn"), F.count_if(~sent & ~right).alias("tn"),
        F.avg((sent == right).cast("double")).alias("routing_accuracy"),
    )


def threshold_sweep(df: DataFrame, grid: Sequence[float], score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Routing accuracy per threshold, the best one marked (the lowest of equals).

    Rows are counted once per interval between thresholds; the sweep itself runs over those
    counts, so its cost does not grow with the number of thresholds times rows.
    """
    grid = sorted(grid)
    # A row is sent to the SLM at every threshold above its score.
    reached = sum(((F.col(score) >= F.lit(float(t))).cast("int") for t in grid), F.lit(0))
    counted = df.groupBy(*by, reached.alias("_slot")).agg(
        F.count_if(F.col("slm_correct") == 1).alias("_right"), F.count(F.lit(1)).alias("_n")
    )
    sums = [F.sum("_n").alias("n")]
    for i in range(len(grid)):
        sent = F.col("_slot") <= i
        good = F.when(sent, F.col("_right")).otherwise(F.col("_n") - F.col("_right"))
        sums.append(F.sum(good).alias(f"g{i}"))
    rows = F.array(
        *[
            F.struct(F.lit(float(t)).alias("threshold"), (F.col(f"g{i}") / F.col("n")).alias("routing_accuracy"))
            for i, t in enumerate(grid)
        ]
    )
    best = F.array_max(F.transform(F.col("_rows"), lambda r: r["routing_accuracy"]))
    first = F.filter(F.col("_rows"), lambda r: r["routing_accuracy"] == best)[0]["threshold"]
    return (
        counted.groupBy(*by).agg(*sums)
        .select(*by, rows.alias("_rows"))
        .select(*by, first.alias("_best"), F.explode("_rows").alias("_r"))
        .select(*by, "_r.*", (F.col("_r.threshold") == F.col("_best")).cast("int").alias("is_best"))
    )
