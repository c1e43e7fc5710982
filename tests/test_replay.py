"""What must hold between the routing policies, whatever the data."""

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from answerflow.functions.costs import PROFILES, CostModel, break_even, route_by_utility
from answerflow.operators.replay import (
    actual_cost_fit,
    by_decision_summary,
    calibrate,
    policy_detail,
    replay_policies,
    routing_confusion,
    score_histogram,
    threshold_sweep,
)
from checks.views import view

MODEL = PROFILES["classifier"]


@pytest.fixture(scope="module")
def pairs(spark, sf):
    return view(spark, sf, "fx_pairs").cache()


def test_bounds_between_policies(pairs):
    by_domain = {}
    for r in replay_policies(pairs, MODEL).collect():
        by_domain.setdefault(r.dataset_name, {})[r.policy] = r
    assert len(by_domain) == 5
    for policies in by_domain.values():
        assert all(policies["oracle"].accuracy >= p.accuracy - 1e-12 for p in policies.values())
        assert all(policies["oracle_cost"].avg_error <= p.avg_error + 1e-9 for p in policies.values())
        assert policies["all_llm"].llm_pct == 100.0 and policies["all_slm"].n_llm == 0
        assert policies["all_slm"].avg_cents == 0.0


def test_confusion_adds_up(pairs):
    for r in routing_confusion(pairs.withColumn("one", F.lit(1)), MODEL, ["one"]).collect():
        assert r.slm_slm + r.slm_llm + r.llm_slm + r.llm_llm == pairs.count()
        assert (r.missed_escalations, r.failed_escalations) == (r.llm_slm, r.slm_llm)


def test_parts_rebuild_the_mean(pairs):
    rows = {r.decision: r for r in by_decision_summary(policy_detail(pairs, MODEL)).collect()}
    parts = [r for d, r in rows.items() if d != "all"]
    assert sum(r.n for r in parts) == rows["all"].n
    for metric in ("avg_latency", "avg_cents", "avg_error"):
        assert sum(r.share * r[metric] for r in parts) == pytest.approx(rows["all"][metric])


def test_empty_class_has_rate_zero(pairs):
    row = calibrate(pairs, F.lit(0), F.lit(0)).first()
    assert (row.n_complex, row.q_slm_complex, row.q_llm_complex) == (0, 0.0, 0.0)
    assert row.n_simple == row.n


@settings(max_examples=15, deadline=None)
@given(
    q=st.tuples(*[st.floats(0.05, 0.95) for _ in range(4)]),
    weight=st.floats(1.0, 20.0),
    tokens=st.floats(10.0, 3000.0),
)
def test_utility_is_a_threshold_on_p(spark, q, weight, tokens):
    model = CostModel(q[0], q[1], q[2], q[3], 3.0, 20.0, 150.0, tokens, 0.1, weight)
    slope = (q[3] - q[1]) - (q[2] - q[0])
    if slope < 0.01:
        return
    grid = spark.range(0, 101).select((F.col("id") / 100.0).alias("p"))
    star = break_even(model)
    off_the_line = F.abs(F.col("p") - star) > 1e-9
    wrong = grid.where(off_the_line & ((route_by_utility(F.col("p"), model) == "llm") != (F.col("p") > star)))
    assert wrong.count() == 0


def test_one_row_gives_no_line(spark):
    one = spark.createDataFrame(
        [(1, 0.4, 1, 1.0, 1, 2.0, 10, 10)],
        "id int, p double, slm_correct int, slm_latency double, llm_correct int, llm_latency double, "
        "llm_input_tokens int, llm_output_tokens int",
    )
    for row in actual_cost_fit(one, MODEL).collect():
        assert (row.n, row.slope, row.intercept, row.r) == (1, None, None, None)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.5, 1.0, 1.2, -0.1)], "p double")
    left = {r.bin: r.n for r in score_histogram(df, 2).collect()}
    right = {r.bin: r.n for r in score_histogram(df, 2, right_closed=True).collect()}
    assert left == {0: 1, 1: 2}
    assert right == {0: 3, 1: 2}


def test_sweep_marks_the_lowest_of_equal_thresholds(spark):
    df = spark.createDataFrame([(0.1, 1), (0.9, 0)], "score double, slm_correct int")
    rows = threshold_sweep(df, [0.7, 0.05, 0.5]).orderBy("threshold").collect()
    assert [(r.threshold, r.routing_accuracy, r.is_best) for r in rows] == [(0.05, 0.5, 0), (0.5, 1.0, 1), (0.7, 1.0, 0)]
