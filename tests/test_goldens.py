"""Values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from answerflow.functions.costs import (
    PROFILES,
    CostModel,
    break_even,
    choose_model,
    route_by_score,
    route_by_utility,
    settings_with_overrides,
)
from answerflow.functions.numbers import to_flag, to_number
from answerflow.functions.routes import extract_route, route_bucket
from answerflow.functions.text import (
    LETTERS_4,
    extract_boxed,
    extract_choice,
    has_indexed_variable,
    is_plain_language,
    joined_lines,
    normalize_latex,
    parse_options,
    question_template,
)
from answerflow.operators.labels import complexity_score, quantile_bins
from answerflow.operators.metrics import classification_metrics
from answerflow.operators.scores import vote


def column(spark, values, fn, type_="string"):
    """Apply a Column function to a list of values, in order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {type_}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


@pytest.mark.parametrize(
    "profile, expected",
    [
        ("classifier", 0.683231),
        ("classifier_no_smiles", 0.591747),
        ("regressor", 0.398295),
        ("regressor_no_smiles", 0.636285),
        ("live", 0.406057),
    ],
)
def test_break_even(spark, profile, expected):
    value = spark.range(1).select(break_even(PROFILES[profile])).first()[0]
    assert value == pytest.approx(expected, abs=1e-6)


def test_break_even_of_parallel_lines_is_missing(spark):
    flat = CostModel(q_slm_simple=0.5, q_slm_complex=0.5, q_llm_simple=0.9, q_llm_complex=0.9)
    assert spark.range(1).select(break_even(flat)).first()[0] is None


def test_tie_goes_to_the_small_model(spark):
    same = CostModel(0.5, 0.5, 0.5, 0.5, 1.0, 1.0, 0.0, 0.0)
    assert spark.range(1).select(route_by_utility(F.lit(0.3), same)).first()[0] == "slm"


def test_score_routes_at_the_threshold(spark):
    row = spark.range(1).select(route_by_score(F.lit(0.5)), route_by_score(F.lit(0.5), inclusive=True)).first()
    assert tuple(row) == ("slm", "llm")


def test_half_even_scores(spark):
    df = spark.createDataFrame([(f,) for f in (0.0, 0.25, 0.5, 0.75, 1.0)], "slm_accuracy_fraction double")
    rows = complexity_score(df).orderBy("slm_accuracy_fraction").collect()
    assert [r.complexity_score for r in rows] == [1.0, 0.8, 0.5, 0.2, 0.0]


CHOICES = [
    ("The answer is (C).", "C", "C"),
    ("the answer is B and then Answer: J", "B", "B"),
    ("work\nfinal Answer: F", "F", None),
    ("maybe answer: A\nno, Answer: D", "A", "A"),
    ("Answer: A, later Answer: D", "D", "D"),
    ("either A or B", "B", "B"),
    ("A then E", "E", None),
    ("nothing here", None, None),
    ("CAB is no letter", None, None),
    ("É B È", "B", "B"),
]


def test_choices(spark):
    texts = [c[0] for c in CHOICES]
    assert column(spark, texts, extract_choice) == [c[1] for c in CHOICES]
    assert column(spark, texts, lambda c: extract_choice(c, LETTERS_4)) == [c[2] for c in CHOICES]


BOXED = [
    (r"so \boxed{\frac{1}{2}} ok", r"\frac{1}{2}"),
    (r"\boxed{a{b{c}d}e} \boxed{2}", "a{b{c}d}e"),
    (r"\boxed{ 5 }", "5"),
    (r"\boxed{}", ""),
    (r"\boxed{\frac{1}{2}", None),
    (r"\boxed{{}", None),
    (r"x} \boxed{7}", "7"),
    ("none", None),
]


def test_boxed(spark):
    assert column(spark, [b[0] for b in BOXED], extract_boxed) == [b[1] for b in BOXED]


LATEX = [
    (r"\tfrac12", r"\frac{1}{2}"),
    (r"\dfrac{3}{4}", r"\frac{3}{4}"),
    (r"5\text{ cm}", "5"),
    (r"\text{east}", "east"),
    (r"\textbf{East}", "east"),
    ("$3", "3"),
    (r"\$3 €", "3"),
    ("12 Degrees ", "12"),
    ("4 kg", "4"),
    ("sum", "su"),
    ("A B", "ab"),
    ("x\ty", "x\ty"),
]


def test_latex(spark):
    assert column(spark, [x[0] for x in LATEX], normalize_latex) == [x[1] for x in LATEX]


def test_options(spark):
    texts = ["['a', \"b's\", '']", '["x\\"y", \'z\']', "[]", " ['one'] "]
    assert column(spark, texts, parse_options) == [["a", "b's"], ['x\\"y', "z"], [], ["one"]]


def test_flags(spark):
    words = ["True", "true", "1", "yes", "correct", "0", "no", None]
    assert column(spark, words, lambda c: to_flag(c, "words")) == [True] * 5 + [False] * 3
    assert column(spark, words, to_flag) == [True, True] + [False] * 6
    assert column(spark, ["0.6", "0.5", "x", None, "1"], lambda c: to_flag(c, "number")) == [True, False, False, False, True]
    with pytest.raises(Exception, match="cannot read as a flag"):
        column(spark, ["maybe"], lambda c: to_flag(c, "words"))


def test_numbers(spark):
    assert column(spark, ["1.5", " 2 ", "x", "NaN", None], to_number) == [1.5, 2.0, None, None, None]
    assert column(spark, ["x"], lambda c: to_number(c, 7)) == [7.0]


def test_lines_and_templates(spark):
    assert column(spark, ["a\r\nb c\x0bd\n", "x\n\ny"], joined_lines) == ["a b c d", "x  y"]
    assert column(spark, ["Q one? \n SMILES: CC(=O)", "no part"], question_template) == ["Q one?", "no part"]


def test_text_features(spark):
    assert column(spark, ["let a_n be", "snake_case_x", "x_", None], has_indexed_variable) == [True, False, False, False]
    assert column(spark, ["a b", "x^2", " ".join("w" * 21)], is_plain_language) == [True, False, False]


def test_settings(spark):
    rows = [({"C_ERR": "7", "LAMBDA_LATENCY": "much"},), ({"LLM_AVG_IMPUT_TOKENS": "10"},), (None,), ({},)]
    df = spark.createDataFrame(rows, "m map<string,string>")
    model = settings_with_overrides(F.col("m"))
    got = df.select(model.error_weight, model.latency_weight, model.llm_input_tokens).collect()
    assert [tuple(r) for r in got] == [(7.0, 0.11, 154.0), (15.0, 0.11, 10.0), (15.0, 0.11, 154.0), (15.0, 0.11, 154.0)]


def test_requested_model(spark):
    asked = [" slm", "LLM", "gpt", "", None]
    assert column(spark, asked, lambda c: choose_model(c, F.lit("llm"))) == ["slm", "llm", "llm", "llm", "llm"]


def test_routes(spark):
    replies = [
        '{"route":"small"}', '{"routing":{"model":"GPT-5"}}', '{"metadata":{"selected_model":"x-large"}}',
        '{"model":"auto"}', "{}",
    ]
    assert column(spark, replies, extract_route) == ["small", "GPT-5", "x-large", "auto", None]
    assert column(spark, replies, lambda c: route_bucket(extract_route(c))) == ["slm", "llm", "llm", "default", "default"]
    with pytest.raises(Exception, match="unexpected route"):
        column(spark, ["auto"], lambda c: route_bucket(c, strict=True))


def test_quantile_bins_merge_equal_edges(spark):
    values = [0.0, 0.0, 0.0, 0.0, 1.0, 2.0, 3.0, 10.0, None]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    got = [r.bin for r in quantile_bins(df, "x", 4).orderBy("i").collect()]
    # Edges 0, 0, 0.5, 2.25, 10: the first two are one.
    assert got == [0, 0, 0, 0, 1, 1, 2, 2, None]


def test_hard_vote_tie_goes_to_the_lower_label(spark):
    a = spark.createDataFrame([(1, 0.9), (2, 0.9)], "id int, p double")
    b = spark.createDataFrame([(1, 0.2), (2, 0.6)], "id int, p double")
    assert {r.id: r.prediction for r in vote([a, b], "hard").collect()} == {1: 0, 2: 1}


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, z int")
    row = classification_metrics(df, "y", "z").first()
    assert (row.accuracy, row.precision, row.recall, row.f1) == (1.0, 0.0, 0.0, 0.0)
    assert not any(math.isnan(x) for x in row)


def test_models_are_found_by_prefix(spark):
    from answerflow.operators.merge import models_of, unpivot_outcomes

    wide = spark.createDataFrame([(1, 0, 1)], "id int, is_correct_a int, is_correct_b_2 int")
    assert models_of(wide) == ["a", "b_2"]
    with pytest.raises(ValueError, match="missing columns"):
        unpivot_outcomes(wide)
    with pytest.raises(ValueError, match="no columns start"):
        models_of(wide.select("id"))


def test_dirty_values(spark):
    assert column(spark, ["\tTrue", "true\r", "\u00a0TRUE\n", "t rue"], to_flag) == [True, True, True, False]
    assert column(spark, ["yes\r", "\tno", " 1\n"], lambda c: to_flag(c, "words")) == [True, False, True]
    numbers = ["12d", "12f", "1e3", " -.5\r", "0x1A", "1_000", "inf", "NaN", "", "+7."]
    assert column(spark, numbers, to_number) == [None, None, 1000.0, -0.5, None, None, float("inf"), None, None, 7.0]


def test_an_explicit_null_is_no_route(spark):
    from answerflow.functions.routes import extract_route

    replies = ['{"route": null, "model": "gpt"}', '{"routing": {"model": "x"}, "model": "gpt"}', '{"model": "gpt"}', "no json", None]
    assert column(spark, replies, extract_route) == [None, "x", "gpt", None, None]


def test_missing_and_nan_have_no_bin(spark):
    from answerflow.operators.labels import quantile_bins

    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (float("nan"),), (None,)], "x double")
    bins = {repr(r.x): r.bin for r in quantile_bins(df, "x", 4).collect()}
    assert (bins["1.0"], bins["4.0"], bins["nan"], bins["None"]) == (0, 3, None, None)
