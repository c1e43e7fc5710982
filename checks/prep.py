from __future__ import annotations

from pyspark.sql import functions as F

from answerflow.functions.text import (
    choice_prompt,
    index_to_letter,
    joined_lines,
    math_prompt,
    molecule_prompt,
    one_line,
    parse_options,
    question_template,
)
from answerflow.operators.prep import (
    append_constant_labeled,
    augment_minority,
    class_weights,
    downsample_majority,
    exclude_value,
    filter_category,
    random_split,
    stratified_sample,
    stratified_split,
    with_class_weights,
)
from checks.registry import query
from checks.views import run_sql, view


@query("SELECT id, dataset_name, choice_type FROM fx_questions WHERE choice_type IS DISTINCT FROM 'multi'")
def without_multi_choice(spark, sf_dir):
    return exclude_value(view(spark, sf_dir, "fx_questions"), "choice_type", "multi").select(
        "id", "dataset_name", "choice_type"
    )


@query("SELECT id, category, slm_correct FROM fx_pairs WHERE category = 'F'")
def one_category(spark, sf_dir):
    return filter_category(view(spark, sf_dir, "fx_pairs"), "F").select("id", "category", "slm_correct")


@query("""
WITH ranked AS (
  SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY md5(concat('42|', CAST(id AS STRING)))) AS rn,
         count(*) OVER (PARTITION BY category) AS n
  FROM fx_questions)
SELECT id, category FROM ranked WHERE rn <= round_even(n * 1e-1, 0)
""")
def sample_per_category(spark, sf_dir):
    return stratified_sample(
        view(spark, sf_dir, "fx_questions").select("id", "category"), ["category"], "id", 0.1
    )


@query("""
WITH ranked AS (
  SELECT id, complex, row_number() OVER (PARTITION BY complex ORDER BY md5(concat('42|', CAST(id AS STRING)))) AS rn,
         count(*) OVER (PARTITION BY complex) AS n
  FROM (SELECT id, CASE WHEN slm_accuracy_fraction < 75e-2 THEN 1 ELSE 0 END AS complex FROM fx_fraction))
SELECT id, complex, CASE WHEN rn <= round_even(n * 2e-1, 0) THEN 'test' ELSE 'train' END AS split FROM ranked
""", ints=["complex"])
def split_per_label(spark, sf_dir):
    df = view(spark, sf_dir, "fx_fraction").select("id", (F.col("slm_accuracy_fraction") < 0.75).cast("int").alias("complex"))
    return stratified_split(df, ["complex"], "id")


@query("""
SELECT id, CASE WHEN CAST('0x' || substr(md5(concat('42|', CAST(id AS STRING))), 1, 8) AS BIGINT) / 4294967296e0 < 2e-1
                THEN 'test' ELSE 'train' END AS split
FROM fx_questions
""")
def split_by_hash(spark, sf_dir):
    return random_split(view(spark, sf_dir, "fx_questions").select("id"), "id")


@query("""
WITH labelled AS (SELECT id, slm_correct AS label FROM fx_pairs),
ranked AS (
  SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42|', CAST(id AS STRING)))) AS rn,
         (SELECT count(*) FROM labelled WHERE label = 0) AS n0
  FROM labelled)
SELECT id, label FROM ranked WHERE label = 0 OR rn <= n0
""", ints=["label"])
def majority_downsampled(spark, sf_dir):
    df = view(spark, sf_dir, "fx_pairs").select("id", F.col("slm_correct").alias("label"))
    return downsample_majority(df, "label", "id")


@query("""
WITH copies AS (SELECT id, complex, 0 AS copy, embedding FROM fx_vectors
                UNION ALL SELECT id, complex, 1, embedding FROM fx_vectors WHERE complex = 0
                UNION ALL SELECT id, complex, 2, embedding FROM fx_vectors WHERE complex = 0)
SELECT id, complex, copy, len(embedding) AS dims,
       CASE WHEN copy = 0 THEN list_sum(CAST(embedding AS DOUBLE[])) END AS exact_sum, true AS near
FROM copies
""", rounded=["exact_sum"], ints=["complex", "copy", "dims"])
def minority_augmented(spark, sf_dir):
    vectors = view(spark, sf_dir, "fx_vectors").withColumn("was", F.col("embedding"))
    grown = augment_minority(vectors, "complex", "embedding", "id", minority=0, factor=3, noise_std=0.001)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    moved = F.exists(F.zip_with("embedding", "was", lambda a, b: F.abs(a - b)), lambda d: d > 0.01)
    return grown.select(
        "id", "complex", "copy", F.size("embedding").alias("dims"),
        F.when(F.col("copy") == 0, total).alias("exact_sum"), (~moved).alias("near"),
    )


@query("""
SELECT category, count(*) OVER () * 0 + (SELECT count(*) FROM fx_outcomes) / (count(*) OVER () * CAST(n AS DOUBLE)) AS weight
FROM (SELECT category, count(*) AS n FROM fx_outcomes GROUP BY category)
""", rounded=["weight"])
def balanced_weights(spark, sf_dir):
    return class_weights(view(spark, sf_dir, "fx_outcomes"), "category")


@query("""
WITH w AS (SELECT slm_correct, count(*) AS n FROM fx_pairs GROUP BY slm_correct)
SELECT p.id, p.slm_correct, (SELECT count(*) FROM fx_pairs) / ((SELECT count(*) FROM w) * CAST(w.n AS DOUBLE)) AS weight
FROM fx_pairs p JOIN w ON p.slm_correct = w.slm_correct
""", rounded=["weight"], ints=["slm_correct"])
def weighted_rows(spark, sf_dir):
    return with_class_weights(view(spark, sf_dir, "fx_pairs").select("id", "slm_correct"), "slm_correct")


@query("""
SELECT id, question, 5e-1 AS slm_accuracy_fraction, 1 AS label, false AS is_simple
FROM fx_questions WHERE choice_type = 'single'
UNION ALL
SELECT item_id, text, 1e0, 0, true FROM benchmark WHERE text IS NOT NULL
""", ints=["label"])
def with_simple_questions(spark, sf_dir):
    main = run_sql(spark, sf_dir, """
        SELECT id, CASE WHEN choice_type = 'single' THEN question END AS question,
               5e-1 AS slm_accuracy_fraction, 1 AS label FROM fx_questions""")
    simple = run_sql(spark, sf_dir, "SELECT item_id AS id, text AS question FROM benchmark")
    return append_constant_labeled(main, simple)


@query("""
SELECT doc_id AS id, 3 AS n, concat(lang, ' one') AS first, concat('it''s ', source) AS second,
       concat(chr(92), '''q', chr(92), ''' ', CAST(doc_id % 97 AS STRING)) AS third
FROM documents
""", ints=["n"])
def options_from_text(spark, sf_dir):
    # Both kinds of quotes, an escape and an empty entry.
    text = F.concat(
        F.lit("  ['"), "dataset_name", F.lit(" one', \"it's "), "category", F.lit("\", '\\'q\\' "), F.col("id") % 97, F.lit("', '']")
    )
    raw = view(spark, sf_dir, "fx_questions").select("id", text.alias("options"))
    options = parse_options(F.col("options"))
    return raw.select(
        "id", F.size(options).alias("n"), options[0].alias("first"), options[1].alias("second"), options[2].alias("third")
    )


CHOICE_HEAD = (
    "The following are multiple choice questions (with answers). Think step by step and then output the answer "
    'in the format of "The answer is (X)" at the end.'
)
MOLECULE_HEAD = (
    "You are an expert chemist and pharmacologist. You are given a molecule represented in SMILES notation "
    "and a multiple choice question about its properties."
)
MOLECULE_STEP = (
    "Analyze the molecular structure and think step by step about the relevant chemical and pharmacological "
    'properties. Then output the answer in the format "The answer is (X)" at the end.'
)


@query(f"""
SELECT id,
       concat('{CHOICE_HEAD}', chr(10), chr(10), 'Question: ', question, chr(10), 'Options:', chr(10),
              'A. ', dataset_name, chr(10), 'B. ', category, chr(10)) AS choice,
       concat('{MOLECULE_HEAD}', chr(10), chr(10), 'Molecule (SMILES): ', category, chr(10), chr(10), '{MOLECULE_STEP}',
              chr(10), chr(10), 'Question: ', question, chr(10), 'Options:', chr(10),
              'A. ', dataset_name, chr(10), 'B. ', category, chr(10)) AS molecule,
       concat(chr(10), 'Solve the following math problem step by step.', chr(10), chr(10), 'You may write full reasoning.',
              chr(10), chr(10), 'At the very end, place your final answer inside a LaTeX boxed expression, like this:',
              chr(10), chr(10), chr(92), 'boxed{{YOUR_ANSWER}}', chr(10), chr(10),
              'Where YOUR_ANSWER is the final answer expressed as simply as possible (e.g., a number, fraction, or simple expression).',
              chr(10), chr(10), 'Problem:', chr(10), chr(10), '    ', question) AS math
FROM fx_questions
""")
def prompts(spark, sf_dir):
    q = F.col("question")
    options = F.array("dataset_name", "category")
    return view(spark, sf_dir, "fx_questions").select(
        "id", choice_prompt(q, options).alias("choice"), molecule_prompt(F.col("category"), q, options).alias("molecule"),
        math_prompt(q).alias("math"),
    )


@query("""
SELECT id, CASE WHEN choice_type IS NOT NULL THEN chr(CAST(65 + id % 10 AS INT)) END AS letter FROM fx_questions
""")
def answer_letters(spark, sf_dir):
    index = F.when(F.col("choice_type").isNotNull(), F.col("id") % 10)
    return view(spark, sf_dir, "fx_questions").select("id", index_to_letter(index).alias("letter"))


@query("""
SELECT id, replace(question, chr(10), ' ') AS one_line,
       regexp_replace(regexp_replace(concat(question, chr(13), chr(10), 'end', chr(11), 'x', chr(10)),
           '(\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}])$', ''),
           '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]', ' ', 'g') AS joined
FROM fx_questions
""")
def text_on_one_line(spark, sf_dir):
    messy = F.concat("question", F.lit("\r\nend\x0bx\n"))
    return view(spark, sf_dir, "fx_questions").select(
        "id", one_line(F.col("question")).alias("one_line"), joined_lines(messy).alias("joined")
    )


@query("SELECT doc_id AS id, concat('What is ', lang, '?') AS template FROM documents")
def question_templates(spark, sf_dir):
    asked = F.concat(F.lit("What is "), "dataset_name", F.lit("?\n  SMILES: CC(=O)"), "category")
    return view(spark, sf_dir, "fx_questions").select("id", question_template(asked).alias("template"))
