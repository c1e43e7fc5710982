"""Question shaping and answer extraction as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Unicode character classes for \b and \s, and "\n" as the only line end for "." and "$".
UNICODE = "(?dU)"
# White space as Python's str.strip and str.split see it.
SPACE = r"[\s\x1c-\x1f]"
LETTERS_10 = "ABCDEFGHIJ"
LETTERS_4 = "ABCD"

# The prompt wordings.
CHOICE_INTRO = (
    "The following are multiple choice questions (with answers). "
    "Think step by step and then output the answer in the format of "
    '"The answer is (X)" at the end.\n\n'
)
MOLECULE_INTRO = (
    "You are an expert chemist and pharmacologist. "
    "You are given a molecule represented in SMILES notation and a multiple choice question about its properties.\n\n"
)
MOLECULE_TASK = (
    "Analyze the molecular structure and think step by step about the relevant chemical and pharmacological properties. "
    'Then output the answer in the format "The answer is (X)" at the end.\n\n'
)
MATH_INTRO = (
    "\nSolve the following math problem step by step.\n\n"
    "You may write full reasoning.\n\n"
    "At the very end, place your final answer inside a LaTeX boxed expression, like this:\n\n"
    "\\boxed{YOUR_ANSWER}\n\n"
    "Where YOUR_ANSWER is the final answer expressed as simply as possible "
    "(e.g., a number, fraction, or simple expression).\n\n"
    "Problem:\n\n    "
)


def _filled(col: Column) -> Column:
    """`regexp_extract` gives '' for no match; make that missing."""
    return F.nullif(col, F.lit(""))


def strip_space(col: Column) -> Column:
    """Trim white space of any kind, not only blanks."""
    return F.regexp_replace(
        F.regexp_replace(col, rf"(?U)\A{SPACE}+", ""), rf"(?U)(?<!{SPACE}){SPACE}+\z", ""
    )


def parse_options(col: Column) -> Column:
    """Text of a list literal to an array of its non-empty quoted entries (escapes kept)."""
    quoted = F.lit(r"""(?d)"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'""")
    body = F.transform(F.array(strip_space(col)), lambda x: F.substring(x, F.lit(2), F.greatest(F.length(x) - 2, F.lit(0))))[0]
    entries = F.regexp_extract_all(body, quoted, F.lit(0))
    bare = F.transform(entries, lambda e: F.substring(e, F.lit(2), F.length(e) - 2))
    return F.filter(bare, lambda e: F.length(e) > 0)


def index_to_letter(col: Column) -> Column:
    """0 is A, 1 is B, ...; missing stays missing."""
    return F.char(col.cast("int") + 65)


def lettered(options: Column) -> Column:
    """Options as lines `A. ...`."""
    return F.array_join(
        F.transform(options, lambda o, i: F.concat(F.char(i + 65), F.lit(". "), o)), "\n"
    )


def choice_prompt(question: Column, options: Column) -> Column:
    return F.concat(
        F.lit(CHOICE_INTRO), F.lit("Question: "), question, F.lit("\nOptions:\n"), lettered(options), F.lit("\n")
    )


def molecule_prompt(smiles: Column, question: Column, options: Column) -> Column:
    return F.concat(
        F.lit(MOLECULE_INTRO),
        F.lit("Molecule (SMILES): "), smiles, F.lit("\n\n"),
        F.lit(MOLECULE_TASK),
        F.lit("Question: "), question, F.lit("\nOptions:\n"), lettered(options), F.lit("\n"),
    )


def math_prompt(question: Column) -> Column:
    return F.concat(F.lit(MATH_INTRO), question)


def one_line(col: Column) -> Column:
    """Newlines to blanks."""
    return F.replace(col, F.lit("\n"), F.lit(" "))


def joined_lines(col: Column) -> Column:
    """Every kind of line break to one blank; a final break is dropped."""
    breaks = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]"
    return F.regexp_replace(F.regexp_replace(col, rf"(?:{breaks})\z", ""), breaks, " ")


def question_template(col: Column) -> Column:
    """The question without its molecule part."""
    return F.regexp_replace(col, UNICODE + r"(?<!\s)\s+SMILES:\s*.*$", "")


def extract_choice(col: Column, letters: str = LETTERS_10) -> Column:
    """The chosen letter: stated answer, else the "answer:" line, else the last letter standing alone.

    The last lone letter is looked for among A to J even if only A to D are valid; a last
    letter outside `letters` then means no answer. Both `.*` are anchored, or a long line would
    be scanned once from each of its characters.
    """
    group = f"([{letters[0]}-{letters[-1]}])"
    stated = _filled(F.regexp_extract(col, rf"answer is \(?{group}\)?", 1))
    labelled = _filled(F.regexp_extract(col, rf"(?dUm)^.*[aA]nswer:\s*{group}", 1))
    last = F.regexp_extract(col, r"(?dUs)^.*\b([A-J])\b", 1)
    return F.coalesce(stated, labelled, F.when(last.isin(*letters), last))


def extract_boxed(col: Column) -> Column:
    """Content of the first `\\boxed{...}` with balanced braces, trimmed; unbalanced is missing."""
    opening = "\\boxed{"
    start = F.locate(opening, col)
    tail = F.when(start > 0, F.substring(col, start + len(opening), F.length(col)))
    # Only braces change the depth: walk the pieces between closing braces.
    pieces = F.split(tail, r"\}")
    walked = F.aggregate(
        pieces,
        F.struct(F.lit(1).alias("depth"), F.lit(0).alias("used"), F.lit(0).alias("end")),
        lambda acc, piece: F.struct(
            F.when(acc["end"] > 0, acc["depth"])
            .otherwise(acc["depth"] + F.length(piece) - F.length(F.replace(piece, F.lit("{"), F.lit(""))) - 1)
            .cast("int").alias("depth"),
            (acc["used"] + F.length(piece) + 1).cast("int").alias("used"),
            F.when(acc["end"] > 0, acc["end"])
            .when(
                acc["depth"] + F.length(piece) - F.length(F.replace(piece, F.lit("{"), F.lit(""))) == 1,
                acc["used"] + F.length(piece) + 1,
            )
            .otherwise(0)
            .cast("int").alias("end"),
        ),
    )
    # The last piece has no closing brace after it, so an end there lies beyond the text. The
    # one-element array keeps the walk from being repeated for each use of its result.
    return F.transform(
        F.array(walked["end"]),
        lambda end: F.when(
            (end > 0) & (end <= F.length(tail)), strip_space(F.substring(tail, F.lit(1), end - 1))
        ),
    )[0]


def normalize_latex(col: Column) -> Column:
    """Bring LaTeX answers to one spelling before comparing them as text."""
    s = col
    for old, new in (("\\tfrac", "\\frac"), ("\\dfrac", "\\frac"), ("\\textbf", "\\text")):
        s = F.replace(s, F.lit(old), F.lit(new))
    s = F.regexp_replace(s, r"(?U)\\frac(\d)(\d)", r"\\frac{$1}{$2}")
    for mark in ("\\$", "$", "£", "€"):
        s = F.replace(s, F.lit(mark), F.lit(""))
    s = F.regexp_replace(s, r"(?U)(?<=[0-9}])\s*\\text\{[^}]*\}", "")
    s = F.regexp_replace(s, r"\\text\{([^}]*)\}", "$1")
    units = "degrees?|radians?|units?|cm|km|m|ft|s|kg|g"
    s = F.regexp_replace(s, rf"(?diU)(?<!\s)\s*({units})\s*$", "")
    return strip_space(F.lower(F.replace(s, F.lit(" "), F.lit(""))))


def has_indexed_variable(col: Column) -> Column:
    """Mentions a variable such as a_n or x_1."""
    return F.coalesce(col.rlike(r"(?U)\b[a-zA-Z]_[a-zA-Z0-9]+\b"), F.lit(False))


def is_plain_language(col: Column, max_words: int = 20) -> Column:
    """At most `max_words` words and no formula characters."""
    words = F.filter(F.split(col, rf"(?U){SPACE}+"), lambda w: F.length(w) > 0)
    return (F.size(words) <= max_words) & ~col.rlike(r"[_^\\{}]")


