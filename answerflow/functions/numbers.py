"""Lenient number and flag parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from answerflow.functions.text import strip_space

# Accepted spellings of a flag.
TRUE_WORDS = ("true", "1", "yes", "y", "correct")
FALSE_WORDS = ("false", "0", "no", "n", "incorrect")
NUMBER = r"(?i)^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$|^[+-]?inf(inity)?$"


def to_number(col: Column, default: float | None = None) -> Column:
    """Text to double; unreadable text and NaN become missing, missing becomes `default`.

    Text must be a decimal number or an infinity; the suffixes that casts allow (12d) are not.
    """
    text = strip_space(col.cast("string"))
    number = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return number if default is None else F.coalesce(number, F.lit(float(default)))


def to_flag(col: Column, rule: str = "text") -> Column:
    """Correctness flag as boolean.

    `text`: only "true" in any case counts. `words`: listed words, missing is false, anything
    else fails the job. `number`: above 0.5 counts, missing is false.
    """
    if rule == "text":
        return F.coalesce(F.lower(strip_space(col.cast("string"))) == "true", F.lit(False))
    if rule == "words":
        word = F.lower(strip_space(col.cast("string")))
        return (
            F.when(word.isNull(), F.lit(False))
            .when(word.isin(*TRUE_WORDS), F.lit(True))
            .when(word.isin(*FALSE_WORDS), F.lit(False))
            .otherwise(
                F.raise_error(F.concat(F.lit("cannot read as a flag: "), word)).cast("boolean")
            )
        )
    if rule == "number":
        return to_number(col, 0.0) > 0.5
    raise ValueError(f"unknown flag rule {rule!r}")
