"""Preference formatting: the longest common turn prefix of a chosen and a rejected conversation
is rendered once as the prompt, the rest of each as a completion with a loss mask.

The result has a row per rendered turn with its place in its part, so a conversation of any
length is spread over many tasks; joined along `start`, the rows of a part are its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from answerflow.llm.common import numbered, store

# Begins every marker of the template; in a turn's text it is broken up so that no text can
# pass for a marker.
MARK, BROKEN = "<|", "< |"


def safe(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit(BROKEN))


def opening(role: Column) -> Column:
    return F.concat(F.lit(MARK), safe(role), F.lit("|>\n"))


CLOSING = "<|end|>\n"


def preferences(
    turns: DataFrame, pairs: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    trained: str = "assistant",
) -> DataFrame:
    """One row per rendered turn: pair_id, part (prompt, chosen or rejected), position of the turn
    in its conversation, role, text as rendered, start in the part, and mask_start and mask_end,
    the characters of the part that a model is trained on: what the role `trained` says in a
    completion, with the closing marker. Others have nulls.

    `pairs` has pair_id, chosen and rejected (conversations). Turns are ordered by `turn`, ties
    by role and text; repeated rows are turns of their own; a null turn comes first. Null texts
    and roles are empty when rendered, but differ from empty ones when compared. Turns without a
    conversation belong to none. Without common turns there is no prompt row; of two equal
    conversations all is prompt and there is no completion; a conversation without turns gives
    none. Each row of `pairs` is formatted by itself: repeated rows, and pairs that share a
    pair_id or have none, come out as often as they are there. Texts of any length are one row
    a turn. Extra columns are not looked at. Empty tables give an empty result.
    """
    rows = turns.where(F.col(conversation).isNotNull()).select(
        F.col(conversation).alias("conversation"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    )
    rows = rows.withColumn("rendered", F.concat(opening(F.col("role")), safe(F.col("text")), F.lit(CLOSING)))
    ranked = numbered(rows, ["conversation"], ["turn", "role", "text"], "position", {"before": F.length("rendered").cast("long")})
    said = F.sha2(F.to_json(F.struct("role", "text")), 256)
    ranked = store(ranked.withColumn("said", said).drop("turn", "text"), "turns")
    # Every row of `pairs` is a pair of its own, whatever its pair_id.
    numbers = store(pairs.select("pair_id", "chosen", "rejected").withColumn("pair", F.monotonically_increasing_id()), "pairs")
    sides = numbers.select(
        "pair", "pair_id", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("of")) for s in ("chosen", "rejected")])).alias("s")
    ).select("pair", "pair_id", "s.side", "s.of")
    placed = store(
        sides.join(ranked, F.col("of") == F.col("conversation")).drop("of", "conversation"), "sides"
    )
    per_position = placed.groupBy("pair", "position").agg(
        F.count(F.lit(1)).alias("n"), F.min("said").alias("a"), F.max("said").alias("b"), F.min("before").alias("before")
    )
    # Up to the first difference both sides have the same characters before them.
    first = per_position.where("n < 2 or a <> b").groupBy("pair").agg(F.min(F.struct("position", "before")).alias("apart"))
    joined = placed.join(first, "pair", "left")
    shared = F.col("apart").isNull() | (F.col("position") < F.col("apart.position"))
    joined = joined.withColumn("part", F.when(shared, F.lit("prompt")).otherwise(F.col("side")))
    joined = joined.where(~((F.col("part") == "prompt") & (F.col("side") == "rejected")))
    start = F.col("before") - F.when(F.col("part") == "prompt", F.lit(0)).otherwise(F.col("apart.before"))
    counts = (F.col("part") != "prompt") & F.coalesce(F.col("role") == trained, F.lit(False))
    return joined.withColumn("start", start).select(
        "pair_id", "part", "position", "role", F.col("rendered").alias("text"), "start",
        F.when(counts, F.col("start") + F.length(opening(F.col("role")))).alias("mask_start"),
        F.when(counts, F.col("start") + F.length("rendered")).alias("mask_end"),
    )
