"""Preference formatting: the shared turns of two conversations become one prompt, the rest two masked completions.

Turns are compared by role and text at the same place; the longest common turn prefix is rendered once. What follows is
rendered for each side, with the character spans of the assistant's words, the only ones that a trainer should learn.

Null roles and texts count as empty. Turns are ordered by turn number, then role, then text (null first); repeated rows
are repeated turns. Rows without pair or side belong to no conversation and are left out. A pair of which one side is
missing has no common turn; the missing side's completion is empty. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The markers of the rendered turn.
OPEN, BREAK, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
LEARNED_ROLE = "assistant"


def _rendered(turns: Column) -> Column:
    return F.array_join(
        F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(BREAK), t["text"], F.lit(CLOSE))), ""
    )


def _learned_spans(turns: Column) -> Column:
    """Start (from 0) and end (exclusive) of the words of each assistant turn in the rendered completion."""
    around = len(OPEN) + len(BREAK)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.lit(around) + F.length(t["role"])
        end = begin + F.length(t["text"])
        span = F.array(F.struct(begin.cast("int").alias("start"), end.cast("int").alias("end")))
        spans = F.when(t["role"] == LEARNED_ROLE, F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((end + F.lit(len(CLOSE))).cast("int").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step)["spans"]


def preference_format(
    turns: DataFrame, pair: str = "pair_id", side: str = "side", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans``, one row for each pair.

    ``side`` holds ``chosen`` or ``rejected``. One shuffle on the pair; a task holds the turns of one pair at a time,
    as the result row does.
    """
    own = F.col("side")
    entry = F.struct("turn", "role", "text")
    given = turns.select(
        F.col(pair).alias("pair_id"),
        F.col(side).alias("side"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).filter(F.col("pair_id").isNotNull() & own.isin("chosen", "rejected"))
    both = given.groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.when(own == "chosen", entry))).alias("c"),
        F.array_sort(F.collect_list(F.when(own == "rejected", entry))).alias("r"),
    )
    shorter = F.least(F.size("c"), F.size("r"))
    places = F.when(shorter > 0, F.sequence(F.lit(1), shorter)).otherwise(F.array().cast("array<int>"))
    differ = F.filter(
        places,
        lambda i: (F.element_at("c", i)["role"] != F.element_at("r", i)["role"])
        | (F.element_at("c", i)["text"] != F.element_at("r", i)["text"]),
    )
    shared = both.withColumn("n", F.coalesce(F.try_element_at(differ, F.lit(1)) - 1, shorter))
    rest = lambda name: F.slice(F.col(name), F.col("n") + 1, F.size(name))
    parts = shared.select("pair_id", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return parts.select(
        "pair_id",
        F.col("n").alias("n_prompt_turns"),
        _rendered(F.col("p")).alias("prompt"),
        _rendered(F.col("c")).alias("chosen"),
        _rendered(F.col("r")).alias("rejected"),
        _learned_spans(F.col("c")).alias("chosen_spans"),
        _learned_spans(F.col("r")).alias("rejected_spans"),
    )
