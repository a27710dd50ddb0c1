"""Preference pairs as one prompt and two masked completions, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as structs of turn, role and text.

    Turns with the same number are ordered by role and text. A conversation is one record, however long.
    """
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def with_foreign_ending(turns: DataFrame) -> DataFrame:
    """Pairs (pair_id, chosen, rejected): each conversation, and the same with another one's ending.

    From the last assistant turn on, the rejected side has the turns of the conversation whose id
    differs in the lowest bit; none, if there is no such conversation or it is shorter. Without an
    assistant turn the ending is the whole conversation.
    """
    own = conversations(turns)
    partner = own.select(F.expr("conv_id ^ 1").alias("partner"), F.col("turns").alias("other"))
    both = own.join(partner, F.col("conv_id") == F.col("partner"), "left")
    numbers = F.transform(F.filter("turns", lambda t: t.role.eqNullSafe(TRAINED_ROLE)), lambda t: t.turn)
    last = F.coalesce(F.array_max(numbers), F.lit(-(1 << 62)))
    both = both.withColumn("last", last)
    kept = F.filter("turns", lambda t: t.turn.isNull() | (t.turn < F.col("last")))
    ending = F.filter(F.coalesce("other", F.array()), lambda t: t.turn >= F.col("last"))
    return both.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), F.concat(kept, ending).alias("rejected"))


def render(turn: Column) -> Column:
    """A turn as text; a null role or text is empty."""
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"), F.coalesce(turn["text"], F.lit("")), F.lit("\n"))


def format_preferences(pairs: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """One row per row of pairs (pair_id, chosen, rejected: arrays of structs with role and text):

    pair_id, prefix_turns, prompt, and for each side its completion as an array of segments (text,
    train). The prompt is the longest run of turns that both sides begin with, null equal to null,
    rendered once; a segment is a rendered turn, to be trained on if it is the assistant's. Equal sides
    have empty completions; a null side counts as empty. Repeated rows give repeated rows, an empty
    table none; other columns are not read.
    """
    side = F.array().cast("array<struct<role:string,text:string>>")
    plain = {}
    for c in ("chosen", "rejected"):
        turns = F.transform(c, lambda t: F.struct(t.role.cast("string").alias("role"), t.text.cast("string").alias("text")))
        plain[c] = F.coalesce(turns, side).alias(c)
    rows = pairs.select("pair_id", *plain.values())
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    one, two = F.slice("chosen", 1, shorter), F.slice("rejected", 1, shorter)
    same = F.zip_with(one, two, lambda a, b: a.role.eqNullSafe(b.role) & a.text.eqNullSafe(b.text))
    first = F.array_position(same, False)
    rows = rows.withColumn("prefix_turns", F.when(first > 0, first.cast("int") - 1).otherwise(shorter))
    prompt = F.array_join(F.transform(F.slice("chosen", F.lit(1), F.col("prefix_turns")), render), "")

    def completion(c: str) -> Column:
        rest = F.slice(c, F.col("prefix_turns") + 1, F.size(c))
        train = F.transform(rest, lambda t: F.struct(render(t).alias("text"), t.role.eqNullSafe(trained_role).alias("train")))
        return train.alias(c)

    return rows.select("pair_id", "prefix_turns", prompt.alias("prompt"), completion("chosen"), completion("rejected"))
