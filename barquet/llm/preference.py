"""Preference formatting of conversations, in DataFrame functions only.

A pair of conversations (chosen, rejected) is cut at the end of its longest common prefix of turns. The prefix is
rendered once as ``prompt``; what follows on either side is rendered as completion with a loss mask, in which only
what assistant turns say (and their end mark) counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"
END = "<|end|>\n"


def gather(turns: DataFrame, key: str, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``key, turns``, an array of (turn, role, text) in order.

    Rows without ``key`` belong to no conversation and are left out. Turns of equal number go by role and text,
    null first; null roles and texts stay as such and render as empty.
    """
    one = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    return turns.where(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("turns"))


def _head(t: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("")), F.lit("|>\n"))


def _said(t: Column) -> Column:
    return F.concat(F.coalesce(t["text"], F.lit("")), F.lit(END))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _said(t))), "")


def _mask(turns: Column) -> Column:
    """Runs of characters and whether they count in the loss, in the order of the rendered text."""
    run = lambda n, counts: F.struct(F.length(n).alias("n_chars"), counts.alias("train"))
    each = lambda t: F.array(run(_head(t), F.lit(False)), run(_said(t), F.coalesce(t["role"] == TRAINED_ROLE, F.lit(False))))
    return F.flatten(F.transform(turns, each))


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns; turns are equal in role and text, null to null."""
    same = F.zip_with(a, b, lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    shorter = F.least(F.size(a), F.size(b))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, F.least(first - 1, shorter)).otherwise(shorter).cast("int")


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Replace two columns of turns by ``n_common, prompt, chosen, rejected, chosen_mask, rejected_mask``.

    Defined cases: a null side is a conversation without turns; equal sides have all turns in the prompt and empty
    completions; without a common prefix the prompt is empty. All other columns are kept; those named like a
    result are replaced.
    """
    none = F.array().cast(pairs.schema[chosen].dataType)
    made = ("n_common", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask")
    rest = [c for c in pairs.columns if c not in (*made, chosen, rejected)]
    sides = pairs.select(*(F.col(f"`{c}`") for c in rest), F.coalesce(F.col(chosen), none).alias("__a"), F.coalesce(F.col(rejected), none).alias("__b"))
    cut = sides.withColumn("n_common", common_turns(F.col("__a"), F.col("__b")))
    after = lambda side: F.slice(F.col(side), F.col("n_common") + 1, F.size(side))
    tail = lambda side: F.when(F.size(side) > F.col("n_common"), after(side)).otherwise(none)
    prefix = F.when(F.col("n_common") > 0, F.slice("__a", F.lit(1), F.col("n_common"))).otherwise(none)
    return cut.select(
        *(F.col(f"`{c}`") for c in rest),
        "n_common",
        _render(prefix).alias("prompt"),
        _render(tail("__a")).alias("chosen"),
        _render(tail("__b")).alias("rejected"),
        _mask(tail("__a")).alias("chosen_mask"),
        _mask(tail("__b")).alias("rejected_mask"),
    )


def swap_last_answers(conversations: DataFrame, key: str) -> DataFrame:
    """Preference pairs out of plain conversations: ``key, chosen, rejected``.

    Each conversation is the chosen side of a pair of its own. The rejected side goes as far as its last assistant
    turn and has there the last assistant turn of the neighbour, the conversation whose number differs in the
    lowest bit; without a neighbour, or without an answer in either, it just ends there. The neighbours meet in
    one equi-join on distinct keys, which no frequent turn can skew.
    """
    turns = F.col("turns")
    where_last = F.array_max(F.transform(turns, lambda t, i: F.when(t["role"] == TRAINED_ROLE, i + 1)))
    own = conversations.select(key, turns, F.coalesce(where_last, F.size(turns) + 1).alias("__last"))
    answers = conversations.select(
        F.col(key).bitwiseXOR(F.lit(1)).alias("__of"), F.filter(turns, lambda t: t["role"] == TRAINED_ROLE).alias("__said")
    )
    none = F.array().cast(conversations.schema["turns"].dataType)
    answer = F.when(F.size("__said") > 0, F.slice("__said", F.size("__said"), F.lit(1))).otherwise(none)
    before = F.when(F.col("__last") > 1, F.slice(turns, F.lit(1), F.col("__last") - 1)).otherwise(none)
    joined = own.join(answers, own[key] == answers["__of"], "left")
    return joined.select(own[key], turns.alias("chosen"), F.concat(before, answer).alias("rejected"))
