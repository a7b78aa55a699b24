"""Preference formatting of chat conversations, with DataFrame functions only.

A pair has a chosen and a rejected conversation. Their longest common prefix of whole
turns becomes the prompt, rendered once; what follows on each side is that side's
completion, with a mask that tells what to learn from: the assistant's own words and the
mark that ends its turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns

#: How a turn is rendered: before its role, between role and text, and after the text.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
#: Whose words are learnt; what stands for a turn without role.
LEARNT, NO_ROLE = "assistant", "unknown"


def conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: each conversation's turns (role, text) in order of turn.

    Repeated turn numbers are ordered by role and text; all stay. Turns without number come
    first. Rows without conv_id belong to no conversation and are left out. A conversation
    is one value, as its rendering is.
    """
    rows = columns(turns, "conv_id", "turn", "role", "text").where("conv_id is not null")
    return rows.groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")
    )


def with_other_ending(chats: DataFrame) -> DataFrame:
    """``pair_id, chosen, rejected``: every conversation against itself with another ending.

    Of its n turns the first ``conv_id mod n`` stay; what follows are the turns behind those of the
    conversation whose id differs in the last bit only, none where there is none. So the common
    prefix has any length, up to all of the rejected one.
    """
    two = W.partitionBy(F.shiftright("conv_id", 1))  # two conversations at most
    odd = F.col("conv_id").bitwiseAND(F.lit(1).cast("long")) == 1
    side = lambda mine: F.first(F.when(mine, F.col("turns")), ignorenulls=True).over(two)
    other = F.coalesce(F.when(odd, side(~odd)).otherwise(side(odd)), F.array().cast("array<struct<role: string, text: string>>"))
    both = chats.select("conv_id", "turns", other.alias("other"), F.pmod("conv_id", F.size("turns")).cast("int").alias("kept"))
    rest = F.slice("other", F.col("kept") + 1, F.greatest(F.size("other"), F.lit(1)))
    return both.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), F.concat(F.slice("turns", F.lit(1), F.col("kept")), rest).alias("rejected"))


def common_turns(a: Column, b: Column) -> Column:
    """The number of leading turns that two conversations share, role and text alike."""
    n = F.least(F.size(a), F.size(b))
    same = lambda i: F.get(a, i - 1)["role"].eqNullSafe(F.get(b, i - 1)["role"]) & F.get(a, i - 1)["text"].eqNullSafe(F.get(b, i - 1)["text"])
    other = F.array_min(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: ~same(i)))
    return F.when(n < 1, F.lit(0)).otherwise(F.coalesce(other - 1, n))


def _role(turn: Column) -> Column:
    return F.coalesce(turn["role"], F.lit(NO_ROLE))


def rendered(turns: Column) -> Column:
    """The turns as one string."""
    one = lambda t: F.concat(F.lit(OPEN), _role(t), F.lit(MIDDLE), F.coalesce(t["text"], F.lit("")), F.lit(CLOSE))
    return F.array_join(F.transform(turns, one), "")


def mask_of(turns: Column) -> Column:
    """Runs of the rendered turns as ``0:n`` (not learnt) and ``1:n`` (learnt), in code points."""

    def one(t: Column) -> Column:
        head = F.lit(len(OPEN + MIDDLE)) + F.length(_role(t))
        body = F.length(F.coalesce(t["text"], F.lit(""))) + len(CLOSE)
        return F.when(_role(t) == LEARNT, F.concat(F.lit("0:"), head, F.lit(",1:"), body)).otherwise(F.concat(F.lit("0:"), head + body))

    return F.array_join(F.transform(turns, one), ",")


def format_preferences(pairs: DataFrame) -> DataFrame:
    """``pair_id, n_prefix, prompt, chosen, chosen_mask, rejected, rejected_mask`` of each pair.

    ``pairs`` has ``pair_id`` and two lists of turns (role, text). Equal conversations are
    all prompt, with empty completions; without a common turn the prompt is empty. A null
    list counts as empty, a null role as ``unknown`` and a null text as empty, but null and
    empty texts aren't the same turn. Very long texts and conversations are rendered whole. Repeated rows give repeated results; null ids are
    kept; an empty table gives none; other columns play no part.
    """
    empty = F.array().cast("array<struct<role: string, text: string>>")
    both = columns(pairs, "pair_id", "chosen", "rejected").select(
        "pair_id", F.coalesce("chosen", empty).alias("c"), F.coalesce("rejected", empty).alias("r")
    )
    both = both.withColumn("n", common_turns(F.col("c"), F.col("r")))
    rest = lambda side: F.slice(side, F.col("n") + 1, F.size(side))
    return both.select(
        "pair_id", F.col("n").cast("long").alias("n_prefix"), rendered(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"),
        rendered(rest("c")).alias("chosen"), mask_of(rest("c")).alias("chosen_mask"),
        rendered(rest("r")).alias("rejected"), mask_of(rest("r")).alias("rejected_mask"),
    )
