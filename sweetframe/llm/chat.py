"""Preference formatting of chosen and rejected conversations.

Both sides of a pair are put in turn order and compared turn by turn; the longest common prefix of turns is rendered once
as the prompt, and the rest of each side as its completion. Of a completion only the replies of the trained role count for
the loss: the mask lists their places, in code points of the completion, ends included markers exclusive.

Defined cases: a null role is rendered as ``user`` and a null text as empty; turns sort by number, nulls first, then by
role and text; a turn given twice stays twice; a side without turns has an empty completion; equal sides have the whole
conversation as prompt and empty completions; a pair with one side only is still emitted. One row holds one pair, so a
conversation must fit in memory as a row, as the rendered text does; an empty table gives no rows; columns but those named
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The markers around a turn.
OPEN, AFTER_ROLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _one), "")


def _one(x: Column) -> Column:
    return F.concat(F.lit(OPEN), x["role"], F.lit(AFTER_ROLE), x["text"], F.lit(CLOSE))


def mask(turns: Column, trained: str) -> Column:
    """start:end of each trained reply with its closing marker, comma-joined."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + len(OPEN) + F.length(x["role"]) + len(AFTER_ROLE)
        end = begin + F.length(x["text"]) + len(CLOSE)
        place = F.concat(F.when(a["done"] == "", "").otherwise(","), begin.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(x["role"] == trained, F.concat(a["done"], place)).otherwise(a["done"]).alias("done"))

    return F.aggregate(turns, start, step, lambda a: a["done"])


def preference_pairs(turns: DataFrame, *, pair: str = "pair_id", side: str = "side", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """(pair, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask) of turns whose side is chosen or rejected."""
    said = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("user")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    of = lambda name: F.sort_array(F.collect_list(F.when(F.col(side) == name, said))).alias(name)
    sides = turns.groupBy(F.col(pair).alias("pair")).agg(of("chosen"), of("rejected"))
    same = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    differ = F.array_position(same, False)
    prefix = F.when(differ > 0, differ - 1).otherwise(F.size(same)).cast("int")
    cut = sides.withColumn("k", prefix).select(
        "pair", "k", F.slice("chosen", 1, F.col("k")).alias("prompt"), *[F.slice(c, F.col("k") + 1, F.size(c)).alias(c) for c in ("chosen", "rejected")]
    )
    return cut.select(
        F.col("pair").alias(pair),
        F.col("k").cast("long").alias("n_prompt_turns"),
        *[rendered(F.col(c)).alias(c) for c in ("prompt", "chosen", "rejected")],
        *[mask(F.col(c), trained).alias(f"{c}_mask") for c in ("chosen", "rejected")],
    )


def swapped_replies(conversations: DataFrame) -> DataFrame:
    """Preference turns from plain conversations: (pair_id, side, turn, role, text).

    chosen is the conversation up to its last assistant turn; rejected has, instead of that turn, the last assistant turn
    of its partner, the conversation whose id differs in the last bit. Conversations without an assistant turn, or whose
    partner has none, make no pair. Turns without a number stand before all others.
    """
    replies = conversations.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    replies = replies.where("conv_id is not null")
    other = replies.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("last.text").alias("other"))
    pairs = replies.join(other, "conv_id")
    told = conversations.join(pairs, "conv_id").where(F.col("turn").isNull() | (F.col("turn") <= F.col("last.turn")))
    swapped = F.col("turn").eqNullSafe(F.col("last.turn")) & (F.col("role") == "assistant") & F.col("text").eqNullSafe(F.col("last.text"))
    sides = F.explode(F.array(*map(F.lit, ("chosen", "rejected"))))
    both = told.select("conv_id", "turn", "role", "text", "other", swapped.alias("swapped"), sides.alias("side"))
    said = F.when((F.col("side") == "rejected") & F.col("swapped"), F.col("other")).otherwise(F.col("text"))
    return both.select(F.col("conv_id").alias("pair_id"), "side", "turn", "role", said.alias("text"))
