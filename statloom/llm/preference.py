"""Preference pairs from conversations: a shared prompt, and two completions with loss masks.

Turns are dealt by pair once; positions, the longest common beginning, offsets and the
texts all follow from that one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHOSEN, REJECTED = "chosen", "rejected"


def escaped(text: Column) -> Column:
    """Text that cannot be taken for a marker."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def opening(role: Column) -> Column:
    return F.concat(F.lit("<|"), F.replace(F.coalesce(role, F.lit("unknown")), F.lit("|>"), F.lit("")), F.lit("|>\n"))


CLOSING = "<|end|>\n"


def numbered(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, pos, role, text): turns in order of their number, of equal numbers by role and text, NULL first."""
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    rows = turns.select(F.col(conv).alias("conv"), "turn", "role", "text").filter("conv IS NOT NULL")
    return rows.withColumn("pos", F.row_number().over(order)).select("conv", "pos", "role", "text")


def format_pairs(pairs: DataFrame, train_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per pair: pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask.

    ``pairs`` has a row per turn: pair_id, side (``chosen`` or ``rejected``), pos, role, text.
    The turns with which both sides begin alike in role and text are rendered once as the
    prompt, the rest of each side as its completion. A mask lists the parts of a completion
    that are learned from, as start and end in code points: what a role in ``train_roles``
    says, with its closing marker. A NULL role is ``unknown``, a NULL text empty; a side
    without turns has an empty completion, equal sides have two. Repeated turns count each.
    An empty table gives no row. One pair makes one row, so a pair is held in one task.
    """
    turn = F.struct(F.coalesce("role", F.lit("")).alias("r"), F.coalesce("text", F.lit("")).alias("t"))
    at, pair = Window.partitionBy("pair_id", "pos"), Window.partitionBy("pair_id")
    rows = pairs.select("pair_id", "side", "pos", "role", "text").repartition("pair_id")
    alike = (F.count("*").over(at) == 2) & (F.min(turn).over(at) == F.max(turn).over(at))
    marked = rows.withColumn("differs", F.when(~alike, F.col("pos"))).withColumn("prompt", F.col("pos") < F.coalesce(F.min("differs").over(pair), F.lit(2**31 - 1)))
    opened, said = opening(F.col("role")), F.concat(escaped(F.col("text")), F.lit(CLOSING))
    drawn = marked.select("pair_id", "side", "pos", "role", "prompt", F.length(opened).cast("long").alias("skip"), F.concat(opened, said).alias("drawn"))
    before = Window.partitionBy("pair_id", "side", "prompt").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = drawn.withColumn("begin", F.coalesce(F.sum(F.length("drawn")).over(before), F.lit(0)).cast("long"))
    span = F.struct((F.col("begin") + F.col("skip")).alias("start"), (F.col("begin") + F.length("drawn")).alias("end"))

    def text(condition: Column) -> Column:
        held = F.sort_array(F.collect_list(F.when(condition, F.struct("pos", "drawn"))))
        return F.array_join(F.transform(held, lambda x: x["drawn"]), "")

    def mask(side: str) -> Column:
        return F.sort_array(F.collect_list(F.when((F.col("side") == side) & ~F.col("prompt") & F.col("role").isin(*train_roles), span)))

    shared = F.col("prompt") & (F.col("side") == CHOSEN)
    return placed.groupBy("pair_id").agg(
        F.count_if(shared).alias("n_prompt_turns"),
        text(shared).alias("prompt"),
        text(~F.col("prompt") & (F.col("side") == CHOSEN)).alias("chosen"),
        text(~F.col("prompt") & (F.col("side") == REJECTED)).alias("rejected"),
        mask(CHOSEN).alias("chosen_mask"),
        mask(REJECTED).alias("rejected_mask"),
    )


def pair_turns(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """The turns of both sides of pairs (pair_id, chosen, rejected) of conversations, for ``format_pairs``."""
    rows = numbered(turns)
    sides = ids.select("pair_id", F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("conv")) for s in (CHOSEN, REJECTED)))).alias("x")).select("pair_id", "x.*")
    return sides.join(rows, "conv").select("pair_id", "side", "pos", "role", "text")


def swapped_replies(turns: DataFrame) -> DataFrame:
    """Pairs from plain conversations, for ``format_pairs``: each against itself with another last reply.

    The last assistant turn of a conversation is replaced on the rejected side by that of the
    conversation with the next number; without such a turn, here or there, the rejected side
    ends one turn earlier.
    """
    rows = numbered(turns)
    whole = Window.partitionBy("conv")
    reply = F.max(F.when(F.col("role") == "assistant", F.col("pos"))).over(whole)
    known = rows.withColumn("reply", reply).withColumn("last", F.max("pos").over(whole))
    replies = known.filter("pos = reply").select((F.col("conv") - 1).alias("conv"), F.col("text").alias("other"), F.lit(True).alias("has"))
    both = known.join(replies, "conv", "left").withColumn("side", F.explode(F.array(F.lit(CHOSEN), F.lit(REJECTED))))
    swaps = F.coalesce("has", F.lit(False)) & F.col("reply").isNotNull()
    cut = (F.col("side") == REJECTED) & ~swaps & (F.col("pos") == F.col("last"))
    text = F.when((F.col("side") == REJECTED) & swaps & (F.col("pos") == F.col("reply")), F.col("other")).otherwise(F.col("text"))
    return both.filter(~cut).select(F.col("conv").alias("pair_id"), "side", "pos", "role", text.alias("text"))
