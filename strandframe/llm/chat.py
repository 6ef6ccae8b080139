"""Preference formatting of chosen and rejected conversations.

Method: the longest common turn prefix of both conversations is found and
rendered once, as the prompt; what follows in each is its completion, and masks
say which characters of a completion an assistant wrote.  Where one conversation
begins the other, nothing of it is left and its completion is empty.

A conversation is one text, so its turns are gathered in one cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm._shared import fresh

OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"
_MADE = ("n_shared", "prompt", "chosen_completion", "rejected_completion", "chosen_mask", "rejected_mask")
LEARNED = "assistant"  #: whose turns are not masked


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def rendered(turns: Column) -> Column:
    """The text of an array of (role, text) turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit("\n" + CLOSE))), "")


def mask(turns: Column) -> Column:
    """(start, end) in characters of ``rendered(turns)`` of what an assistant wrote, closing mark included."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        first = acc["at"] + F.length(_head(t))
        last = first + F.length(t["text"]) + len("\n" + CLOSE)
        span = F.struct(first.cast("long").alias("start"), last.cast("long").alias("end"))
        return F.struct(last.cast("long").alias("at"), F.when(t["role"] == LEARNED, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) of ``turns(conv_id, turn, role, text)``.

    Turns are ordered by turn (null first), role and text, which also settles ties;
    null roles and texts are empty.  Repeated rows repeat the turn.  Null conv_ids
    belong to no conversation and are left out.
    """
    one = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lists = turns.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("__turns"))
    return lists.select("conv_id", F.transform("__turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def neighbours(convs: DataFrame) -> DataFrame:
    """Pairs of conversations that are stored side by side: an even id, and the odd one after it.

    (pair_id, chosen_id, rejected_id, chosen, rejected); a conversation without its
    neighbour keeps its side, the other one is null.
    """
    side = F.col("conv_id") % 2 == 0
    pair = F.expr("cast(floor(conv_id / 2) as bigint)").alias("pair_id")
    pick = lambda c, even: F.first(F.when(side if even else ~side, F.col(c)), ignorenulls=True)
    return convs.groupBy(pair).agg(pick("conv_id", True).alias("chosen_id"), pick("conv_id", False).alias("rejected_id"), pick("turns", True).alias("chosen"), pick("turns", False).alias("rejected"))


def formatted(pairs: DataFrame) -> DataFrame:
    """Add n_shared, prompt, and both completions with their masks to (chosen, rejected) pairs.

    A missing or empty side shares nothing: the prompt is empty, and its own
    completion null if it is missing.  Equal conversations share all turns, and
    both completions are empty.  A column n_shared or of a result's name is replaced.
    """
    c, r = F.col("chosen"), F.col("rejected")
    (limit,) = fresh(pairs, "limit")
    short = F.when(c.isNull() | r.isNull(), 0).otherwise(F.least(F.size(c), F.size(r)))
    out = pairs.withColumn(limit, short)
    apart = F.filter(F.sequence(F.lit(0), F.col(limit)), lambda i: (i == F.col(limit)) | (F.get("chosen", i) != F.get("rejected", i)))
    out = out.withColumn("n_shared", F.element_at(apart, 1)).drop(limit)
    rest = lambda side: F.slice(side, F.col("n_shared") + 1, F.greatest(F.size(side) - F.col("n_shared"), F.lit(0)))
    prompt = F.when(F.col("n_shared") > 0, rendered(F.slice("chosen", F.lit(1), F.col("n_shared")))).otherwise("")
    return out.select(
        *[x for x in pairs.columns if x not in ("chosen", "rejected", *_MADE)], "n_shared", prompt.alias("prompt"),
        rendered(rest(c)).alias("chosen_completion"), rendered(rest(r)).alias("rejected_completion"), mask(rest(c)).alias("chosen_mask"), mask(rest(r)).alias("rejected_mask"),
    )
