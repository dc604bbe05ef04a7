"""Preference formatting.

A pair is a chosen and a rejected conversation.  Their longest common prefix of
whole turns (equal role and text) is rendered once as the prompt; the rest of each
is rendered as a completion.  For each completion the character spans that carry
loss are given (assistant text with its end mark); prompt, other roles and headers
are masked.

Turns are gathered per conversation because one conversation is one output record;
pairs meet by an equi-join on the pair's key.  All expressions are Spark's own.

Defined results: turns sort by (turn, role, text), nulls first; null role or text
renders as empty; a repeated row is a repeated turn; turns of a null conversation
key are left out (they belong to no conversation); conversations that are equal
throughout have the whole of it as prompt and two empty completions
(``identical``); a missing side is an empty conversation.  Extra columns of the
turn table are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm.text import let

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per conversation: ``key``, ``turns`` array<struct<role, text>>."""
    one = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return (turns.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`"))
            .agg(F.sort_array(F.collect_list(one)).alias("_t"))
            .select(F.col(f"`{key}`"), F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
                    .alias("turns")))


def _render(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE + "\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def loss_spans(turns: Column, role: str = "assistant") -> Column:
    """Spans ``start-end`` (characters of the rendered turns, end excluded) of the
    text and end mark of each turn by ``role``."""
    head = len(OPEN) + 1
    lengths = F.transform(turns, lambda t: F.length(_render(t)))

    def spans(n):
        ends = F.aggregate(n, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return let(ends, lambda e: F.transform(
            F.filter(F.transform(turns, lambda t, i: F.struct(t["role"].alias("role"), i.alias("i"))), lambda x: x["role"] == role),
            lambda x: F.concat((F.get(e, x["i"]) + head + F.length(x["role"])).cast("string"), F.lit("-"),
                               (F.get(e, x["i"] + 1) - 1).cast("string"))))

    return F.array_join(let(lengths, spans), ",")


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns in which both agree."""
    n = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | ~F.get(a, i).eqNullSafe(F.get(b, i)))
    return F.get(differ, F.lit(0))


def format_pairs(pairs: DataFrame, key: str = "pair_id", chosen: str = "chosen_turns", rejected: str = "rejected_turns") -> DataFrame:
    """``key``, ``n_prompt_turns``, ``prompt``, ``chosen``, ``rejected`` and the loss spans of both completions."""
    empty = F.array().cast("array<struct<role:string,text:string>>")
    two = pairs.select(F.col(f"`{key}`"), F.coalesce(F.col(chosen), empty).alias("_c"), F.coalesce(F.col(rejected), empty).alias("_r"))
    cut = two.withColumn("_n", common_prefix(F.col("_c"), F.col("_r")))
    rest = lambda c: F.slice(F.col(c), F.col("_n") + 1, F.size(c))
    parts = cut.select(F.col(f"`{key}`"), F.col("_n").cast("long").alias("n_prompt_turns"),
                       rendered(F.slice("_c", F.lit(1), F.col("_n"))).alias("prompt"),
                       rest("_c").alias("_c"), rest("_r").alias("_r"))
    return parts.select(
        F.col(f"`{key}`"), "n_prompt_turns", "prompt", rendered(F.col("_c")).alias("chosen"), rendered(F.col("_r")).alias("rejected"),
        loss_spans(F.col("_c")).alias("chosen_loss"), loss_spans(F.col("_r")).alias("rejected_loss"),
        ((F.size("_c") == 0) & (F.size("_r") == 0)).alias("identical"))


def swapped_answers(convs: DataFrame, key: str = "conv_id") -> DataFrame:
    """Preference pairs from plain conversations: the chosen one is the conversation,
    the rejected one is the same with its last assistant turn, and all after it,
    replaced by the last assistant turn of its neighbour (the other of the ids 2k and
    2k+1; without one, by nothing).  A conversation with no assistant turn is rejected
    as a whole with the neighbour's answer appended."""
    last = F.coalesce(F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i))), F.lit(-1))
    marked = convs.withColumn("_last", last)
    answer = F.when(F.col("_last") >= 0, F.array(F.get("turns", F.col("_last")))).alias("_answer")
    donors = marked.select(F.col(key).bitwiseXOR(F.lit(1).cast("long")).alias("_for"), answer)
    none = F.array().cast("array<struct<role:string,text:string>>")
    before = F.when(F.col("_last") >= 0, F.slice("turns", F.lit(1), F.greatest(F.col("_last"), F.lit(0)))).otherwise(F.col("turns"))
    return (marked.join(donors, F.col(key) == F.col("_for"), "left")
            .select(F.col(key).alias("pair_id"), F.col("turns").alias("chosen_turns"),
                    F.concat(before, F.coalesce("_answer", none)).alias("rejected_turns")))
